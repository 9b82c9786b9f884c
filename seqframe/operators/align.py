"""Summaries of alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqframe.functions import flags
from seqframe.functions.text import strict_digits


def sam_summary(alignments: DataFrame) -> DataFrame:
    """Counts of alignments, unmapped, primary, supplementary and secondary ones, and means of `opt.as` and `opt.nm` over primary ones (null without any)."""
    flag = F.col("flag")
    mapped, primary = flags.mapped(flag), flags.primary(flag)
    n_primary = F.count_if(primary)

    def mean(x: str) -> Column:
        return F.try_divide(F.sum(F.when(primary, F.col(x).cast("bigint"))), n_primary)

    return alignments.agg(
        F.count("*").alias("alignments"),
        F.count_if(~mapped).alias("unmapped"),
        n_primary.alias("primary_n"),
        F.count_if(mapped & flags.has(flag, "supplementary")).alias("supplementary"),
        F.count_if(mapped & flags.has(flag, "secondary")).alias("secondary"),
        mean("opt.as").alias("mean_as"),
        mean("opt.nm").alias("mean_nm"),
    )


def flag_census(alignments: DataFrame) -> DataFrame:
    """How many alignments have each bit; one row."""
    return alignments.agg(*[F.count_if(flags.has(F.col("flag"), name)).alias(name) for name in flags.BITS])


def _truth(distance: int, malformed: str) -> tuple[Column, Column, Column]:
    """Whether an alignment is a primary one of a single-end read (else it fails), its name is sound, and it is correct."""
    if malformed not in ("fail", "skip"):
        raise ValueError("malformed must be fail or skip")
    single = F.when(flags.has(F.col("flag"), "read1", "read2"), F.raise_error(F.lit("alignments of paired reads aren't supported")).cast("boolean")).otherwise(F.lit(True))
    parts = F.split("qname", "_")
    pos1, pos2 = strict_digits(F.get(parts, F.lit(1))), strict_digits(F.get(parts, F.lit(2)))
    sound = (F.size(parts) >= 4) & pos1.isNotNull() & pos2.isNotNull()
    if malformed == "fail":
        sound = F.when(sound, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no simulated position in the name "), F.col("qname"))).cast("boolean"))
    expected = F.when(flags.has(F.col("flag"), "reverse"), pos2 - F.length("seq") + 1).otherwise(pos1)
    correct = (F.get(parts, F.lit(0)) == F.col("rname")) & (F.abs(F.col("pos") - expected) <= distance)
    # the paired check sees every row, unmapped ones too; the name is looked at in primary ones alone
    return F.when(single, flags.primary(F.col("flag"))), sound, correct


def with_truth(alignments: DataFrame, distance: int = 10, malformed: str = "fail") -> DataFrame:
    """Primary alignments of simulated single-end reads with `correct`.

    A simulated name is `rname_pos1_pos2_...`. An alignment is correct on that reference within `distance` of pos1, or on the
    reverse strand of pos2 - length + 1. `malformed`: a name without the three parts fails, or is left out (`skip`).
    """
    primary, sound, correct = _truth(distance, malformed)
    return alignments.filter(primary).filter(sound).withColumn("correct", correct)


def mapq_accuracy(alignments: DataFrame, distance: int = 10, malformed: str = "fail") -> DataFrame:
    """`mapq`, `aligned`, `correct` of simulated reads, by mapping quality (use `unmapped` for the rest)."""
    return with_truth(alignments, distance, malformed).groupBy("mapq").agg(F.count("*").alias("aligned"), F.count_if("correct").alias("correct")).orderBy("mapq")


def unmapped(alignments: DataFrame) -> DataFrame:
    return alignments.agg(F.count_if(~flags.mapped(F.col("flag"))).alias("unmapped"))


def accuracy_total(alignments: DataFrame, distance: int = 10, malformed: str = "fail") -> DataFrame:
    """One row: mapped (primary), correct, unmapped, and the percentage correct of all reads (null without any); one pass."""
    primary, sound, correct = _truth(distance, malformed)
    verdict = F.when(primary, F.when(sound, correct.cast("int"))).alias("c")  # null where it isn't counted
    counted = F.when(primary, sound).alias("m")
    rows = alignments.select(counted, verdict, (~flags.mapped(F.col("flag"))).alias("u"))
    sums = rows.agg(F.count_if("m").alias("mapped"), F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("correct"), F.count_if("u").alias("unmapped"))
    return sums.withColumn("accuracy", F.try_divide(F.col("correct") * 100.0, F.col("mapped") + F.col("unmapped")))
