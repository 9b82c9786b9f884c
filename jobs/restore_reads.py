"""Names and qualities given back to bare, re-ordered reads, as a partitioned set of records.

    python -m jobs.restore_reads --input TABLES --output FOLDER [--config jobs/restore_reads.json]

For whoever stores bases in an order that compresses well and keeps names and qualities elsewhere: each bare read gets those of one
source read of equal bases, every source read is used once at most, and the order of the bare reads stays.

The config names a Parquet table and expressions for the columns of either side. The output folder gets

- `records`: `rid`, `name`, `comment`, `seq`, `qual` and `record` (FASTQ or FASTA text), partitioned by `part`, the range of
  `rows_per_part` ordinals that `rid` lies in; files of a part are in order of `rid`;
- `report`: one row a run's counts: reads of either side, matched and unmatched ones, bases, repeated source reads, empty reads.

A run replaces both whole, so it can be repeated, also after a failure or over a smaller input. It fails if what was written
isn't what the report says: one record for each bare read that has bases (or was matched, if unmatched ones are dropped).
"""

from __future__ import annotations

import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, load_config
from seqframe.operators.reorder import empty_reads, match_report, reorder_by_sequence
from seqframe.sinks.fastx import rendered

log = logging.getLogger(__name__)

CONFIG = Path(__file__).with_suffix(".json")
SETTINGS = {"bare_table": None, "bare": None, "source_table": None, "source": None, "tie": "lifo", "unmatched": "keep", "rows_per_part": 1_000_000}
SIDES = {"bare": ("rid", "seq"), "source": ("sid", "name", "comment", "seq", "qual")}


def _side(spark: SparkSession, input: str, table: str, columns: dict[str, str], side: str) -> DataFrame:
    if set(columns) != set(SIDES[side]):
        raise ValueError(f"{side} must give an expression for each of {SIDES[side]}")
    return spark.read.parquet(f"{input.rstrip('/')}/{table}").select(*[F.expr(columns[c]).alias(c) for c in SIDES[side]])


def run(
    spark: SparkSession,
    input: str,
    output: str,
    bare_table: str,
    bare: dict[str, str],
    source_table: str,
    source: dict[str, str],
    tie: str = "lifo",
    unmatched: str = "keep",
    rows_per_part: int = 1_000_000,
) -> DataFrame:
    """Write `records` and `report` below `output` and return the records read back."""
    reads, pool = _side(spark, input, bare_table, bare, "bare"), _side(spark, input, source_table, source, "source")
    restored = reorder_by_sequence(reads, pool, tie=tie, unmatched=unmatched)
    part = F.floor(F.col("rid") / F.lit(rows_per_part)).cast("bigint")
    # a part is a range of ordinals, so no task has more than a few times `rows_per_part` rows, whatever the bases are; texts are made after the shuffle
    parts = restored.select(*SIDES["bare"][:1], "name", "comment", "seq", "qual", part.alias("part")).repartition("part").sortWithinPartitions("part", "rid")
    records = parts.select("rid", "name", "comment", "seq", "qual", rendered().alias("record"), "part")
    records.write.mode("overwrite").option("compression", "zstd").partitionBy("part").parquet(f"{output}/records")
    report = match_report(reads, pool).crossJoin(empty_reads(reads, pool))  # a row each
    report.coalesce(1).write.mode("overwrite").parquet(f"{output}/report")
    told = spark.read.parquet(f"{output}/report").first()
    back = spark.read.schema(records.schema).parquet(f"{output}/records")
    rows, named, parts = back.agg(F.count("*"), F.count("name"), F.count_distinct("part")).first()
    log.info("read %d bare and %d source reads (%d and %d empty ones left out) from %s", told.bare_reads, told.source_reads, told.bare_empty, told.source_empty, input)
    log.info("wrote %d records, %d of them with a name, in %d parts to %s", rows, named, parts, output)
    expected = told.matched if unmatched == "drop" else told.bare_reads
    if rows != expected:
        raise RuntimeError(f"{rows} records were written, the report says {expected}")
    return back


def configured(path: str | Path = CONFIG) -> dict:
    return load_config(path, SETTINGS)


if __name__ == "__main__":
    command_line(run, __doc__, CONFIG, SETTINGS, ("input", "output"))
