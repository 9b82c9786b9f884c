"""Statistics of read sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType
from pyspark.sql.window import Window

from seqframe.functions.sequence import n_count
from seqframe.plans.scratch import new_folder


def read_stats(reads: DataFrame, by: tuple[str, ...] = (), seq: str = "seq") -> DataFrame:
    """One row (a group): number and lengths of reads, bases, N bases, reads with N and the range of their N counts (0 without any)."""
    rows = reads.select(*by, F.length(seq).alias("_l"), n_count(F.col(seq)).alias("_n"))
    with_n = F.when(F.col("_n") > 0, F.col("_n"))
    return rows.groupBy(*by).agg(
        F.count("*").alias("seqs_n"),
        F.min("_l").alias("min_l"),
        F.max("_l").alias("max_l"),
        F.count(with_n).alias("reads_n_with_n"),
        F.coalesce(F.sum(F.col("_l").cast("bigint")), F.lit(0)).cast("bigint").alias("bases_all"),
        F.coalesce(F.sum(F.col("_n").cast("bigint")), F.lit(0)).cast("bigint").alias("bases_n"),
        F.coalesce(F.min(with_n), F.lit(0)).alias("min_n"),
        F.coalesce(F.max("_n"), F.lit(0)).alias("max_n"),
    )


def read_stats_paired(first: DataFrame, second: DataFrame, seq: str = "seq") -> DataFrame:
    """`read_stats` of two files with `file_no` 1 and 2; fails if they have unequal numbers of reads."""
    both = first.select(F.lit(1).alias("file_no"), seq).unionByName(second.select(F.lit(2).alias("file_no"), seq))
    both_rows = Window.partitionBy(F.lit(0))  # two rows
    out = read_stats(both, ("file_no",), seq).withColumn("_most", F.max("seqs_n").over(both_rows)).withColumn("_files", F.count("*").over(both_rows))
    sound = (F.col("seqs_n") == F.col("_most")) & (F.col("_files") == 2)
    return out.filter(F.when(sound, F.lit(True)).otherwise(F.raise_error(F.lit("the two files have unequal numbers of reads")).cast("boolean"))).drop("_most", "_files")


def n_profile(reads: DataFrame, seq: str = "seq") -> DataFrame:
    """Reads by their number of N."""
    return reads.select(n_count(F.col(seq)).alias("n_count")).groupBy("n_count").agg(F.count("*").alias("reads"))


def duplicates(reads: DataFrame, by: tuple[str, ...] = (), seq: str = "seq") -> DataFrame:
    """Reads, and reads that repeat another's sequence (in the same group); sequences are combined before the shuffle."""
    each = reads.groupBy(*by, seq).agg(F.count("*").alias("_n"))
    return each.groupBy(*by).agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("reads"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def reference_length(sequences: DataFrame, ln: str = "ln") -> DataFrame:
    """Total length of the reference sequences of a header."""
    return sequences.agg(F.coalesce(F.sum(F.col(ln).cast("bigint")), F.lit(0)).cast("bigint").alias("ref_len"))


#: Values that one task orders; ranges that more of them are dealt to; quantiles of a sketch, and the share of all ranks (one in so many) that each may be off by.
ORDERED, RANGES = 1 << 20, 256
QUANTILES, ACCURACY = 1000, 10_000


def kth_smallest(rows: DataFrame, value: Column, k: int, ordered: int = ORDERED) -> DataFrame:
    """The k-th smallest value (from 1), repeats counted; no row if there are fewer.

    Numbers, dates and times are read twice whatever k is: a sketch of quantiles (merged from those of all tasks) brackets the k-th, and one exact
    pass counts what lies below and each value within. If that may be more than `ordered` rows, those within are written, a few thousandths of all,
    and bracketed again. Values of other kinds are counted, and found by ranges whose ends are values taken by a hash.
    """
    values = rows.select(value.alias("value")).filter("value is not null")
    kind = values.schema["value"].dataType
    if not isinstance(kind, (NumericType, DateType, TimestampType, TimestampNTZType)):
        return _kth_by_ranges(values, k, ordered)
    shares = F.array(*[F.lit(i / QUANTILES) for i in range(QUANTILES + 1)])
    while True:
        n, grid = values.agg(F.count("*"), F.percentile_approx("value", shares, ACCURACY)).first()
        if not 1 <= k <= n:
            return values.limit(0)
        first, last = int((k / n - 2 / ACCURACY) * QUANTILES) - 1, int((k / n + 2 / ACCURACY) * QUANTILES) + 2
        low = F.col("value") < F.lit(grid[first]).cast(kind) if first > 0 else F.lit(False)
        high = F.col("value") > F.lit(grid[last]).cast(kind) if last < QUANTILES else F.lit(False)
        few = n * ((last - first) / QUANTILES + 4 / ACCURACY) <= ordered
        # null stands for all values below the bracket; those above it don't matter
        counted = values.filter(~high).groupBy(F.when(low, None).otherwise(F.col("value")).alias("value")).agg(F.count("*").alias("n"))
        if few or n <= ordered:
            return _at(counted, k)
        below, inside = values.agg(F.count_if(low), F.count_if(~low & ~high)).first()
        if not below < k <= below + inside or inside == n:  # a sketch that is off, or all values are one of a few
            return _kth_by_ranges(values, k, ordered)
        folder = new_folder(rows.sparkSession, "bracket")
        values.filter(~low & ~high).write.parquet(folder)
        values, k = rows.sparkSession.read.schema(values.schema).parquet(folder), k - below


def _at(counted: DataFrame, k: int) -> DataFrame:
    """The value at rank `k` of values with their numbers `n`, few enough for one task; a null value comes first and isn't one."""
    to = F.sum("n").over(Window.orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("to", to).filter((F.col("to") >= k) & (F.col("to") - F.col("n") < k)).select("value").filter("value is not null")


def _kth_by_ranges(values: DataFrame, k: int, ordered: int) -> DataFrame:
    """The same for values of any kind: counted once, and while more than `ordered` distinct ones are left only the range that has the k-th goes on."""
    folder = new_folder(values.sparkSession, "counted")
    values.groupBy("value").agg(F.count("*").alias("n")).write.parquet(folder)
    counted = values.sparkSession.read.parquet(folder)
    round_ = 0
    while (distinct := counted.count()) > ordered:
        place = F.pmod(F.xxhash64(F.lit(round_), "value"), F.lit(max(1, distinct // RANGES)))
        ends = sorted(r.value for r in counted.filter(place == 0).select("value").limit(4 * RANGES).collect())
        round_ += 1
        if not ends:
            continue
        bounds = F.array(*[F.lit(e) for e in ends])
        range_ = F.size(F.filter(bounds, lambda e: e < F.col("value")))
        sizes = {r.range: r.n for r in counted.groupBy(range_.alias("range")).agg(F.sum("n").alias("n")).collect()}  # a row a range
        before, at = 0, 0
        while at <= len(ends) and before + sizes.get(at, 0) < k:
            before, at = before + sizes.get(at, 0), at + 1
        if at > len(ends):
            return counted.limit(0).select("value")
        k -= before
        if at:
            counted = counted.filter(F.col("value") > F.lit(ends[at - 1]))
        if at < len(ends):
            counted = counted.filter(F.col("value") <= F.lit(ends[at]))
    return _at(counted, k)
