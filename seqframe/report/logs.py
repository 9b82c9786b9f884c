"""Run logs as DataFrames (`line_no`, `value`)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqframe.functions.text import clock_seconds, fields, memory_short


def variable(lines: DataFrame, name: str) -> DataFrame:
    """One row: `value`, the second field of the first line whose first field contains `name`, else `0`."""
    f = fields(F.col("value"))
    hit = F.contains(F.get(f, F.lit(0)), F.lit(name))
    first = F.min_by(F.get(f, F.lit(1)), F.when(hit, F.col("line_no")))
    return lines.agg(F.coalesce(first, F.lit("0")).alias("value"))


def elapsed(lines: DataFrame, mark: str = "Elapsed (wall clock)") -> DataFrame:
    """One row: `seconds`, of the last field of the last line that contains `mark`."""
    seconds = clock_seconds(F.try_element_at(fields(F.col("value")), F.lit(-1)))
    return lines.agg(F.max_by(seconds, F.when(F.contains("value", F.lit(mark)), F.col("line_no"))).alias("seconds"))


def stage_profile(lines: DataFrame) -> DataFrame:
    """`stage`, `seconds` (summed) and `share` (per cent of all) of lines `stage <name> <H:MM:SS> ...`."""
    f = fields(F.col("value"))
    rows = lines.filter(F.get(f, F.lit(0)) == "stage").select(F.get(f, F.lit(1)).alias("stage"), clock_seconds(F.get(f, F.lit(2))).alias("seconds"))
    by_stage = rows.groupBy("stage").agg(F.sum("seconds").alias("seconds"))
    total = F.sum("seconds").over(Window.partitionBy(F.lit(0)))  # a row a stage
    return by_stage.withColumn("share", F.try_divide(F.col("seconds") * 100.0, total))


def run_profile(lines: DataFrame, run: str = "run") -> DataFrame:
    """One row a run of a matching log (A13, P10): reads, seconds of input, trie, search and the rest (write), matched and same reads, total, memory, and percentages.

    `same` and `same_share` are the second and sixth field of the last line with `same reads`, `ram` the last but one of the last
    line with `MAX_rss` in short form (`None` for none); seconds of input and total come from the last such line, the others are summed.
    """
    f = fields(F.col("value"))
    value = F.col("value")
    near_last = clock_seconds(F.try_element_at(f, F.lit(-2)))

    def last(mark: str, x):
        return F.max_by(x, F.when(F.contains(value, F.lit(mark)), F.col("line_no")))

    def total(mark: str, x):
        return F.coalesce(F.sum(F.when(F.contains(value, F.lit(mark)), x)), F.lit(0))

    def number(x):
        return F.replace(x, F.lit(","), F.lit("")).try_cast("bigint")

    out = lines.groupBy(run).agg(
        last("Input", number(F.get(f, F.lit(1)))).alias("reads"),
        last("Input", near_last).alias("input"),
        total("Chunk", near_last).alias("trie"),
        total("read matched", near_last).alias("search"),
        total("read matched", number(F.get(f, F.lit(0)))).cast("bigint").alias("matched"),
        F.coalesce(last("same reads", number(F.get(f, F.lit(1)))), F.lit(0).cast("bigint")).alias("same"),
        last("same reads", F.get(f, F.lit(5))).alias("same_share"),
        memory_short(F.coalesce(last("MAX_rss", F.try_element_at(f, F.lit(-2)).try_cast("double")), F.lit(0.0))).alias("ram"),
        last("Elapsed_seconds", F.ceil(F.try_element_at(f, F.lit(-1)).try_cast("double"))).alias("total"),
    )
    out = out.withColumn("write", F.col("total") - F.col("input") - F.col("trie") - F.col("search"))
    for stage in ("input", "trie", "search", "write"):
        out = out.withColumn(f"{stage}_share", F.try_divide(F.col(stage) * 100.0, "total"))
    return out.withColumn("matched_share", F.try_divide(F.col("matched") * 100.0, "reads"))


def accuracy_of_table(rows: DataFrame, unmapped: int) -> DataFrame:
    """mapped, correct and the percentage correct of a `mapq aligned correct` table and its unmapped count."""
    sums = rows.agg(F.coalesce(F.sum("aligned"), F.lit(0)).cast("bigint").alias("mapped"), F.coalesce(F.sum("correct"), F.lit(0)).cast("bigint").alias("correct"))
    return sums.withColumn("accuracy", F.try_divide(F.col("correct") * 100.0, F.col("mapped") + F.lit(unmapped)))


def read_mapq_table(lines: DataFrame) -> tuple[int, DataFrame]:
    """The unmapped count of the first line, and the rows after it up to the first blank line."""
    f = fields(F.col("value"))
    first = lines.filter("line_no = 0").select(F.col("value").try_cast("int")).first()
    end = lines.filter((F.trim("value") == "") & (F.col("line_no") > 0)).agg(F.min("line_no")).first()[0]
    body = lines.filter("line_no > 0" if end is None else f"line_no > 0 and line_no < {end}")
    rows = body.select(*[F.get(f, F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate((("mapq", "int"), ("aligned", "bigint"), ("correct", "bigint")))])
    return (first[0] if first and first[0] is not None else 0), rows
