"""Text lines, with their number where order matters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from seqframe.sources.files import numbered, text_lines

__all__ = ["bare_reads", "numbered", "read_lines"]


def read_lines(spark: SparkSession, path: str, missing_ok: bool = False) -> DataFrame:
    """Numbered lines of a file or folder, compressed or not; with `missing_ok` a missing one has none."""
    try:
        return numbered(text_lines(spark, path))
    except AnalysisException:
        if not missing_ok:
            raise
        return spark.createDataFrame([], "line_no long, value string")


def bare_reads(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """`keep` columns, `rid`, `seq` of numbered lines of bases; header lines (`@`) and blank ones are no reads but keep their number."""
    return lines.filter(~F.col("value").startswith("@") & (F.trim("value") != "")).select(*keep, F.col("line_no").alias("rid"), F.rtrim("value").alias("seq"))
