"""K1 to K3: records as FASTQ (with qualities) or FASTA text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rendered(name: str = "name", comment: str = "comment", seq: str = "seq", qual: str = "qual") -> Column:
    """A record's text without the last line end; sequences on one line, missing names and comments left out."""
    head = F.concat_ws(" ", F.coalesce(name, F.lit("")), F.nullif(comment, F.lit("")))
    fastq = F.concat(F.lit("@"), head, F.lit("\n"), F.col(seq), F.lit("\n+\n"), F.col(qual))
    return F.when(F.col(qual).isNotNull(), fastq).otherwise(F.concat(F.lit(">"), head, F.lit("\n"), F.col(seq)))


def write_fastx(records: DataFrame, path: str, order: str | None = None, compression: str = "gzip", **columns: str) -> None:
    """Write records below `path`; with `order` the part files follow each other in it (a range sort, never one task)."""
    ordered = records.orderBy(order) if order else records
    ordered.select(rendered(**columns).alias("value")).write.option("compression", compression).text(path)


def listing(records: DataFrame) -> DataFrame:
    """K3: `No.n<tab>name comment` lines."""
    return records.select(F.concat(F.lit("No."), F.col("rec_no").cast("string"), F.lit("\t"), F.concat_ws(" ", "name", F.nullif("comment", F.lit("")))).alias("value"))
