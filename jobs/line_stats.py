"""Read-set statistics of text deliveries, kept up to date as new files come.

    python -m jobs.line_stats --input DOCUMENTS --output STATS --checkpoint MARK [--config jobs/line_stats.json]

For whoever receives bases as text, a read a line: how many reads each source has sent, their lengths, their bases
and how many of those are N. Lines that begin with `@` and blank ones are no reads, blanks at a line's end no bases.

Files of a Parquet table are streamed; a run takes all that came since the last one and ends. Spark's checkpoint holds which files were taken
and each group's sums, so a run reads only new files and only groups that got lines are written anew: each group is a partition
that dynamic overwrite replaces by its new totals. A batch that is repeated after a failure therefore writes the same rows
again. Lines are combined before the shuffle; a group that has most of the lines costs one row of each task.

Files must not change once they are there. A file that is written late counts whatever its time says (`maxFileAge` is beyond
any age; the checkpoint's list of files is what grows with their number).

Defined results: a null text has no lines; groups may be null; a group without a read has no row.
"""

from __future__ import annotations

import logging
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobs.common import command_line, read_or_empty
from seqframe.operators.stats import read_stats
from seqframe.sources.lines import bare_reads

log = logging.getLogger(__name__)

CONFIG = Path(__file__).with_suffix(".json")
SETTINGS = {"group": ["source", "lang"], "text": "text", "files_per_batch": 1000}

#: Columns of the output beside the groups; see `read_stats`.
STATS = "seqs_n long, min_l int, max_l int, reads_n_with_n long, bases_all long, bases_n long, min_n int, max_n int"


def reads_of(documents: DataFrame, group: list[str], text: str) -> DataFrame:
    """The groups and `seq` of every line that is a read."""
    lines = documents.select(*group, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "value"))
    numbered = lines.select(F.struct(*group).alias("_g"), "line_no", "value")
    return numbered.transform(lambda x: bare_reads(x, keep=("_g",))).select("_g.*", "seq")


def _partition(name: str) -> Column:
    """A group's value as the name of a folder: null, empty and number-like ones stay apart."""
    value = F.col(name).cast("string")
    return F.when(value.isNull(), "none").otherwise(F.concat(F.lit("v:"), value))


def totals_schema(spark: SparkSession, input: str, group: list[str]) -> StructType:
    table = spark.read.parquet(input).select(*group).schema
    return StructType([*table.fields, *StructType.fromDDL(STATS).fields])


def streamed_path(spark: SparkSession, input: str) -> str:
    """`input`, or, if that is a single file, a pattern that only it meets: Spark streams folders and patterns."""
    path = input.rstrip("/")
    name = path.rpartition("/")[2]
    first = spark.read.parquet(path).select(F.col("_metadata.file_name").alias("name")).first()
    return path if first and first.name != name else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, input: str, output: str, checkpoint: str, group: list[str] | None = None, text: str = "text", files_per_batch: int = 1000) -> DataFrame:
    """Take what is new in `input` and return the whole output as it then stands: the groups and `STATS`."""
    group = list(group or SETTINGS["group"])
    folders = {f"by_{name}": _partition(name) for name in group}

    def replace(batch: DataFrame, number: int) -> None:
        rows = batch.withColumns(folders).persist()
        try:
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(output)
            log.info("batch %d: wrote %d groups to %s", number, rows.count(), output)
        finally:
            rows.unpersist()

    schema = spark.read.parquet(input).schema
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", "36500d").parquet(streamed_path(spark, input))
    sums = read_stats(reads_of(files, group, text), by=tuple(group))
    query = sums.writeStream.outputMode("update").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %d new rows of %s in %d batches", sum(p.numInputRows for p in query.recentProgress), input, sum(p.numInputRows > 0 for p in query.recentProgress))
    schema = totals_schema(spark, input, group)
    return read_or_empty(spark, output, schema).select(*schema.names)  # without the names of folders


if __name__ == "__main__":
    command_line(run, __doc__, CONFIG, SETTINGS, ("input", "output", "checkpoint"))
