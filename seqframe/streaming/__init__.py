"""The algebraic summaries over streams of text files, and mates paired on streams (`mates`); the join by sequence needs all rows and doesn't stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from seqframe.operators.align import flag_census, mapq_accuracy, sam_summary
from seqframe.operators.stats import read_stats
from seqframe.sources.sam import parse_records

SUMMARIES = {"sam_summary": sam_summary, "mapq_accuracy": mapq_accuracy, "flag_census": flag_census}


def stream_lines(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Lines of the text files that appear in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)


def stream_summary(lines: DataFrame, summary: str, **options) -> DataFrame:
    """A running summary of a stream of alignment lines; write it in complete mode."""
    return SUMMARIES[summary](parse_records(lines), **options)


def stream_read_stats(lines: DataFrame) -> DataFrame:
    """Running statistics of a stream of bare base lines."""
    return read_stats(lines.filter("value not like '@%' and trim(value) <> ''").withColumnRenamed("value", "seq"))


def start(summary: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """All that is there now, into the in-memory table `name`; `checkpoint` is a folder that all executors share."""
    return summary.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
