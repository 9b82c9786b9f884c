"""Records by number or name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.functions.sequence import bases_at, in_bounds


def contig_list(records: DataFrame) -> DataFrame:
    """`rec_no`, `name`, `comment` (empty if none) of all records."""
    return records.select("rec_no", "name", F.coalesce("comment", F.lit("")).alias("comment"))


def nth_record(records: DataFrame, n: int) -> DataFrame:
    """The record number `n`, counted from 1 as `rec_no`; none for another number."""
    return records.filter(F.col("rec_no") == n)


def sequence_view(records: DataFrame, requests: DataFrame) -> DataFrame:
    """For each request (`name`, `start` from 1, `length`) the bases of the first record of that name; an unknown name gives no row, a range beyond it null bases.

    Names alone are looked through first; then only the sequences of the records that are asked for travel.
    """
    names = records.select("name", "rec_no").join(requests.select("name").distinct(), "name", "left_semi")
    first = names.groupBy("name").agg(F.min("rec_no").alias("rec_no"))
    found = records.select("name", "rec_no", F.coalesce("comment", F.lit("")).alias("comment"), "seq").join(first, ["name", "rec_no"], "left_semi").drop("rec_no")
    seq = F.col("seq")
    return requests.join(found, "name").select("name", "comment", F.length(seq).alias("l_seq"), "start", "length", bases_at(seq, F.col("start"), F.col("length")).alias("bases"), in_bounds(seq, F.col("start"), F.col("length")).alias("in_bounds"))
