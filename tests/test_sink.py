"""The sink of records: order, round trips, appends, overwrites and failures."""

import os

import pytest
from pyspark.sql import functions as F

from seqframe.functions.sequence import bkdr_hash
from seqframe.sinks.store import read_manifest
from seqframe.sources.fastx import read_fastx, register


def reads(spark, n):
    qual = F.when(F.col("id") % 3 != 0, F.lit("@>+I"))
    return spark.range(n).select(F.concat(F.lit("r"), "id").alias("name"), F.when(F.col("id") % 2 == 0, "c d").alias("comment"), F.lit("ACGN").alias("seq"), qual.alias("qual"), "id")


def save(df, path, mode="append", **options):
    df.drop("id").write.format("fastx").mode(mode).options(**options).save(path)


@pytest.mark.parametrize("compression", ["none", "gzip", "blocks"])
def test_round_trip_in_order(spark, tmp_path, compression):
    register(spark)
    path = f"{tmp_path}/out"
    df = reads(spark, 30_000).repartitionByRange(4, F.desc("id")).sortWithinPartitions(F.desc("id"))
    save(df, path, compression=compression)
    names = [r.name for r in read_fastx(spark, path, split_bytes=20_000).orderBy("file_id", "rec_no").collect()]
    assert names == [f"r{i}" for i in reversed(range(30_000))]
    back = read_fastx(spark, path, columns=["name", "comment", "seq", "qual"])
    assert back.exceptAll(df.drop("id")).count() == 0 == df.drop("id").exceptAll(back).count()
    told = read_manifest(path)
    assert sum(f["records"] for f in told) == 30_000 and sum(f["bases"] for f in told) == 120_000 and len(told) > 1
    assert sorted(os.listdir(path)) == sorted([*(f["file"] for f in told), "_manifest.json"])
    save(reads(spark, 10), path, compression=compression)
    assert read_fastx(spark, path).count() == 30_010 and [f["generation"] for f in read_manifest(path)][-1] == 2
    save(reads(spark, 7), path, "overwrite", compression=compression)
    assert read_fastx(spark, path).count() == 7 and sorted(os.listdir(path)) == sorted([*(f["file"] for f in read_manifest(path)), "_manifest.json"])


def test_a_failed_job_leaves_what_was_there(spark, tmp_path):
    register(spark)
    path = f"{tmp_path}/out"
    save(reads(spark, 10), path)
    before = {f: os.path.getmtime(f"{path}/{f}") for f in os.listdir(path)}
    bad = reads(spark, 4000).withColumn("qual", F.when(F.col("id") == 3999, "I").otherwise(F.col("qual")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="1 qualities for 4 bases"):
            save(bad, path, mode)
        assert {f: os.path.getmtime(f"{path}/{f}") for f in os.listdir(path)} == before
    with pytest.raises(Exception, match="takes name and seq"):
        reads(spark, 1).write.format("fastx").mode("append").save(path)
    with pytest.raises(Exception, match="compression"):
        save(reads(spark, 1), path, compression="xz")


def test_no_records(spark, tmp_path):
    register(spark)
    save(reads(spark, 0), f"{tmp_path}/out")
    assert read_manifest(f"{tmp_path}/out") == [] and read_fastx(spark, f"{tmp_path}/out").count() == 0


def test_hash(spark):
    texts = ["", "a", "frag1/1", "z" * 300, None]
    want = []
    for t in texts:
        h = 0
        for c in t or "":
            h = (h * 1313 + ord(c)) % 2**64
        want.append(None if t is None else h)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", bkdr_hash(F.col("t")).alias("h")).orderBy("i").collect()
    assert [None if r.h is None else int(r.h) for r in rows] == want
