"""Mates paired on streams: as the batch join pairs them, in any order of files, over restarts."""

import datetime
import gzip
import random

import pytest
from pyspark.sql import functions as F

from seqframe.operators.reorder import reorder_mates
from seqframe.sources.fastx import read_fastx, stream_fastx
from seqframe.streaming.mates import pair_mates, start_pairs

FIRST, SECOND = "rid long, name string", "rid long, name string, seq string, qual string, n long, at timestamp"
AT = datetime.datetime(2020, 1, 2, 3, 4, 5, 678901)


def take(spark, folder):
    first = spark.readStream.schema(FIRST).option("maxFilesPerTrigger", 1).parquet(f"{folder}/first")
    second = spark.readStream.schema(SECOND).option("maxFilesPerTrigger", 1).parquet(f"{folder}/second")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    start_pairs(pair_mates(first, second), f"{folder}/out", f"{folder}/mark")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
    return spark.read.parquet(f"{folder}/out")


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_over_files_and_restarts(spark, tmp_path, seed):
    folder, rng = f"file://{tmp_path}", random.Random(seed)
    a = [(i, f"f{i}/1") for i in range(120)]
    b = [(i * 7 % 1009, f"f{i}/2", "ACGT"[: i % 5], None if i % 3 else "II", None if i % 4 else 2**53 + i, None if i % 5 else AT) for i in range(120)]
    parts = [("first", FIRST, a[i::3]) for i in range(3)] + [("second", SECOND, b[i::3]) for i in range(3)]
    rng.shuffle(parts)
    for k, (side, kind, rows) in enumerate(parts):
        for s, empty in (("first", FIRST), ("second", SECOND)):
            if not k:
                spark.createDataFrame([], empty).write.mode("append").parquet(f"{folder}/{s}")
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{folder}/{side}")
        if k in (1, 3, 5):  # a run, ended, and taken up again from its checkpoint
            got = take(spark, folder)
    want = reorder_mates(spark.createDataFrame(a, FIRST), spark.createDataFrame(b, SECOND))
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert take(spark, folder).count() == 120  # nothing new, nothing again


def test_repeated_names_are_used_once(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(1, "x/1"), (2, "x/1"), (3, "x/1"), (4, "y/1")], FIRST).write.parquet(f"{folder}/first")
    spark.createDataFrame([(9, "x/2", "A", None, None, None), (8, "x/2", "C", None, None, None)], SECOND).write.parquet(f"{folder}/second")
    assert take(spark, folder).count() == 2
    spark.createDataFrame([(7, "x/2", "G", None, None, None), (6, "x/2", "T", None, None, None), (5, "z/2", "N", None, None, None)], SECOND).coalesce(1).write.mode("append").parquet(f"{folder}/second")
    got = take(spark, folder)
    assert sorted(r.rid for r in got.collect()) == [1, 2, 3] and got.select("seq").distinct().count() == 3
    assert got.filter(F.col("name") != "x/2").count() == 0


def test_records_of_new_files(spark, tmp_path):
    """Two runs over a growing folder: each record once, from plain and compressed files; and a bad file fails the run."""
    (tmp_path / "in").mkdir()

    def add(name, n, squeeze=lambda x: x):
        (tmp_path / "in" / name).write_bytes(squeeze("".join(f"@{name}.{i}/1 c\nAC\nGT\n+\n@III\n" for i in range(n)).encode()))

    def run(**more):
        query = stream_fastx(spark, f"file://{tmp_path}/in", files_per_batch=1, **more).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/mark").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.parquet(f"file://{tmp_path}/out")

    add("b.fq", 30)
    add("c.fq.gz", 20, gzip.compress)
    assert run().count() == 50
    add("a.fq", 40_000)  # before the others in name, and more than a batch
    add("d", 5, gzip.compress)
    columns = ["rec_no", "name", "comment", "seq", "qual", "l_seq"]
    want = sorted(tuple(r) for r in read_fastx(spark, f"{tmp_path}/in").select(*columns).collect())
    assert sorted(tuple(r) for r in run().select(*columns).collect()) == want and run().count() == len(want)
    (tmp_path / "in" / "e.fq").write_text("@x\nAC\n+\nI\n")
    with pytest.raises(Exception, match="1 qualities for 2 bases"):
        run()
    assert run(malformed="skip").count() == len(want)
