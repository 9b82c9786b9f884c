"""The two jobs: over growing input, run again, after a failure, and against their SQL."""

import json
import logging

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import line_stats, queries, restore_reads
from jobs.common import load_config
from seqframe.operators.stats import read_stats

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", list(queries.QUERIES))
@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_same_rows_as_sql(spark, name, sf):
    df = queries.QUERIES[name](spark, sf)
    con = duckdb.connect()
    for t in ("documents", "orders"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    result = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df) == sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in result.fetchall()), key=str)


class Delivery:
    """A growing copy of the documents, a few files at a time."""

    def __init__(self, spark, folder):
        self.spark, self.input, self.output, self.checkpoint = spark, f"file://{folder}/in", f"file://{folder}/out", f"file://{folder}/mark"
        self.docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")

    def add(self, where, files=2):
        self.docs.filter(where).repartition(files).write.mode("append").parquet(self.input)

    def run(self, **more):
        return line_stats.run(self.spark, self.input, self.output, self.checkpoint, **more)

    def expected(self, group=("source", "lang")):
        return rows(read_stats(line_stats.reads_of(self.spark.read.parquet(self.input), list(group), "text"), by=group))


def stamps(spark, path, where="true"):
    """Each file of an output and its time."""
    return {(r.p, r.t) for r in spark.read.parquet(path).filter(where).select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_modification_time").alias("t")).collect()}


def test_line_stats_over_growing_input(spark, tmp_path, caplog):
    d = Delivery(spark, tmp_path)
    d.add("doc_id % 3 = 0")
    with caplog.at_level(logging.INFO, logger="jobs"):
        assert rows(d.run(files_per_batch=1)) == d.expected()
        first = spark.read.parquet(d.input).count()
        d.add("doc_id % 3 = 1 and source <> 'src1'")
        held = stamps(spark, d.output, "source = 'src1'")
        assert rows(d.run()) == d.expected()
        second = spark.read.parquet(d.input).count() - first
    assert f"read {first} new rows" in caplog.text and f"read {second} new rows" in caplog.text  # only what is new
    assert held and held <= stamps(spark, d.output)  # a group without new lines isn't written again
    before = stamps(spark, d.output)
    assert rows(d.run()) == d.expected() and stamps(spark, d.output) == before  # nothing new: nothing written
    d.add("doc_id % 3 = 2", files=1)
    assert rows(d.run()) == d.expected()


def test_line_stats_after_a_failure(spark, tmp_path, monkeypatch):
    """A batch that failed after its rows were written is taken again and counts once."""
    d = Delivery(spark, tmp_path)
    d.add("doc_id % 2 = 0")
    d.run()
    d.add("doc_id % 2 = 1")

    def fail(*a):
        raise RuntimeError("lost")

    monkeypatch.setattr(line_stats.log, "info", lambda message, *a: fail() if message.startswith("batch") else None)
    with pytest.raises(Exception, match="lost"):
        d.run()
    monkeypatch.undo()
    assert rows(d.run()) == d.expected()


def test_line_stats_of_odd_rows(spark, tmp_path):
    d = Delivery(spark, tmp_path)
    odd = [(None, "ACN\n\n@x\nA  ", None), ("", "NN\r\nT", "1"), ("01", None, "1"), ("1", "  \n\n", "1"), ("a/b=c", "é", ""), ("", "A" * 100_000, None)]
    spark.createDataFrame(odd, "source string, text string, lang string").write.parquet(d.input)
    got = d.run()
    assert rows(got) == d.expected()
    assert {(r.source, r.lang): (r.seqs_n, r.bases_all, r.bases_n) for r in got.collect()} == {(None, None): (2, 4, 1), ("", "1"): (2, 4, 2), ("a/b=c", ""): (1, 1, 0), ("", None): (1, 100_000, 0)}
    spark.createDataFrame([("", "GG", "1")], "source string, text string, lang string").write.mode("append").parquet(d.input)
    assert rows(d.run()) == d.expected()


def test_line_stats_of_no_rows(spark, tmp_path):
    d = Delivery(spark, tmp_path)
    d.add("false", files=1)
    assert d.run().collect() == []
    assert d.run().collect() == []


SIDES = {"bare_table": "b.parquet", "bare": {"rid": "rid", "seq": "seq"}, "source_table": "s.parquet", "source": {c: c for c in ("sid", "name", "comment", "seq", "qual")}}


def tables(spark, folder, n):
    spark.createDataFrame([(i, "ACGT"[: i % 4] * 3) for i in range(n)], "rid long, seq string").write.mode("overwrite").parquet(f"file://{folder}/b.parquet")
    spark.createDataFrame([(i, f"r{i}", None if i % 2 else f"c{i}", "ACGT"[: i % 3] * 3, "I" * (3 * (i % 3)) if i % 5 else None) for i in range(n)], "sid long, name string, comment string, seq string, qual string").write.mode("overwrite").parquet(f"file://{folder}/s.parquet")


def test_restore_again_and_over_less(spark, tmp_path):
    tables(spark, tmp_path, 100)
    out = f"file://{tmp_path}/out"
    first = rows(restore_reads.run(spark, f"file://{tmp_path}/", out, **SIDES, rows_per_part=20))
    assert rows(restore_reads.run(spark, f"file://{tmp_path}", out, **SIDES, rows_per_part=20)) == first
    assert len(first) == 75 and {r.part for r in spark.read.parquet(f"{out}/records").collect()} == set(range(5))
    report = spark.read.parquet(f"{out}/report").collect()
    assert len(report) == 1 and (report[0].bare_reads, report[0].bare_empty, report[0].matched) == (75, 25, 50)
    tables(spark, tmp_path, 30)
    less = restore_reads.run(spark, f"file://{tmp_path}", out, **SIDES, rows_per_part=20)
    kept = less.collect()
    assert {r.part for r in kept} == {0, 1}
    dropped = restore_reads.run(spark, f"file://{tmp_path}", out, **SIDES, unmatched="drop")
    assert dropped.filter("name is null").count() == 0 < dropped.count() < len(kept)


def test_restored_records_are_in_order(spark, tmp_path):
    tables(spark, tmp_path, 400)
    out = f"file://{tmp_path}/out"
    restore_reads.run(spark, f"file://{tmp_path}", out, **SIDES, rows_per_part=150)
    by_file = spark.read.parquet(f"{out}/records").withColumn("f", F.input_file_name()).collect()
    for f in {r.f for r in by_file}:
        rids = [r.rid for r in by_file if r.f == f]
        assert rids == sorted(rids)
    assert {"@r397\nAAA\n+\nIII", ">r395\nACACAC"} < {r.record for r in by_file}  # with qualities and without


def test_restored_texts_are_made_after_the_shuffle(spark, tmp_path, monkeypatch):
    """What is moved to the parts has no text of records in it, and what is written is compressed by entropy."""
    tables(spark, tmp_path, 100)
    moved, out = [], f"file://{tmp_path}/out"
    kind = type(spark.range(1))
    repartition = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, *a: (moved.append(self.columns), repartition(self, *a))[1])
    restore_reads.run(spark, f"file://{tmp_path}", out, **SIDES)
    assert [c for c in moved if "part" in c] == [["rid", "name", "comment", "seq", "qual", "part"]]
    files = list((tmp_path / "out/records").rglob("*.parquet"))
    assert files and all(".zstd." in f.name for f in files)


def test_restore_of_no_reads(spark, tmp_path):
    tables(spark, tmp_path, 0)
    assert restore_reads.run(spark, f"file://{tmp_path}", f"file://{tmp_path}/out", **SIDES).collect() == []


def test_config(tmp_path):
    assert set(restore_reads.configured()) == set(restore_reads.SETTINGS)
    assert load_config(line_stats.CONFIG, line_stats.SETTINGS) == line_stats.SETTINGS
    (tmp_path / "c.json").write_text(json.dumps({"grup": []}))
    with pytest.raises(ValueError, match="grup"):
        load_config(tmp_path / "c.json", line_stats.SETTINGS)
    with pytest.raises(ValueError, match="source must give"):
        restore_reads._side(None, "", "", {"sid": "1"}, "source")


def test_settings_stay(spark, tmp_path):
    before = dict(r for r in map(tuple, spark.sql("set").collect()))
    tables(spark, tmp_path, 10)
    restore_reads.run(spark, f"file://{tmp_path}", f"file://{tmp_path}/out", **SIDES)
    queries.job1_line_stats(spark, SF).collect()
    assert dict(r for r in map(tuple, spark.sql("set").collect())) == before
