import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqframe.operators import reorder, stats


def tables(spark, rng, n=400):
    seqs = ["N" * 20, *("".join(rng.choice("ACGT") for _ in range(12)) for _ in range(30))]
    pick = lambda: seqs[0] if rng.random() < 0.4 else rng.choice(seqs)
    bare = [(i, pick() if i % 17 else "TTT") for i in range(n)] + [(n, "")]
    source = [(i, f"s{i}", None if i % 2 else "c", pick(), "I" * 12 if i % 3 else None) for i in range(n)] + [(n, "e", None, "", None)]
    return bare, source, spark.createDataFrame(bare, "rid long, seq string").repartition(5), spark.createDataFrame(source, "sid long, name string, comment string, seq string, qual string").repartition(3)


def one_by_one(bare, source, tie, chunk):
    """Stacks (or queues) of source reads by sequence, chunk after chunk, served to bare reads in order."""
    waiting = {}
    for sid, name, comment, seq, qual in sorted(source, key=lambda s: (chunk(s[0]), -s[0] if tie == "lifo" else s[0])):
        if seq:
            waiting.setdefault(seq, []).append((name, comment, qual))
    return [(rid, *(waiting[seq].pop(0) if waiting.get(seq) else (None, None, None))) for rid, seq in bare if seq]


@pytest.mark.parametrize("tie", ["lifo", "fifo"])
@pytest.mark.parametrize("chunked", [False, True])
@pytest.mark.parametrize("slice_", [7, reorder.SLICE])
def test_by_sequence(spark, tie, chunked, slice_):
    bare, source, b, s = tables(spark, random.Random(3))
    out = reorder.reorder_by_sequence(b, s, tie, reorder.constant_length_chunk(F.col("sid"), 12, 12 * 90) if chunked else None, slice_=slice_)
    rows = sorted((r.rid, r.name, r.comment, r.qual) for r in out.collect())
    assert rows == sorted(one_by_one(bare, source, tie, (lambda i: i // 90) if chunked else (lambda i: 0)))
    used = Counter(r[1] for r in rows if r[1])
    assert max(used.values()) == 1
    have, want = Counter(x[3] for x in source), Counter(x[1] for x in bare)
    report = reorder.match_report(b, s).first()
    assert report.matched == len(used) == sum(min(have[q], want[q]) for q in want if q)
    assert (report.bare_reads, report.unmatched, report.source_reads) == (400, 400 - report.matched, 400)
    assert report.source_duplicates == stats.duplicates(s.filter("seq <> ''")).first().duplicates


def test_unmatched(spark):
    _, _, b, s = tables(spark, random.Random(4))
    kept = reorder.reorder_by_sequence(b, s)
    assert reorder.reorder_by_sequence(b, s, unmatched="drop").count() == kept.filter("name is not null").count() < kept.count()
    with pytest.raises(Exception, match="no source"):
        reorder.reorder_by_sequence(b, s, unmatched="fail").collect()
    with pytest.raises(ValueError):
        reorder.reorder_by_sequence(b, s, tie="any")


def test_mates(spark):
    first = spark.createDataFrame([(0, "b/1"), (1, "a/1"), (2, "a/1"), (3, "c/1")], "rid long, name string")
    second = spark.createDataFrame([(0, "a/2", "A", None), (1, "c/2", "C", "I"), (2, "a/2", "AA", None), (3, "b/2", "G", None), (4, "z/2", "T", None)], "rid long, name string, seq string, qual string")
    for slice_ in (1, reorder.SLICE):
        rows = sorted(map(tuple, reorder.reorder_mates(first, second, slice_=slice_).collect()), key=lambda r: r[0])
        assert rows == [(0, "b/2", "G", None), (1, "a/2", "A", None), (2, "a/2", "AA", None), (3, "c/2", "C", "I")]
    lost = second.filter("rid <> 2")
    assert [tuple(r) for r in reorder.mates_missing(first, lost).collect()] == [(2, "a")]
    assert reorder.reorder_mates(first, lost, unmatched="drop").count() == 3
    with pytest.raises(Exception, match="no mate for a"):
        reorder.reorder_mates(first, lost).collect()
    with pytest.raises(Exception, match="fewer than two"):
        reorder.reorder_mates(spark.createDataFrame([(0, "x")], "rid long, name string"), second).collect()
    assert reorder.reorder_mates(first, second, suffix="slash_digit").count() == 4


def test_no_partition_dependence(spark):
    _, _, b, s = tables(spark, random.Random(5))
    want = sorted(map(str, reorder.reorder_by_sequence(b.coalesce(1), s.coalesce(1)).collect()))
    assert sorted(map(str, reorder.reorder_by_sequence(b.repartition(9), s.repartition(8)).collect())) == want


@pytest.mark.parametrize("reads", [3, 64, 1 << 20])
def test_chunks_of_reads_of_any_length(spark, reads):
    """A chunk ends with the read that brings its bases to the bound; empty reads are none."""
    rng = random.Random(reads)
    rows = [(i * 2, "A" * rng.choice([0, 1, 5, 30, 90])) for i in range(300)]
    source = spark.createDataFrame(rows, "sid long, seq string").repartition(4)
    for most in (1, 40, 100, 10**9):
        want, held = [], most
        for sid, seq in rows:
            if seq:
                if held >= most:
                    want.append(sid)
                    held = 0
                held += len(seq)
        starts = reorder.chunk_starts(source, most, reads)
        assert starts == want
        assert reorder.chunk_starts(source, most, reads, 50) == want
        found = {r.sid: r.c for r in reorder.with_chunks(source, starts, "c").collect()}
        assert all(found[sid] == sum(x <= sid for x in want[1:]) for sid, _ in rows)
    assert reorder.chunk_starts(source.limit(0)) == []


def test_chunks_take_few_jobs(spark):
    """One pass over the lengths and one over the reads near the marks, however many chunks."""
    rng = random.Random(2)
    rows = [(i, "A" * rng.randint(50, 150)) for i in range(4000)]
    source = spark.createDataFrame(rows, "sid long, seq string").repartition(4)
    group = f"chunks-{rng.random()}"
    spark.sparkContext.setJobGroup(group, "chunks")
    starts = reorder.chunk_starts(source, 1000, 64)
    few = set(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("", "")
    assert len(starts) > 350 and len(few) < 12


def test_small_chunks_take_few_jobs(spark):
    """The number of jobs doesn't grow with that of chunks: ranges of reads are walked through by themselves."""
    rng = random.Random(6)
    rows = [(i, "A" * rng.randint(5, 15)) for i in range(4000)]
    source = spark.createDataFrame(rows, "sid long, seq string").repartition(4)
    group = f"small-chunks-{rng.random()}"
    spark.sparkContext.setJobGroup(group, "chunks")
    starts = reorder.chunk_starts(source, 40, 256, 1000)
    few = set(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("", "")
    want, held = [], 40
    for sid, seq in rows:
        if held >= 40:
            want.append(sid)
            held = 0
        held += len(seq)
    assert starts == want and len(starts) > 800 and len(few) < 12


def test_odd_chunks_one_by_one(spark):
    rng = random.Random(9)
    seqs = ["ACGT" * n for n in (1, 3, 8)]
    bare = [(i, rng.choice(seqs)) for i in range(200)]
    source = [(i, f"s{i}", None, rng.choice(seqs), None) for i in range(200)]
    s = spark.createDataFrame(source, "sid long, name string, comment string, seq string, qual string").repartition(3)
    starts = reorder.chunk_starts(s, 300, 16)
    out = reorder.reorder_by_sequence(spark.createDataFrame(bare, "rid long, seq string"), reorder.with_chunks(s, starts), chunk=F.col("chunk"))
    assert sorted((r.rid, r.name, r.comment, r.qual) for r in out.collect()) == sorted(one_by_one(bare, source, "lifo", lambda i: sum(x <= i for x in starts[1:])))


def test_strict_alphabet_and_empty_reads(spark):
    bare = spark.createDataFrame([(0, "ACGTN"), (1, "acgt"), (2, ""), (3, None)], "rid long, seq string")
    source = spark.createDataFrame([(0, "a", None, "ACGTN", None), (1, "b", None, "", None)], "sid long, name string, comment string, seq string, qual string")
    assert tuple(reorder.empty_reads(bare, source).first()) == (2, 1)
    assert tuple(reorder.empty_reads(bare.limit(0), source.limit(0)).first()) == (0, 0)
    assert reorder.reorder_by_sequence(bare, source).count() == 2
    with pytest.raises(Exception, match="none of A, C, G, N, T"):
        reorder.reorder_by_sequence(bare, source, strict_alphabet=True).collect()
    assert reorder.reorder_by_sequence(bare.filter("rid <> 1"), source, strict_alphabet=True).count() == 1


def test_large_keys_are_found(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i}") for i in range(600)] + [(1000 + i, None) for i in range(300)], "id long, key string")
    assert reorder.frequent(rows, "key", 100) == ["hot"]
    assert reorder.frequent(rows, "key", 250) == [] and reorder.frequent(rows.limit(0), "key", 1) == []


@pytest.mark.parametrize("slice_", [50, reorder.SLICE])
def test_both_sides_are_shuffled_once(spark, slice_):
    """Rows are numbered and matched after a shuffle by key alone; null keys match none."""
    first = spark.createDataFrame([(i, None if i % 5 == 0 else "hot" if i % 2 else f"k{i % 9}") for i in range(300)], "rid long, key string")
    second = spark.createDataFrame([(i, None if i % 7 == 0 else "hot" if i % 3 else f"k{i % 9}") for i in range(250)], "sid long, key string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = reorder.multiset_join(first, second, "key", F.col("rid"), -F.col("sid"), slice_=slice_)
        plan = out._jdf.queryExecution().executedPlan().toString()
        rows = sorted(tuple(r) for r in out.select("rid", "key", "sid").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    waiting = {}
    for sid, key in second.sort("sid").collect():
        waiting.setdefault(key, []).append(sid)
    assert rows == [(rid, key, waiting[key].pop() if key and waiting.get(key) else None) for rid, key in first.sort("rid").collect()]
    assert slice_ == 50 or plan.count("Exchange hashpartitioning") == 1
