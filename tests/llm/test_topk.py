import math
import random

import pytest
from pyspark.sql import functions as F

from seqframe.llm import topk


def brute(rows, k):
    ints = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for at, (q, a) in enumerate(ints):
        if q % 5 == 0:
            clipped = [(max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b, strict=False)))), i) for n, (i, b) in enumerate(ints) if n != at]
            for r, (s, i) in enumerate(sorted((-s, i) for s, i in clipped)[:k], 1):
                yield q, r, i, -s


@pytest.mark.parametrize("block,shard", [(4096, 1 << 20), (9, 7), (13, 40), (30, 3)])
def test_against_brute_force(spark, block, shard):
    """A block of all queries, and blocks of about so many."""
    rng = random.Random(block)
    rows = [(i, [float(rng.randint(-3, 3)) / 4 for _ in range(6)]) for i in range(120)]
    rows += [(200, None), (201, [0.1, None] * 3), (205, [float("nan")] * 6), (206, [float("inf")] * 6), (210, rows[3][1]), (211, rows[3][1]), (215, []), (216, [2.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int").repartition(4)
    found = topk.search(df, F.col("vec_id") % 5 == 0, 9, block_bytes=block * (topk.HELD + 10 * topk.LISTED + 48), least=min(shard, 50), shard=shard)
    assert sorted(tuple(r) for r in found.collect()) == sorted(brute(rows, 9))


def test_large_numbers_are_exact(spark):
    rows = [(i, [x, -x, 1.0]) for i, x in enumerate([1e8, 3e9, 1e9, 2.5e8, 1e30, 7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.search(df, F.col("vec_id") % 5 == 0, 3)
    assert sorted(tuple(r) for r in found.collect()) == sorted(brute(rows, 3))


def test_few_rows(spark):
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert topk.search(one, F.col("vec_id") % 5 == 0, 3).count() == 0
    assert topk.search(one.limit(0), F.col("vec_id") % 5 == 0, 3).count() == 0


@pytest.mark.parametrize("block_bytes", [topk.BLOCK_BYTES, 400])
@pytest.mark.parametrize("k", [2, 6, 20])
def test_repeated_queries(spark, monkeypatch, k, block_bytes):
    """Each row is a query of its own, and the other rows of its id, equal ones too, are its candidates."""
    monkeypatch.setattr(topk, "COPIES", 2)
    vectors = [(5, [1.0, 0.0])] * 5 + [(5, [0.0, 1.0]), (10, [0.0, 0.0]), (10, [0.0, 0.0]), *((i, [i / 4, 3 - i / 4]) for i in (1, 2, 3, 7))]
    df = spark.createDataFrame([(*r, 1, 2) for r in [*vectors, (None, [9.0, 9.0])]], "vec_id long, embedding array<double>, query int, score int").repartition(3)
    found = topk.search(df, F.col("vec_id") % 5 == 0, k, block_bytes=block_bytes)
    assert sorted(tuple(r) for r in found.collect()) == sorted(brute(vectors, k))


def test_vectors_of_unequal_lengths(spark):
    """Vectors are grouped by their lengths; one long vector doesn't widen the others."""
    rng = random.Random(1)
    rows = [(i, [rng.randint(-9, 9) / 4 for _ in range(rng.choice([0, 1, 2, 3, 7, 8, 300]))]) for i in range(60)] + [(60, [0.5] * 20_000)]
    found = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 5 == 0, 4)
    assert sorted(tuple(r) for r in found.collect()) == sorted(brute(rows, 4))


def test_candidates_are_dealt_once(spark):
    """One shuffle of the vectors, none of them by query; the others bring lists together."""
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    plan = topk.search(df, F.col("vec_id") % 20 == 0, 20, least=50)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and plan.count("Exchange RoundRobinPartitioning") == 1


def test_shards_follow_the_counts():
    assert topk.shard_count(0, 8) == topk.shard_count(1000, 8) == 1
    assert topk.shard_count(50_000, 8) == 13
    assert topk.shard_count(1_000_000_000, 400) == -(-1_000_000_000 // topk.SHARD)
    assert topk.shard_count(1_000_000_000, 4000) == 8000
