"""Operator 12 against its definition, tried at every stretch."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqframe.llm import queries, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """All (start, length, period), each period by one walk over the words; the smallest period of a stretch alone."""
    found = {}
    for q in range(1, len(words)):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            if end + q - i >= max(6, 4 * q):
                found.setdefault((i, end + q - i), q)
            i = end + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda x: (x[0], x[2]))


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    words = planted(doc_id, words) if doc_id is not None else words
    found = plain_runs(words)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    top = None
    for x in found:
        if top is None or x[1] * top[2] > top[1] * x[2]:
            top = x
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)

    def sha(t):
        return hashlib.sha256(t.encode()).hexdigest()

    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(found), *best, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(kept))


@pytest.mark.parametrize("seed", range(6))
def test_scan(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(60):
        words = []
        while len(words) < rng.choice([0, 3, 6, 40, 300]):
            unit = [rng.choice(b"abcd"[: rng.choice([1, 2, 4])].decode()) for _ in range(rng.choice([1, 2, 3, 5, 9]))]
            words += (unit * rng.choice([1, 2, 4, 5, 9]))[: rng.choice([None, -1, -2])]
        texts.append([w.encode() for w in words])
    for words, got in zip(texts, runs.scan(texts), strict=True):
        assert list(zip(*got, strict=True)) == plain_runs(words)


def test_names_tell_equal_words():
    words = np.array([0, 1, 0, 1, 2, 0, 1, 0, 1, 3])
    for k, level in enumerate(runs.named(words)):
        for i in range(len(words)):
            for j in range(len(words)):
                w = 1 << k
                same = i == j or max(i, j) + w <= len(words) and words[i : i + w].tolist() == words[j : j + w].tolist()
                assert (level[i] == level[j]) == same


def test_chunks_of_candidates(monkeypatch):
    monkeypatch.setattr(runs, "EXTENDED", 3)
    words = [b"a"] * 50 + [b"b", b"a"] * 30 + [b"c"] + [b"x", b"y", b"z"] * 8
    assert list(zip(*runs.scan([words])[0], strict=True)) == plain_runs(words)


def test_long_text():
    words = [b"a", b"b", b"c"] * 40_000 + [str(i).encode() for i in range(50_000)]
    assert runs.scan([words])[0] == ([0], [120_000], [3])


def test_odd_rows(spark):
    rows = [(1, None, "a"), (1, "", "b"), (1, "", "b"), (None, " \t\x0b\x0c\r\n ", "c"), (None, "x " * 7, "d"), (2, "é y\x1f " * 9 + "end", "e"), (3, "a a a a a", "f"), (10, "p q " * 9, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, START string")
    found = runs.find(docs, columns=("n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"))
    assert found.columns == ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"]
    got = sorted([(r.doc_id, r.n_words, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.collapsed) for r in found.collect()], key=str)
    assert got == sorted(
        [(1, 0, 0, None, None, None, None, "")] * 3
        + [(None, 0, 0, None, None, None, None, ""), (None, 7, 1, 0, 7, 1, 7000, "x"), (2, 10, 1, 0, 9, 1, 9000, "é y\x1f end"), (3, 5, 0, None, None, None, None, "a a a a a"), (10, 18, 1, 0, 18, 2, 9000, "p q")],
        key=str,
    )
    assert runs.find(docs.limit(0)).count() == 0
    by_query = queries.runs_digests(docs).collect()
    assert sorted(map(tuple, by_query), key=str) == sorted([plain_row(d, t) for d, t, _ in rows], key=str)


def test_query(spark):
    """All texts short enough for the plain way, which takes the square of a text's words."""
    sf = "/root/testdata/sf0.01"
    found = queries.op12_runs(spark, sf)
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {r.doc_id: tuple(r) for r in found.collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    short = docs.filter(F.length("text") < 6000).collect()
    assert len(got) == docs.count() and len(short) > 500 and all(got[r.doc_id] == plain_row(*r) for r in short)
