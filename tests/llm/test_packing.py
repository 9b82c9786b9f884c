"""Operator 11: its bounds against exhaustive packing, its pieces against the library, its packing against its rules."""

import functools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from seqframe.llm import packing, queries


@functools.cache
def fewest(lengths, capacity):
    """The least number of bins, by trying all ways; `lengths` sorted, longest first."""

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= lengths[k]:
                i = rooms.index(room)
                place(k + 1, (*rooms[:i], room - lengths[k], *rooms[i + 1 :]))
        place(k + 1, (*rooms, capacity - lengths[k]))

    best = len(lengths) + 1
    place(0, ())
    return best


@pytest.mark.parametrize("capacity", [7, 12, 30])
def test_bounds_never_pass_the_best_packing(capacity):
    rng = random.Random(capacity)
    tight = 0
    for _ in range(150):
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = np.bincount(lengths, minlength=capacity + 1)
        least, table, top = packing.bound(counts)
        best = fewest(tuple(lengths), capacity)
        bins, offsets, made = packing.best_fit(np.array(lengths), capacity)
        assert least <= best <= made
        assert least == -(-int(table @ counts) // top)
        tight += least == best
    assert tight > 120


def test_functions_are_dual_feasible():
    """No lengths that fit together weigh more than the capacity."""
    rng = random.Random(1)
    for capacity in (10, 64):
        weights, tops = packing._tables(capacity)
        every = [(w, int(t)) for w, t in zip(weights, tops, strict=True)] + [(packing._cut_off(e, capacity), capacity) for e in range(1, capacity // 2 + 1)]
        for _ in range(800):
            room, some = capacity, []
            while room:
                some.append(rng.randint(1, room if rng.random() < 0.5 else min(room, 1 + capacity // 6)))
                room -= some[-1]
                if rng.random() < 0.1:
                    break
            assert all(sum(int(w[x]) for x in some) <= t for w, t in every)


def test_big_pieces_are_certified_by_other_functions():
    """Pieces over half the capacity: a bin each, which the volume alone doesn't tell."""
    counts = np.bincount([3000] * 10 + [1200] * 3, minlength=4097)
    assert packing.bound(counts)[0] == 11 and -(-(3000 * 10 + 3600) // 4096) == 9


def held(rows, capacity=4096):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("items", [40, 100_000])
def test_pack(spark, items, tmp_path):
    rng = random.Random(items)
    rows = [(rng.choice([None, 1, i]), 0, 0, rng.choice([4096, rng.randint(1, 4095), rng.randint(1, 900)]), i) for i in range(700)]
    spark.createDataFrame(rows, packing.PIECE).repartition(7).write.parquet(f"file://{tmp_path}/p")
    packed, certificate = packing.pack(spark.read.parquet(f"file://{tmp_path}/p"), items=items)
    got = packed.collect()
    assert sorted(tuple(r)[:5] for r in ((x.doc_id or -1, x.piece, x.start, x.length, x.ids_crc32) for x in got)) == sorted((d or -1, p, s, n, c) for d, p, s, n, c in rows)
    n = held(got)
    assert n == certificate.sequences and certificate.at_least <= n <= certificate.at_least + 1
    assert items > 1000 or certificate.rounds > 1


def test_pack_big_pieces_ends_at_once(spark, tmp_path):
    spark.createDataFrame([(i, 0, 0, 3000, i) for i in range(300)], packing.PIECE).write.parquet(f"file://{tmp_path}/p")
    packed, certificate = packing.pack(spark.read.parquet(f"file://{tmp_path}/p"), items=50)
    assert held(packed.collect()) == 300 == certificate.at_least and certificate.rounds == 1


def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    made.no_truncation()
    made.no_padding()
    return made


def plain_pieces(rows, capacity=4096):
    made, out = library(), []
    for doc_id, text in rows:
        ids = [*made.encode(text or "", add_special_tokens=False).ids, 1]
        for k, i in enumerate(range(0, len(ids), capacity)):
            part = ids[i : i + capacity]
            out.append((doc_id, k, i, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def test_odd_rows(spark):
    rows = [(1, None), (None, ""), (None, " \n"), (1, "a b"), (1, "a b"), (2, "word " * 4095), (3, "word " * 4096), (4, "word, " * 9000), (5, "é" * 50)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, Length string, sequence_id int")
    packed = packing.pack_documents(docs, queries.tokenizer_path("word_bpe_49k.json"), 1)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    got = packed.collect()
    held(got)
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(plain_pieces(rows), key=str)
    assert packing.pack_documents(docs.limit(0), queries.tokenizer_path("word_bpe_49k.json"), 1).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op11_packing(spark, sf).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    expected = plain_pieces(rows)
    assert sorted(tuple(r)[:5] for r in got) == sorted(expected)
    n, lengths = held(got), np.bincount([p[3] for p in expected], minlength=4097)
    assert n - packing.bound(lengths)[0] <= 1
