import hashlib
import random
import re

import numpy as np
import pytest

from seqframe.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items):
    """Windows held against every position of every document."""
    windows = {}
    for name, text in items:
        w = WORD.findall(lowered(text))
        for i in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(name))
    for key, text in docs:
        w, hit, found = WORD.findall(lowered(text)), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if names := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= names
        yield key, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def fixture(rng):
    few = ["the", "of", "Ünd", "a1", "été", "x", "Y", "zz"]
    items = [(i, " ".join(rng.choice(few) for _ in range(rng.choice([0, 2, 3, 9, 10, 11, 30])))) for i in range(20)] + [(2, "the of the"), (99, None)]
    docs = [(0, None), (1, ""), (2, "?!")]
    for k in range(3, 90):
        words = [rng.choice([*few, "other"]) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            words += (rng.choice(items)[1] or "").upper().split() + ["other"] * rng.randint(0, 1)
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(words)))
    docs += [(500, "the of the " * 3000), (501, docs[40][1]), (40, docs[41][1])]
    return docs, items


@pytest.mark.parametrize("per_pass", [dc.PASS_WINDOWS, 40])
def test_against_brute_force(spark, monkeypatch, per_pass):
    monkeypatch.setattr(dc, "PASS_WINDOWS", per_pass)
    docs, items = fixture(random.Random(7))
    rows = dc.digests(dc.find(spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, items int").repartition(3), spark.createDataFrame(items, "item_id long, text string")))
    assert sorted(tuple(r) for r in rows.collect()) == sorted(brute(docs, items))


def test_passes_hold_so_many_windows_each(spark, monkeypatch):
    """A long item is cut into parts that have all its windows once, and no pass has more windows than it may."""
    monkeypatch.setattr(dc, "PASS_WINDOWS", 7)
    texts = {"long": 43, "exact": 16, "short": 4, "one": 10, "none": 0}
    items = spark.createDataFrame([(name, " ".join(f"{name}{i}" for i in range(n))) for name, n in texts.items()], "item_id string, text string")
    groups = list(dc._passes(items, "item_id", "text"))
    assert all(sum(max(1, len(part) - dc.WINDOW + 1) for _, part in group) <= 7 for group in groups)
    windows = [(name, b" ".join(part[i : i + dc.WINDOW])) for group in groups for name, part in group for i in range(max(1, len(part) - dc.WINDOW + 1))]
    whole = [(name, " ".join(f"{name}{k}" for k in range(i, min(n, i + dc.WINDOW))).encode()) for name, n in texts.items() for i in range(max(1, n - dc.WINDOW + 1))]
    assert sorted(windows) == sorted(whole)


def test_an_item_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(dc, "PASS_WINDOWS", 7)
    rng = random.Random(3)
    item = [rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(60)]
    docs = [(1, "x y " + " ".join(item[12:35]) + " z"), (2, " ".join(item)), (3, " ".join(item[5:13])), (4, None), (5, " ".join(item[50:60] + item[0:10]))]
    items = [(1, " ".join(item)), (2, "x y"), (3, " ".join(item[20:33]))]
    rows = dc.digests(dc.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert sorted(tuple(r) for r in rows.collect()) == sorted(brute(docs, items))


def test_nothing_to_find(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in dc.digests(dc.find(docs, none)).collect()] == [(1, 3, 0, 0)]
    assert dc.find(docs.limit(0), none).count() == 0


def test_spans_are_removed(spark):
    passage = "One two three, four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"Before this. {passage.upper()}. After."), (2, "clean text")], "doc_id long, text string")
    rows = {r.doc_id: (r.text, r.n_hit) for r in dc.remove(docs, spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()}
    assert rows == {1: ("Before this. . After.", 11), 2: ("clean text", 0)}


def test_index_finds_what_stands_there():
    rng = np.random.default_rng(3)
    runs = [rng.integers(2, 5, n) for n in (5, 1, 40, 40, 13)] + [np.full(70, 3)]
    symbols = np.concatenate([np.append(r, 1) for r in runs])
    starts = np.cumsum([0] + [len(r) + 1 for r in runs[:-1]])
    index = dc.FMIndex(symbols, starts, 5)
    for n in (1, 2, 3, 6):
        for _ in range(60):
            pattern = rng.integers(2, 5, n)
            low, high = index.search(pattern[None])
            want = [i for i in range(len(symbols) - n + 1) if (symbols[i : i + n] == pattern).all()]
            assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want
