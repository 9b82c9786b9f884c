import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqframe.llm import language, quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_held_out_languages(spark, docs):
    fold = language.fold("doc_id", 4)
    model = language.train(docs.filter(fold != 2))
    rows = language.predict(docs.filter(fold == 2), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 100 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def test_backoff_by_hand():
    rows = [("a", 0, "known", 3, 10), ("b", 0, "known", 1, 10), ("a", 2, "ab", 1, 4), ("b", 2, "ab", 3, 4), ("b", 1, "z", 1, 2)]
    model = language.Model(language.tables(pa.table([list(x) for x in zip(*rows, strict=True)], schema=language.COUNTS)))
    assert model.word("known").tolist() == pytest.approx([math.log(3 / 11), math.log(1 / 11)])
    assert model.word("xaby").tolist() == pytest.approx([math.log(1 / 5), math.log(3 / 5)])  # no longer n-gram is known
    assert model.word("z").tolist() == pytest.approx([-20.0, math.log(1 / 3)])
    assert model.word("q").tolist() == [0, 0]
    assert model.predict("Known known!")[0] == "a" and model.predict("xaby")[0] == "b"
    assert model.predict(None) == model.predict("") == model.predict("12 _ ?! ²") == (language.UNKNOWN, 0.0)
    assert language.Model(language.tables(language.COUNTS.empty_table())).predict("text") == (language.UNKNOWN, 0.0)


def test_language_edges(spark, docs):
    rows = [(1, None, "en", 1.0), (None, "", None, 1.0), (3, "the and " * 20_000, "en", 1.0), (3, "the and", "en", 1.0), (5, "und der", "de", 1.0)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = language.train(odd)
    assert [(r.doc_id, r.lang_pred) for r in language.predict(odd, model).collect()] == [(1, "und"), (None, "und"), (3, "en"), (3, "en"), (5, "de")]
    none = language.train(odd.limit(0))
    assert none.num_rows == 0 and language.predict(odd.limit(0), model).count() == 0
    assert {r.lang_pred for r in language.predict(odd, none).collect()} == {"und"}


def test_held_out_quality(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    fold = language.fold("doc_id", 5)
    model = quality.train(docs.filter(fold != 0), labels)
    rows = quality.score(docs.filter(fold == 0), model).join(labels, "doc_id").collect()
    right = sum((r.score >= quality.LEAST) == (r.quality == 1) for r in rows) / len(rows)
    assert len(rows) > 50 and right > 0.95 and all(0 <= r.score <= 1 for r in rows)
    kept = quality.keep(docs, model, quality.LEAST)
    assert kept.schema == docs.schema
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {k for k, s in scores.items() if s >= quality.LEAST}


def test_quality_edges(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["good", "plain", "words"]) if i % 2 else "BAD!!" for _ in range(20))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "unseen Tokens " * 20_000), (102, "BAD!! BAD!!"), (None, "x")]
    odd = spark.createDataFrame([(*r, 2.0) for r in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(100, 1), (7, None), (9, 1), (None, 1)], "doc_id long, quality int")
    model = quality.train(odd, labels)
    found = [(r.doc_id, r.score) for r in quality.score(odd, model).collect()]
    assert len(found) == len(rows) and all(0 <= s <= 1 for _, s in found)
    assert all((s >= 0.5) == bool(i % 2) for i, s in found[:60])
    assert found[63][1] < 0.5
    assert {r.score for r in quality.score(odd, quality.train(odd, labels.limit(0))).collect()} == {0.5}
    assert {r.score for r in quality.score(odd, quality.train(odd, labels.filter("quality = 1"))).collect()} == {1.0}
    assert quality.score(odd.limit(0), model).count() == 0


def test_shapes():
    assert [quality.shape(t) for t in ("Word", "LOUD!!!", "a1b22", "x$$$", "É.", "中文", "")] == ["Aa", "A!!", "anan", "a$$", "A.", "w", ""]


TINY = "/root/testdata/sf0.001"


def plain_language(labelled, texts):
    """Language and score of each text by counting and backing off without Spark or numpy."""
    counts = {}
    for lang, text in labelled:
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            counts.setdefault((lang, 0), Counter())[w] += 1
            m = f"<{w}>"
            for n in range(1, language.LONGEST + 1):
                for i in range(len(m) - n + 1):
                    counts.setdefault((lang, n), Counter())[m[i : i + n]] += 1
    langs = sorted({lang for lang, _ in labelled})
    totals = {k: sum(c.values()) for k, c in counts.items()}
    kept = {k: dict(sorted(c.items(), key=lambda x: (-x[1], x[0]))[: language.KEPT]) for k, c in counts.items()}

    def logs(n, token):
        if not any(token in kept.get((lang, n), {}) for lang in langs):
            return None
        return [math.log(kept[lang, n][token] / (totals[lang, n] + 1)) if token in kept[lang, n] else math.log(0.5 / (totals[lang, n] + 1)) for lang in langs]

    known = {}

    def word(w):
        if w not in known:
            known[w] = logs(0, w) or [0.0] * len(langs)
            if logs(0, w) is None:
                m = f"<{w}>"
                for n in range(min(language.LONGEST, len(m)), 0, -1):
                    parts = [x for i in range(len(m) - n + 1) if (x := logs(n, m[i : i + n]))]
                    if parts:
                        known[w] = [sum(p) / len(parts) for p in zip(*parts, strict=True)]
                        break
        return known[w]

    for text in texts:
        found = re.findall(r"[^\W\d_]+", (text or "").lower())
        if not any(c.isalpha() for w in found for c in w):
            yield "und", 0.0
            continue
        sums = [sum(x) for x in zip(*map(word, found), strict=True)]
        best = max(range(len(langs)), key=lambda i: (sums[i], -i))
        yield langs[best], 1 / sum(math.exp((s - sums[best]) / math.sqrt(len(found))) for s in sums)


def test_language_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, None, None), (-2, "12 !", "en"), (-3, "wordunseen Überall " * 300, None), (-4, "zq", None)], "doc_id long, text string, lang string")
    docs = docs.unionByName(odd)
    fold = language.fold("doc_id", 4)
    rows = docs.withColumn("fold", fold).collect()
    want = list(plain_language([(r.lang, r.text) for r in rows if r.fold != 2 and r.lang and r.text], [r.text for r in rows]))
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, language.train(docs.filter(fold != 2))).collect()}
    for r, (lang, score) in zip(rows, want, strict=True):
        assert found[r.doc_id][0] == lang and found[r.doc_id][1] == pytest.approx(score, abs=1e-9), r.doc_id


def plain_quality(marked, texts):
    """Scores by vectors that are made with dictionaries; only the network's fit is the operator's."""
    split = [t.split() for _, t in marked]
    counts = Counter(t for d in split for t in d)
    shape_counts = Counter(quality.shape(t) for d in split for t in d)
    tokens = [t for t, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if n > 2][: quality.TOKENS]
    shapes = [s for s, _ in sorted(shape_counts.items(), key=lambda x: (-x[1], x[0]))[: quality.SHAPES]]

    def vectors(names, docs):
        place, sign = quality.index_vectors(names)
        index = {t: list(zip(p, s, strict=True)) for t, p, s in zip(names, place.tolist(), sign.tolist(), strict=True)}
        out = {t: [0.0] * quality.WIDTH for t in names}
        for d in docs:
            for i, t in enumerate(d):
                if t in out:
                    for other in d[max(0, i - quality.AROUND) : i + quality.AROUND + 1]:
                        for p, s in index.get(other, ()):
                            out[t][p] += s
        return {t: np.array(v) / max(1e-9, math.sqrt(sum(x * x for x in v))) for t, v in out.items()}

    near, near_shapes = vectors(tokens, split), vectors(shapes, [[quality.shape(t) for t in d] for d in split])
    zero = np.zeros(quality.WIDTH)

    def features(text):
        d = (text or "").split()
        n = max(1, len(d))
        return np.concatenate([sum((near.get(t, zero) for t in d), zero) / n, sum((near_shapes.get(quality.shape(t), zero) for t in d), zero) / n, [sum(a == b for a, b in zip(d, d[1:], strict=False)) / n, len(set(d)) / n, math.log1p(len(d)) / 10]])

    layers, temperature = quality.fit(np.array([features(t) for _, t in marked]), np.array([float(y) for y, _ in marked]))
    return [float(quality.sigmoid(quality.logits(features(t)[None], layers) / temperature)[0]) for t in texts]


def test_quality_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "abc!!! " * 2000)], "doc_id long, text string"))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{TINY}/labels.parquet").collect()}
    rows = docs.withColumn("fold", language.fold("doc_id", 5)).withColumn("place", F.xxhash64(F.lit("quality"), "doc_id")).collect()
    marked = sorted((r.place, str(r.doc_id), labels[r.doc_id], r.text) for r in rows if r.fold != 0 and r.doc_id in labels and r.text is not None)
    want = plain_quality([(y, t) for _, _, y, t in marked], [r.text for r in rows])
    model = quality.train(docs.filter(language.fold("doc_id", 5) != 0), spark.read.parquet(f"{TINY}/labels.parquet"))
    found = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert all(found[r.doc_id] == pytest.approx(s, abs=1e-3) for r, s in zip(rows, want, strict=True)) and len(set(want)) > 50


def test_context_sums_add_up():
    """Sums of parts of the documents add up to those of all, whatever the parts."""
    rng = np.random.default_rng(0)
    names = [f"t{i}" for i in range(30)]
    docs = [rng.integers(-1, 25, n).tolist() for n in (0, 1, 2, 5, 40, 300)]

    def sums(some):
        made = quality.Contexts(names)
        for d in some:
            made.add(d)
        at, rows = made.rows()
        out = np.zeros((len(names), quality.WIDTH), np.int64)
        out[at] = rows
        return out

    whole = sums(docs)
    assert whole.any() and (whole == sums(docs[:4]) + sums(docs[4:])).all() and (whole == sum(sums([d]) for d in docs)).all()
    vectors = quality.unit_vectors(30, np.arange(30), whole)
    assert vectors.shape == (31, quality.WIDTH) and not vectors[-1].any()


def test_quality_model_is_the_same_on_other_partitions(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    one, other = quality.train(docs.coalesce(1), labels), quality.train(docs.repartition(7), labels.repartition(3))
    assert one.tokens == other.tokens and (one.token_vectors == other.token_vectors).all() and all((a == b).all() for a, b in zip(one.layers, other.layers, strict=True))
