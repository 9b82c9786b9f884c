"""Every stage of the pipeline and every operator on tables with clashing columns, odd keys, nulls, repeated and very long rows, and on empty ones."""

import random
import zlib

import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from seqframe.llm import bpe, common, decontaminate, language, licenses, linededup, quality, simhash, token_store, topk, urls
from seqframe.llm.queries import URL_RULES, held_out, tokenizer_path

SF = "/root/testdata/sf0.001"
#: Names that the operators use for columns of their own.
NAMES = "row key h1 h2 _d _h1 _h2 kept names fresh line place first last fp n n_hit hits _hits _words _spans _items _gone _doc _n a b node component value start paragraph family url tokens verdict mined host path rule query shard score rank y x lang_pred".split()


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "north", "stone", "river", "cloud", "light"]) + str(rng.randint(0, 30)) for _ in range(n))


def odd_rows():
    rng = random.Random(11)
    base = [words(rng, 60) + "\n" + words(rng, 25) for _ in range(12)]
    rows = [(f"{i:03d}", t) for i, t in enumerate(base)]
    rows += [("020", base[0]), ("021", base[1].replace("alpha", "Alpha")), (None, base[2]), (None, words(rng, 70)), (None, words(rng, 70)), ("005", words(rng, 80)), ("005", base[5]), ("030", None), ("031", ""), ("032", " \n\n"), ("033", words(rng, 30_000))]
    return rows


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame([(k, t, "en", "s", 0) for k, t in odd_rows()], "doc_id string, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def crowded(plain):
    return plain.select("*", *[F.lit(7).alias(x) for x in NAMES])


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_stages(spark, plain, crowded, name, stage):
    want, found = stage(spark, plain, SF), stage(spark, crowded, SF)
    assert stage(spark, crowded.limit(0), SF).count() == 0
    if name == "tokens":
        rows = [sorted((str(r.doc_id), r.n_tokens, r.ids_sha256) for r in df.collect()) for df in (want, found)]
        assert rows[0] == rows[1] and len(rows[0]) == plain.count()
    else:
        assert [(f.name, f.dataType) for f in found.schema] == [(f.name, f.dataType) for f in crowded.schema]
        assert texts(found) == texts(want)
        assert {tuple(r) for r in found.select(*[f"`{x}`" for x in NAMES]).distinct().collect()} <= {(7,) * len(NAMES)}


def test_near_duplicates_among_null_and_repeated_keys(spark, plain):
    """The first row of each group stays; null keys come last; a key's other text isn't lost with its copy."""
    kept = texts(cp.near_duplicate_stage(spark, plain, SF))
    rows = odd_rows()
    gone = [("020", rows[0][1]), ("021", rows[13][1]), (None, rows[2][1])]
    assert kept == sorted([r for r in rows if r not in gone], key=str) and rows[5] in kept


def test_texts_without_words_stay(spark):
    rows = [(None, None), (None, None), (1, ""), (2, "  "), (3, "\n"), (4, "a text of some words"), (5, "a text of some words"), (6, "\u00a0")]
    kept = texts(cp.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF))
    assert kept == sorted([r for r in rows if r[0] != 5], key=str)


def test_samples_of_repeated_keys_are_bounded(spark, monkeypatch):
    """A key that 3,000 rows have is one document of the sample."""
    docs = spark.range(3020).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).cast("long").alias("doc_id"), F.concat(F.lit("word"), F.pmod("id", F.lit(3))).alias("text"), F.lit("en").alias("lang"))
    ids = common.stratified_ids(docs.select("doc_id", "lang"), "doc_id", "lang", language.EACH, "language")
    assert ids.count() == 21 and language.one_text_each(common.bounded_rows(docs.withColumnRenamed("doc_id", "key"), ids.withColumnRenamed("doc_id", "key"), "key", "lang")).count() == 21
    counts = language.train(docs)
    found = {(r["lang"], r["token"]): r["n"] for r in counts.filter(pc.equal(counts.column("size"), 0)).to_pylist()}
    assert sum(found.values()) == 21 and max(r["total"] for r in counts.to_pylist() if r["size"] == 0) == 21
    two = docs.unionByName(docs.limit(5).withColumn("lang", F.lit("de")))
    assert common.bounded_rows(two, common.stratified_ids(two.select("doc_id", "lang"), "doc_id", "lang", 5, "x"), "doc_id", "lang").select("doc_id", "lang").distinct().groupBy("lang").count().filter("count > 5").count() == 0


def test_held_out_of_null_keys(spark):
    """Rows without a key are held out of nothing."""
    rows = spark.createDataFrame([(None,), (1,), (7,)], "doc_id long").select("doc_id", held_out(4, 2)).collect()
    assert [r.held_out for r in rows] == [False, zlib.crc32(b"1") % 4 == 2, zlib.crc32(b"7") % 4 == 2]


def test_fingerprints_of_rows_without_a_key_link(spark, monkeypatch):
    prints = {"a": 0, "b": 0b111, "c": 0b111111, "d": 1 << 40, "e": 0b11 << 60}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *a, **k: docs.select("doc_id", F.lit(0).cast("long").alias("h1"), F.hash("text").alias("h2"), F.create_map(*[F.lit(x) for p in prints.items() for x in p])[F.col("text")].cast("long").alias("fp")))
    docs = spark.createDataFrame([(2, "c"), (None, "b"), (1, "a"), (None, "d"), (None, "e")], "doc_id long, text string")
    rows = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert rows[1, 0] == rows[None, 0b111] == rows[2, 0b111111] == 1 and rows[None, 1 << 40] == 1
    assert rows[None, 0b11 << 60] == 1  # two bits from zero
    alone = simhash.near_duplicates(docs.filter("text = 'e'")).collect()
    assert [(r.doc_id, r.component_id) for r in alone] == [(None, None)]


def test_operators_on_crowded_and_empty_tables(spark, plain, crowded):
    labels = spark.createDataFrame([(f"{i:03d}", i % 2, 3) for i in range(20)], "doc_id string, quality int, y int")
    items = spark.createDataFrame([(1, odd_rows()[3][1], 3)], "item_id int, text string, _hits int")
    counts, scanner, model = language.train(plain), licenses.train(plain), quality.train(plain, labels)

    def all_of(docs):
        yield bpe.round_trip(docs, tokenizer_path("byte_bpe_50k.json"), columns=("n_tokens", "ids_sha256"))
        yield licenses.scan(docs, scanner)
        yield simhash.near_duplicates(docs)
        yield language.predict(docs, counts)
        yield linededup.report(linededup.decide(docs))
        yield decontaminate.digests(decontaminate.find(docs, items))
        yield quality.score(docs, model)

    for a, b in zip(all_of(plain), all_of(crowded), strict=True):
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert all(x.count() == 0 for x in all_of(crowded.limit(0)))
    numbers = crowded.select(F.monotonically_increasing_id().alias("doc_id"), *[c for c in crowded.columns if c != "doc_id"])
    path = token_store.write_store(numbers, tokenizer_path("word_bpe_49k.json"), 2)
    assert token_store.read_digests(spark, path).count() == plain.count()
    pages = spark.createDataFrame([(1, "http://a.com/en/"), (None, "http://b.net/x"), (1, None), (2, "http://c.org/" + "y/" * 50_000)], "page_id long, url string")
    found = [sorted(map(str, urls.judge(p, URL_RULES).collect())) for p in (pages, pages.select("*", *[F.lit(7).alias(x) for x in NAMES if x != "url"]))]
    assert found[0] == found[1] and len(found[0]) == 4
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "vec_id long, embedding array<double>")
    lists = [sorted(map(tuple, topk.search(v, F.col("vec_id") % 20 == 0, 3).collect())) for v in (vectors, vectors.select("*", *[F.lit(7).alias(x) for x in NAMES]))]
    assert lists[0] == lists[1] and len(lists[0]) == 6


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_folder(Session())


def test_samples_of_very_large_groups(spark):
    """Places times sizes leave 64 bits where a group has 2^34 rows; that many are claimed here."""

    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit("en").alias("g"))
    assert common.stratified_ids(rows, "k", "g", 50, "x").count() == 50
    claimed = spark.createDataFrame([("en", 1 << 40)], "g string, _size long")
    assert common.stratified_ids(rows, "k", "g", 50, "x", claimed).count() == 0
