"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqframe.llm import bpe, decontaminate, language, licenses, linededup, packing, quality, runs, simhash, token_store, topk, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), columns=("n_tokens", "ids_sha256", "decoded_sha256"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write_store(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)
    return token_store.read_digests(spark, path)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.train(docs))


def simhash_digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_digests(simhash.near_duplicates(_table(spark, sf_dir, "documents")))


#: The given URL rules, a fixed list: verdict, host and start of the path.
URL_RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def held_out(parts: int, remainder: int) -> Column:
    """Whether a document is kept apart from learning; one without an id is not, and can't be learned from either."""
    return F.coalesce(language.fold("doc_id", parts) == remainder, F.lit(False)).alias("held_out")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.train(docs.filter(language.fold("doc_id", 4) != 2))
    return language.predict(docs, model).select("doc_id", held_out(4, 2), "lang_pred", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(linededup.decide(_table(spark, sf_dir, "documents")))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs.filter(language.fold("doc_id", 5) != 0), _table(spark, sf_dir, "labels"))
    predicted = (F.col("score") >= quality.LEAST).cast("int").alias("predicted")
    return quality.score(docs, model).select("doc_id", held_out(5, 0), "score", predicted)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def runs_digests(docs: DataFrame) -> DataFrame:
    """Runs of the documents, one in ten of which is made to repeat."""
    planted = docs.select("doc_id", runs.with_repeats(F.col("doc_id"), F.col("text")).alias("text"))
    return runs.find(planted, keep=["doc_id"], columns=("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_digests(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_codec": op1_bpe_codec,
    "op2_token_store": op2_token_store,
    "op3_licenses": op3_licenses,
    "op4_simhash": op4_simhash,
    "op5_urls": op5_urls,
    "op6_language": op6_language,
    "op7_topk": op7_topk,
    "op8_lines": op8_lines,
    "op9_decontaminate": op9_decontaminate,
    "op10_quality": op10_quality,
    "op11_packing": op11_packing,
    "op12_runs": op12_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op7_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as q
            from embeddings
            where embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), scored as (
            select a.vec_id as query_id, b.vec_id as vec_id, cast(list_inner_product(a.q, b.q) as bigint) as score
            from v a join v b on a.vec_id <> b.vec_id
            where a.vec_id % 20 = 0
        ), ranked as (
            select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored
        )
        select query_id, rank, vec_id, score from ranked where rank <= 20
    """,
    "op9_decontaminate": r"""
        with dw as (
            select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
            from documents
        ), iw as (
            select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
            from benchmark
        ), win as (
            select distinct item, least(len(w), 10) as n, list_slice(w, i, i + 9) as v
            from (select item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from iw where len(w) > 0)
        ), pos as (
            select r, w, unnest(range(1, len(w) + 1)) as p from dw
        ), occ as (
            select c.r, c.p, c.n, win.item
            from (select r, p, n, list_slice(w, p, p + n - 1) as v from pos cross join (select distinct n from win)) c
            join win on win.n = c.n and win.v = c.v
        ), hit as (
            select r, count(distinct h) as n_hit from (select r, unnest(range(p, p + n)) as h from occ) group by r
        ), found as (
            select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from occ) group by r
        )
        select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from dw left join hit using (r) left join found using (r)
    """,
}
