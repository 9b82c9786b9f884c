"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the
columns of `documents`, whatever others there are beside doc_id and text.

Defined results: a document with a null or empty text stays in stages 2 to 4 (its
quality is scored as that of no words); null and repeated doc_ids are documents of
their own, but repeated rows (equal in doc_id and text) stay or go together; texts
are read whole, however long; equal values are broken by doc_id; columns named like
those that a stage makes for itself don't clash; empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqframe.llm import alike, bpe, decontaminate, language, linededup, quality, simhash
from seqframe.llm.common import written
from seqframe.llm.queries import tokenizer_path


def _counted(docs: DataFrame) -> DataFrame:
    """`docs` with `n_chars`, if it has such a column, as the texts are now."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier passes; it learns as in its own query, from the folds that aren't held out."""
    model = quality.train(docs.filter(language.fold("doc_id", 5) != 0), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, model, quality.LEAST)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one (or the same one, before) has alike; one that had lines and loses all goes, as a copy."""
    return _counted(linededup.deduplicate(docs, drop_emptied=True))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates: five-word SimHash within three bits, then five-word Jaccard similarity of 0.8.

    Three bits are far less than documents of similarity 0.8 differ in, hence the second step over what the first leaves.
    """
    return alike.first_of_similar(written(simhash.first_of_each(docs, shingle=5), "simhash-kept"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their benchmark passages; one of which nothing else remains goes."""
    cleaned = decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), hits=None)
    return _counted(cleaned)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, their number and digest, and the digest of the text decoded from them."""
    return bpe.round_trip(docs, tokenizer_path("byte_bpe_50k.json"), columns=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

#: Trained scores, MinHash and BPE have no SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
