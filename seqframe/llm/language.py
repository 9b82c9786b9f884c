"""Operator 6: language identification by word-first backoff.

A word known from training scores by its log frequency in each language. Another
word is cut into the longest character n-grams of which the model knows any, then
shorter ones: those known score by their log frequency, and the word gets their
mean. A text's language is the one with the largest sum over its words.

Training counts words and n-grams of a bounded sample: up to `EACH` labelled
texts a language, taken by a hash of the key; the model keeps up to `KEPT` words
and as many n-grams of each length a language, so its size is bounded too and it
is broadcast. Everything is counted on the executors.

Defined results: a null text or one without letters is `und` with score 0; so is
every text if no row has a label; equal sums go to the language first in
alphabetical order; a null label is not learned; other columns are ignored; an
empty table gives none.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqframe.llm.common import bounded_rows, small_batches, stratified_ids, worker_cache, written

#: Texts a language to learn from; words, and n-grams of a length, that the model keeps a language; longest n-gram.
EACH, KEPT, LONGEST = 800, 20_000, 5
#: Tasks, at most, that count the sample.
TASKS = 64
#: Unseen words that a Python worker remembers, and the longest of them.
REMEMBERED, REMEMBERED_LENGTH = 200_000, 120
UNKNOWN = "und"

_WORDS = re.compile(r"[^\W\d_]+").findall


def words(text: str | None) -> list[str]:
    return _WORDS(text.lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _rows(found: Counter[tuple[str, int, str]]) -> pa.RecordBatch:
    keys = list(found)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array(list(found.values()), pa.int64())],
        ["lang", "size", "token", "n"],
    )


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter[tuple[str, int, str]] = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for word, n in Counter(words(text)).items():
                found[lang, 0, word] += n
        yield _rows(found)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of counted words."""
    for batch in batches:
        found: Counter[tuple[str, int, str]] = Counter()
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for size in range(1, LONGEST + 1):
                for g in grams(word, size):
                    found[lang, size, g] += n
        yield _rows(found)


#: What training gives: for each language, n-gram length (0 for words) and token its count, and all counts of that length in the language.
COUNTS = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("token", pa.string()), ("n", pa.int64()), ("total", pa.int64())])


def one_text_each(sample: DataFrame) -> DataFrame:
    """One of the texts of each key and language, the least, so that a repeated key has the weight of one document."""
    return sample.groupBy("key", "lang").agg(F.min("text").alias("text"))


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> pa.Table:
    """A table of `COUNTS`, of up to `KEPT` tokens a language and length."""
    known = labelled.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).cast("string").alias("lang")).filter("lang is not null and text is not null")
    sample = one_text_each(bounded_rows(known, stratified_ids(known, "key", "lang", EACH, "language"), "key", "lang"))
    kind = "lang string, size int, token string, n long"
    tasks = max(1, min(TASKS, labelled.sparkSession.sparkContext.defaultParallelism))  # the sample is bounded, and may come in few partitions
    counted = small_batches(sample).select("lang", "text").repartition(tasks).mapInArrow(_word_counts, kind).groupBy("lang", "size", "token").agg(F.sum("n").alias("n"))
    counted = written(counted, "language-words")
    pieces = counted.select("lang", "token", "n").repartition(tasks).mapInArrow(_gram_counts, kind).groupBy("lang", "size", "token").agg(F.sum("n").alias("n"))
    counted = counted.unionByName(written(pieces, "language-grams"))
    totals = counted.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    place = F.row_number().over(Window.partitionBy("lang", "size").orderBy(F.desc("n"), "token"))
    kept = counted.withColumn("nth", place).filter(F.col("nth") <= KEPT).drop("nth")
    return kept.join(F.broadcast(totals), ["lang", "size"]).select("lang", "size", "token", "n", "total").toArrow().cast(COUNTS)


#: Languages in alphabetical order and, for each length, tokens and a matrix of their log frequencies by language.
Tables = tuple[list[str], list[tuple[list[str], np.ndarray]]]


def tables(counts: pa.Table) -> Tables:
    """Log frequencies of `COUNTS`; a token that a language doesn't have gets less than its rarest one there, and -20 where the language has none of that length."""
    langs = sorted(set(counts.column("lang").to_pylist()))
    out = []
    for size in range(LONGEST + 1):
        some = counts.filter(pc.equal(counts.column("size"), size))
        lang = np.array([langs.index(x) for x in some.column("lang").to_pylist()], np.int64)
        tokens = some.column("token").combine_chunks().dictionary_encode()
        n, total = some.column("n").to_numpy(), some.column("total").to_numpy()
        matrix = np.full((len(tokens.dictionary), len(langs)), -20.0)
        present, first = np.unique(lang, return_index=True)
        matrix[:, present] = np.log(0.5 / (total[first] + 1))
        matrix[tokens.indices.to_numpy(), lang] = np.log(n / (total + 1))
        out.append((tokens.dictionary.to_pylist(), matrix))
    return langs, out


class Model:
    """Log frequencies, with the rows of unseen words that were met beside those of the known ones."""

    def __init__(self, found: Tables) -> None:
        self.langs, every = found
        self.matrix = np.concatenate([matrix for _, matrix in every])
        first = np.cumsum([0, *(len(tokens) for tokens, _ in every)]).tolist()
        #: Rows of words and, by their length, of n-grams.
        self.places = [{t: at + i for i, t in enumerate(tokens)} for at, (tokens, _) in zip(first, every, strict=False)]
        self.known = len(every[0][0])
        self.rows = np.concatenate([every[0][1], np.zeros((1024, len(self.langs)))])
        self.at: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.at, self.used = dict(self.places[0]), self.known

    def parts(self, word: str) -> list[int]:
        """The rows that a word's log frequencies are the mean of: its own, or those of its longest n-grams of which any is known."""
        if (found := self.places[0].get(word)) is not None:
            return [found]
        for size in range(min(LONGEST, len(word) + 2), 0, -1):
            get = self.places[size].get
            if known := [x for g in grams(word, size) if (x := get(g)) is not None]:
                return known
        return []

    def word(self, word: str) -> np.ndarray:
        return self.matrix[self.parts(word)].mean(axis=0) if self.parts(word) else np.zeros(len(self.langs))

    def _learn(self, new: list[str]) -> None:
        """Rows for words that have none yet."""
        parts = list(map(self.parts, new))
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        while self.used + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((len(self.rows) // 2, len(self.langs)))])
        own = self.rows[self.used : self.used + len(new)]
        own[:] = 0
        some = counts > 0
        if some.any():
            flat = [x for p in parts for x in p]
            own[some] = np.add.reduceat(self.matrix[flat], (np.cumsum(counts) - counts)[some]) / counts[some][:, None]
        self.at.update(zip(new, range(self.used, self.used + len(new)), strict=True))
        self.used += len(new)

    def predict(self, text: str | None) -> tuple[str, float]:
        found = words(text)
        if not self.langs or not (any(map(str.isalpha, found)) or any(c.isalpha() for w in found for c in w)):
            return UNKNOWN, 0.0
        total = np.zeros(len(self.langs))
        for i in range(0, len(found), 4096):
            if self.used > self.known + REMEMBERED:
                self._forget()
            at = list(map(self.at.get, some := found[i : i + 4096]))
            if None in at:
                new = list({w for w, x in zip(some, at, strict=True) if x is None})
                self._learn(new)
                at = list(map(self.at.get, some))
                for w in new:
                    if len(w) > REMEMBERED_LENGTH:
                        del self.at[w]
            total += self.rows[at].sum(axis=0)
        best = int(np.argmax(total))
        share = np.exp((total - total[best]) / math.sqrt(len(found)))
        return self.langs[best], float(1 / share.sum())


def _model(token: str, shared: Broadcast) -> Model:
    """One model, with what it remembers, for all tasks of a Python worker."""
    made = worker_cache("language")
    if token not in made:
        made.clear()
        made[token] = Model(shared.value)
    return made[token]


def predict(docs: DataFrame, counts: pa.Table, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `lang_pred` and `score` (0 to 1) of every row; one map, no shuffle."""
    shared, token = docs.sparkSession.sparkContext.broadcast(tables(counts)), uuid.uuid4().hex

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _model(token, shared)
        for batch in batches:
            found = [made.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [key, "lang_pred", "score"])

    return small_batches(docs).select(key, text).mapInArrow(work, f"`{key}` {docs.schema[key].dataType.simpleString()}, lang_pred string, score double")


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo `parts`."""
    return F.crc32(F.col(key).cast("string")) % parts
