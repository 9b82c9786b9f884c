"""Operator 10: quality classifier from random-indexing vectors and a two-layer network.

Every token, and every token's shape (letter and digit runs squeezed to one sign),
has a sparse random index vector derived from a hash. A token's context vector is
the sum of the index vectors around it in the sample; a document's features are
the mean context vector of its tokens and the mean of its shapes, the share of
tokens equal to the one before, and the share of distinct tokens. A network of
two layers in numpy gives a logit; a temperature fitted on held-back rows of the
sample turns it into a probability.

Learning takes a bounded sample: up to `SAMPLE` labelled texts, by a hash of the
key, which stay on the executors. The model has up to `TOKENS` tokens (the most
frequent; the others count by their shapes) and `SHAPES` shapes, so it may be
broadcast. Scoring reads every whole text in one map.

Defined results: a null or word-less text has features of zeros and gets the
score of those; a token outside the model counts by its shape; without labels
every score is 0.5, and with one kind of label it is that label's; labels that
are null aren't learned, and of a key with several labels or texts the least are;
texts of any length are read whole; rows with equal or null keys are scored each;
other columns are ignored or, in `keep`, kept; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.llm.common import bounded_rows, small_batches, worker_cache, written

#: Labelled texts to learn from; tokens and shapes in the model; numbers in a vector and non-zero ones in an index vector; neighbours on each side; hidden units.
SAMPLE, TOKENS, SHAPES, WIDTH, NONZERO, AROUND, HIDDEN = 5000, 20_000, 4000, 64, 6, 2, 24
#: Score from which a text passes.
LEAST = 0.3
#: Features beside the vectors: repeats, distinct tokens, length.
EXTRA = 3
#: Tokens that a Python worker remembers, and the longest of them.
REMEMBERED, REMEMBERED_LENGTH = 150_000, 120
#: Tokens whose neighbours are summed in one go.
AT_ONCE = 1 << 19

_RUNS = re.compile(r"(?P<A>[A-ZÀ-ÖØ-Þ]+)|(?P<a>[a-zß-öø-ÿ]+)|(?P<n>[0-9]+)|(?P<w>[^\W\d_]+)|(?P<s>(.)\6*)", re.DOTALL)


def shape(token: str) -> str:
    """The token with each run of capitals, small letters, digits or other letters as one sign, and a run of one mark as that mark, twice."""
    return _RUNS.sub(lambda m: m.lastgroup if m.lastgroup in ("A", "a", "n", "w") else m[0][0] * min(len(m[0]), 2), token)


def index_vectors(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each token's non-zero numbers, from a hash of the token."""
    raw = np.frombuffer(b"".join(hashlib.blake2b(t.encode(), digest_size=2 * NONZERO).digest() for t in tokens), "<u2").reshape(len(tokens), NONZERO)
    return (raw >> 1) % WIDTH, (raw & 1).astype(np.float64) * 2 - 1


class Contexts:
    """Running sums of the context vectors of numbered tokens; sums of whole numbers, so alike in any order of the documents."""

    def __init__(self, tokens: list[str]) -> None:
        self.place, self.sign = index_vectors(tokens)
        self.sums = np.zeros(len(tokens) * WIDTH)
        self.held: list[int] = []

    def add(self, doc: list[int]) -> None:
        """A document as numbers of its tokens, -1 for one outside the model."""
        self.held += doc
        self.held += [-1] * AROUND
        if len(self.held) > AT_ONCE:
            self._sum()

    def _sum(self) -> None:
        ids, self.held = np.array(self.held, np.int64), []
        for step in range(-AROUND, AROUND + 1):
            near = np.roll(ids, step)
            both = (ids >= 0) & (near >= 0)
            a, b = ids[both], near[both]
            for k in range(NONZERO):
                self.sums += np.bincount(a * WIDTH + self.place[b, k], weights=self.sign[b, k], minlength=len(self.sums))

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that had neighbours, and their sums."""
        self._sum()
        out = self.sums.reshape(-1, WIDTH).astype(np.int64)
        at = np.flatnonzero(out.any(axis=1))
        return at, out[at]


def unit_vectors(n: int, at: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The sums of `n` tokens scaled to length one, and a row of zeros for all other tokens."""
    out = np.zeros((n + 1, WIDTH))
    out[at] = sums
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


@dataclass
class Model:
    tokens: dict[str, int]
    shapes: dict[str, int]
    token_vectors: np.ndarray
    shape_vectors: np.ndarray
    layers: tuple[np.ndarray, ...] | None
    temperature: float
    constant: float

    def __post_init__(self) -> None:
        self.seen: dict[str, int] = {}

    def _place(self, token: str) -> int:
        """A token's row and its shape's, as one number; the last row of each is for all others."""
        t, s = self.tokens.get(token, len(self.tokens)), self.shapes.get(shape(token), len(self.shapes))
        if len(token) <= REMEMBERED_LENGTH:
            if len(self.seen) > REMEMBERED:
                self.seen.clear()
            self.seen[token] = t << 32 | s
        return t << 32 | s

    def features(self, text: str | None) -> np.ndarray:
        tokens = text.split() if text else []
        sums = np.zeros(2 * WIDTH + EXTRA)
        seen, place = self.seen.get, self._place
        for i in range(0, len(tokens), 16_384):
            at = np.array([x if (x := seen(t)) is not None else place(t) for t in tokens[i : i + 16_384]], np.int64)
            sums[:WIDTH] += self.token_vectors[at >> 32].sum(axis=0, dtype=np.float64)
            sums[WIDTH : 2 * WIDTH] += self.shape_vectors[at & 0xFFFFFFFF].sum(axis=0, dtype=np.float64)
        n = max(1, len(tokens))
        sums[2 * WIDTH] = sum(map(eq, tokens, islice(tokens, 1, None)))
        sums[2 * WIDTH + 1] = len(set(tokens))
        sums /= n
        sums[2 * WIDTH + 2] = math.log1p(len(tokens)) / 10
        return sums

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.layers is None:
            return np.full(len(texts), self.constant)
        return sigmoid(logits(np.array([self.features(t) for t in texts]).reshape(-1, 2 * WIDTH + EXTRA), self.layers) / self.temperature)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logits(x: np.ndarray, layers: tuple[np.ndarray, ...]) -> np.ndarray:
    mean, spread, w1, b1, w2, b2 = layers
    return np.tanh((x - mean) / spread @ w1 + b1) @ w2 + b2[0]


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 400, rate: float = 0.02, decay: float = 1e-3) -> tuple[np.ndarray, ...]:
    """Full-batch Adam on the log loss."""
    rng = np.random.default_rng(0)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - mean) / spread
    weights = [rng.normal(0, 0.1, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for t in range(1, rounds + 1):
        hidden = np.tanh(z @ weights[0] + weights[1])
        error = (sigmoid(hidden @ weights[2] + weights[3][0]) - y) / len(y)
        back = np.outer(error, weights[2]) * (1 - hidden**2)
        slopes = [z.T @ back + decay * weights[0], back.sum(axis=0), hidden.T @ error + decay * weights[2], np.array([error.sum()])]
        for i, g in enumerate(slopes):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            weights[i] -= rate * first[i] / (1 - 0.9**t) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return mean, spread, *weights


def fit(x: np.ndarray, y: np.ndarray) -> tuple[tuple[np.ndarray, ...], float]:
    """The network's layers from features and labels in a fixed order, and the temperature that suits every fifth row best, which the network doesn't see."""
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[~held])) < 2:
        held[:] = False
    layers, temperature = _fit(x[~held], y[~held]), 1.0
    if held.any():
        raw, options = logits(x[held], layers), np.geomspace(0.5, 8, 41)
        losses = [-np.mean(np.log(np.maximum(np.where(y[held] > 0, p, 1 - p), 1e-12))) for t in options for p in [sigmoid(raw / t)]]
        temperature = float(options[int(np.argmin(losses))])
    return layers, temperature


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens (kind 0) and shapes (kind 1) of texts, counted."""
    for batch in batches:
        tokens = Counter(t for value in batch.column(0) for t in value.as_py().split())
        shapes: Counter[str] = Counter()
        for t, n in tokens.items():
            shapes[shape(t)] += n
        yield pa.RecordBatch.from_arrays([pa.array([0] * len(tokens) + [1] * len(shapes), pa.int32()), pa.array([*tokens, *shapes], pa.string()), pa.array([*tokens.values(), *shapes.values()], pa.int64())], ["kind", "token", "n"])


def _marked(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int) -> DataFrame:
    """`place` (a hash of the key), `name`, `y` and `text` of up to `sample` labelled keys; of a key's labels and texts the least."""
    marked = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).filter("y in (0, 1) and key is not null").groupBy("key").agg(F.min("y").alias("y"))
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("key is not null")
    place = F.xxhash64(F.lit("quality"), "key")
    picked = texts.select("key").distinct().join(marked, "key").orderBy(place, "key").limit(sample)
    rows = bounded_rows(texts, picked, "key").filter("text is not null").groupBy("key").agg(F.min("y").alias("y"), F.min("text").alias("text"))
    return rows.select(place.alias("place"), F.col("key").cast("string").alias("name"), "y", "text")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from up to `sample` rows of `docs` that `labels` marks 0 or 1.

    Texts stay on the executors: the driver gets the model's tokens, its vectors and the sample's features, all of bounded size.
    """
    spark = docs.sparkSession
    rows = written(small_batches(_marked(docs, labels, key, text, label, sample)), "quality-sample")
    kinds = [r.y for r in rows.select("y").distinct().collect()]
    if len(kinds) < 2:
        return Model({}, {}, np.zeros((1, WIDTH)), np.zeros((1, WIDTH)), None, 1.0, float(kinds[0]) if kinds else 0.5)
    counted = written(rows.select("text").mapInArrow(_counts, "kind int, token string, n long").groupBy("kind", "token").agg(F.sum("n").alias("n")), "quality-counts")
    kept = [counted.filter(f).orderBy(F.desc("n"), "token").limit(most) for f, most in (("kind = 0 and n > 2", TOKENS), ("kind = 1", SHAPES))]
    names = [k.select("token").toArrow().column(0).to_pylist() for k in kept]
    known = spark.sparkContext.broadcast(names)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, shapes = ({t: i for i, t in enumerate(x)} for x in known.value)
        sums = [Contexts(x) for x in known.value]
        for batch in batches:
            for value in batch.column(0):
                split = value.as_py().split()
                sums[0].add([tokens.get(t, -1) for t in split])
                sums[1].add([shapes.get(shape(t), -1) for t in split])
        for kind, x in enumerate(sums):
            at, totals = x.rows()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at), *map(pa.array, totals.T)], ["kind", "at", *places])

    # whole numbers, so each task gives its sums, a row a token of the model at most, and Spark adds them up
    places = [f"c{i}" for i in range(WIDTH)]
    parts = rows.select("text").mapInArrow(contexts, ", ".join(["kind int", "at long", *(f"{c} long" for c in places)]))
    sums = parts.groupBy("kind", "at").agg(*[F.sum(c).alias(c) for c in places]).toArrow()
    kind, at, *columns = (c.to_numpy() for c in sums.columns)
    totals = np.stack(columns, axis=1)
    vectors = [unit_vectors(len(x), at[kind == i], totals[kind == i]) for i, x in enumerate(names)]
    model = Model({t: i for i, t in enumerate(names[0])}, {t: i for i, t in enumerate(names[1])}, *vectors, None, 1.0, 0.5)
    shared = spark.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([shared.value.features(t.as_py()).tobytes() for t in batch.column(3)], pa.binary())], ["place", "name", "y", "x"])

    learned = rows.mapInArrow(features, "place long, name string, y int, x binary").toArrow().sort_by([("place", "ascending"), ("name", "ascending")])  # `sample` rows at most
    x = np.frombuffer(b"".join(learned.column("x").to_pylist())).reshape(-1, 2 * WIDTH + EXTRA)
    layers, temperature = fit(x, learned.column("y").to_numpy().astype(float))
    return replace(model, layers=layers, temperature=temperature)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and `score` of every row; one map, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("quality")
        made = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(made.scores(some.column(1).to_pylist()), pa.float64())], [key, "score"])

    return small_batches(docs).select(key, text).mapInArrow(work, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")


def keep(docs: DataFrame, model: Model, least: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that score `least` or more, with all their columns; one map, no join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("quality")
        made = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                some = batch.slice(i, 1024)
                yield some.filter(pa.array(made.scores(some.column(at).to_pylist()) >= least))

    return small_batches(docs).mapInArrow(work, docs.schema)
