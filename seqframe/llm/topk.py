"""Operator 7: exact top-k search by tiled matrix products.

Vectors are scaled and floored to integers. Queries are cut into blocks that weigh
`BLOCK_BYTES` about (vectors and best lists), candidates into shards. Each pass
broadcasts one block and streams every shard past it, so a candidate is never sent
for a query: it is dealt to its shard once, and if there are several passes, shards
are written then and only read by each. A task multiplies the block with a few
candidates at a time, keeps each query's best by partial selection among those that
reach its last kept score, and the lists of a query are merged in a tree, `FAN`
shards at a time. The lists of a pass are written before the next, and its block is
given up, so driver and executors hold one block at a time however many there are.

Products are exact: doubles are used where no sum can leave the 53 bits that
they hold, integers of 64 bits otherwise, and Python's integers beyond.

Defined results: vectors that are null or hold a null or non-finite component
take no part, nor do rows with a null id; vectors of unequal lengths are compared as if the shorter ended in
zeros; ties go to the smaller id; every row that is a query has a list of its own, of all rows but itself: rows that
repeat its id, or the whole row, are candidates like any other, and repeated queries have as many equal lists; a score beyond 64 bits becomes the
nearest long; other columns are ignored, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqframe.llm.common import new_folder, written

#: Bytes of a block of queries, about, with `LISTED` a kept candidate and `HELD` more a query; rows of a shard, at least and at most about; shards for each core, if there are enough rows; shards whose lists meet in one merge; products made at once; lists that one task repeats for equal queries.
BLOCK_BYTES, LISTED, HELD, LEAST, SHARD, TILES, FAN, AT_ONCE, COPIES = 48 << 20, 32, 200, 4096, 1 << 20, 2, 16, 1 << 22, 10_000

_LONG = (-(1 << 63), (1 << 63) - 1)


def quantize(vectors: DataFrame, scale: float, key: str, vector: str) -> DataFrame:
    """`id` and `v` (binary: little-endian doubles holding the integers floor(scale * x)) of the vectors that take part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, packed = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = np.floor(v.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                if np.isfinite(x).all():
                    ids.append(i)
                    packed.append(x.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], ["id", "v"])

    return vectors.select(F.col(key).cast("long"), vector).mapInArrow(work, "id long, v binary")


def _matrix(rows: list[bytes], width: int) -> np.ndarray:
    """The first `width` numbers of each row; shorter ones end in zeros."""
    if width and all(len(r) == 8 * width for r in rows):
        return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), width)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        x = np.frombuffer(r, "<f8")[:width]
        out[i, : len(x)] = x
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of `a` and `b`, as 64-bit integers (the nearest where they don't fit)."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most < 2**62 and max(np.abs(a).max(), np.abs(b).max()) < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
    return np.clip(exact, *_LONG).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best of one query: partial selection by score, then by the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, equal = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        room = k - len(above)
        if len(equal) > room:
            equal = equal[np.argpartition(ids[equal], room - 1)[:room]] if room else equal[:0]
        found = np.concatenate([above, equal])
    else:
        found = np.arange(len(scores))
    return found[np.lexsort((ids[found], -scores[found].astype(object) if (scores[found] == _LONG[0]).any() else -scores[found]))]


def _squares(a: np.ndarray) -> np.ndarray:
    """Each row's exact product with itself."""
    if np.abs(a).max(initial=0) ** 2 * max(1, a.shape[1]) < 2**53:
        return (a * a).sum(axis=1).astype(np.int64)
    return np.array([products(a[i : i + 1], a[i : i + 1])[0, 0] for i in range(len(a))], np.int64)


class _Queries:
    """Queries of like lengths (up to the same power of two), and the best candidates seen so far of each.

    What a candidate has beyond their longest vector meets zeros only, so it is left out.
    """

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, copies: np.ndarray, rows: list[bytes], k: int) -> None:
        self.numbers, self.ids, self.copies, self.k = numbers, ids, copies, k
        self.width = max(map(len, rows)) // 8
        self.matrix = _matrix(rows, self.width)
        self.own = _squares(self.matrix)
        self.kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(rows)
        self.at_least = np.full(len(rows), _LONG[0])

    def compare(self, ids: np.ndarray, rows: list[bytes]) -> None:
        width = min(self.width, max(map(len, rows)) // 8)
        step = max(1, AT_ONCE // max(len(self.ids), width))
        for at in range(0, len(rows), step):
            self._some(ids[at : at + step], _matrix(rows[at : at + step], width))

    def _some(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        scores = products(self.matrix[:, : matrix.shape[1]], matrix)
        for i in np.flatnonzero((scores >= self.at_least[:, None]).any(axis=1)).tolist():
            some = np.flatnonzero(scores[i] >= self.at_least[i])
            found = np.concatenate([self.kept[i][1], scores[i, some]])
            some_ids = np.concatenate([self.kept[i][0], ids[some]])
            top = best(found, some_ids, self.k)
            self.kept[i] = some_ids[top], found[top]
            if len(top) == self.k:
                self.at_least[i] = found[top[-1]]

    def lists(self) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.ids), 4096):
            sizes = [len(ids) for ids, _ in self.kept[i : i + 4096]]
            at = np.repeat(np.arange(i, i + len(sizes)), sizes)
            vec, score = (np.concatenate([kept[c] for kept in self.kept[i : i + 4096]]) for c in (0, 1))
            own = (vec == self.ids[at]) & (score == self.own[at])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (self.numbers[at], self.ids[at], self.copies[at], vec, score, own)], ["query", "query_id", "copies", "vec_id", "score", "own"])


def _against(block: Broadcast, k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidates are multiplied with the block as they come; the k best of each query are given at the end."""
        *names, rows = block.value
        alike: dict[int, list[int]] = {}
        for i, row in enumerate(rows):
            alike.setdefault((len(row) // 8).bit_length(), []).append(i)
        groups = [_Queries(*(x[some] for x in names), [rows[i] for i in some], k) for some in alike.values()]
        for batch in batches:
            if batch.num_rows:
                others, vectors = batch.column(0).to_numpy(), batch.column(1).to_pylist()
                for group in groups:
                    group.compare(others, vectors)
        shard = TaskContext.get().partitionId()
        for group in groups:
            for lists in group.lists():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(lists.num_rows, shard, np.int32)), *lists.columns], ["shard", *lists.schema.names])

    return work


def _numbered(rows: DataFrame, *by: str) -> DataFrame:
    order = Window.partitionBy("query", *by).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order))


def _merged(lists: DataFrame, k: int, shards: int) -> DataFrame:
    """The k best of each query of all shards' lists, with their `rank`."""
    while shards > FAN:
        shards = -(-shards // FAN)
        lists = _numbered(lists.withColumn("shard", F.pmod("shard", F.lit(shards))), "shard").filter(F.col("rank") <= k).drop("rank")
    return _numbered(lists).filter(F.col("rank") <= k)


def shard_count(candidates: int, cores: int, least: int = LEAST, shard: int = SHARD) -> int:
    """How many shards of candidates there are."""
    return max(1, -(-candidates // shard), min(TILES * cores, -(-candidates // least)))


def _block(queries: DataFrame, blocks: int, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Numbers, ids, copies and vectors of one block of queries; about `BLOCK_BYTES`, as distinct queries are dealt by hash (one longer query stays whole)."""
    some = queries.filter(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == number) if blocks > 1 else queries
    table = some.select("id", "copies", "v").toArrow()
    return (number << 32) + np.arange(table.num_rows), table.column("id").to_numpy(), table.column("copies").to_numpy(), table.column("v").to_pylist()


def _repeated(ranked: DataFrame, most: int) -> DataFrame:
    """Each row `copies` times, `most` at most; more than `COPIES` of one row are made by several tasks."""
    def upto(least: Column) -> Column:
        return F.explode(F.sequence(F.lit(1).cast("long"), least))

    pieces = ranked.withColumn("piece", upto(F.ceil(F.col("copies") / COPIES)))
    if most > COPIES:
        pieces = pieces.repartition("query", "piece")
    return pieces.withColumn("copy", upto(F.least(F.lit(COPIES).cast("long"), F.col("copies") - (F.col("piece") - 1) * COPIES)))


def search(vectors: DataFrame, is_query: Column, k: int, scale: float = 64, key: str = "vec_id", vector: str = "embedding", block_bytes: int = BLOCK_BYTES, least: int = LEAST, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the k best inner products of every row that `is_query` (a condition on `key`) holds for with all other rows."""
    spark = vectors.sparkSession
    asked = quantize(vectors.filter(is_query), scale, key, vector).groupBy("id", "v").agg(F.count("*").alias("copies"))
    queries = written(asked, "topk-queries")
    weight, most = queries.agg(F.sum(F.length("v") + F.lit(HELD + LISTED * (k + 1))), F.max("copies")).first()
    blocks = max(1, -(-(weight or 0) // block_bytes))
    shards = shard_count(vectors.count(), spark.sparkContext.defaultParallelism, least, shard)
    candidates = quantize(vectors, scale, key, vector).repartition(shards)
    if blocks > 1:
        candidates = written(candidates, "topk-candidates")
    folder = new_folder(spark, "topk-lists")
    # one place more than asked: a query's own row is among the best of all rows, or beyond them
    for number in range(blocks):
        shared = spark.sparkContext.broadcast(_block(queries, blocks, number))
        found = candidates.mapInArrow(_against(shared, k + 1), "shard int, query long, query_id long, copies long, vec_id long, score long, own boolean")
        lists = _merged(found.withColumn("shard", F.pmod("shard", F.lit(shards))), k + 1, shards)
        if blocks > 1:
            lists.write.parquet(f"{folder}/block={number}")
            shared.destroy()
    if blocks > 1:
        lists = spark.read.schema(lists.schema).parquet(folder)
    one = Window.partitionBy("query")
    itself = F.min(F.when(F.col("own"), F.col("rank"))).over(one)
    others = lists.withColumn("itself", itself).filter("itself is null or rank <> itself")
    ranked = others.withColumn("rank", F.when(F.col("rank") > F.col("itself"), F.col("rank") - 1).otherwise(F.col("rank"))).filter(F.col("rank") <= k)
    if most and most > 1:
        ranked = _repeated(ranked, most)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
