"""Operator 11: documents' ids packed into as few sequences of a fixed capacity as can be, with certificates.

1. *Pieces.* Whole texts are encoded, the end id appended; only longer ones are cut, at
   the capacity. A piece of just the capacity is a sequence of its own. From here on
   rows are numbers only: no ids and no texts travel.
2. *Best fit decreasing* in partitions of `ITEMS` pieces at most, dealt evenly by
   their place in the written table, so no key or source weighs on one partition.
3. *Certificates.* A dual feasible function u gives every length a weight such that
   lengths that fit together never weigh more than u(capacity); so no packing has
   fewer bins than the total weight over u(capacity), rounded up. A partition whose
   number of bins is the greatest such bound over a family of functions is certified.
4. *Exchange.* By one function, the best for all pieces together, each bin has a waste
   u(capacity) - u(bin). A certified partition settles its bins of least waste, as
   long as all partitions' settled waste, over all rounds, stays below one bin: so
   settled bins together are as few as can be by that function. A partition with a gap
   settles only bins without waste. The pieces of all other bins meet in new
   partitions, where best fit decreasing runs again, until the rest's bins are as
   few as its bound, or it is one partition, or nothing is gained any more.

Every round writes its rows to the shared folder, so a lost executor costs a task,
and later rounds only have what earlier ones left over. The driver gets counts by
length (a row a length at most) and sums of a round.

Defined results: a null text is empty (the end id alone); null and repeated doc_ids
and repeated rows are documents of their own; texts of any length are encoded whole;
other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import logging
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.llm.common import new_folder, slices, small_batches, written
from seqframe.llm.token_store import _encoder

log = logging.getLogger(__name__)

#: Pieces of a partition at most, and rounds of exchange.
ITEMS, ROUNDS = 1 << 13, 6
#: Texts encoded in one call, and bytes of them.
TEXTS, BYTES = 256, 2 << 20
#: How many functions of each of the two families with a table of their own.
FAMILY = 48

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id`, `piece`, `start`, `length`, `ids_crc32` of every piece of every document; no shuffle."""
    with open(tokenizer, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, width = _encoder(shared.value), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in slices(batches, 1, BYTES):
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                out: list[tuple[int | None, int, int, int, int]] = []
                for doc, raw in zip(some.column(0).to_pylist(), encoder.encode_many([t or "" for t in some.column(1).to_pylist()]), strict=True):
                    raw += end
                    for k, i in enumerate(range(0, len(raw), width)):
                        part = raw[i : i + width]
                        out.append((doc, k, i // 4, len(part) // 4, zlib.crc32(part)))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return small_batches(docs).select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`").cast("string")).mapInArrow(work, PIECE)


@cache
def _tables(capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (a row a function, a column a length) and u(capacity) of each, in whole numbers.

    First each length itself; then the rounding functions of Fekete and Schepers for k = 1, 2, ...; then their step functions for the
    least lengths capacity / 2, capacity / 3, ...
    """
    x = np.arange(capacity + 1, dtype=np.int64)
    rows, tops = [x], [capacity]
    for k in range(1, FAMILY + 1):
        whole = (k + 1) * x % capacity == 0
        rows.append(np.where(whole, k * x, (k + 1) * x // capacity * capacity))
        tops.append(k * capacity)
    for k in range(2, min(FAMILY, capacity) + 2):
        least = max(1, capacity // k)
        top = capacity // least
        rows.append(np.where(2 * x > capacity, top - (capacity - x) // least, (x >= least).astype(np.int64)))
        tops.append(top)
    return np.stack(rows), np.array(tops, np.int64)


def _cut_off(least: int, capacity: int) -> np.ndarray:
    """Martello and Toth's function: shorter than `least` weighs nothing, longer than `capacity - least` a whole bin, all else itself."""
    x = np.arange(capacity + 1, dtype=np.int64)
    return np.where(x > capacity - least, capacity, np.where(x < least, 0, x))


def bound(counts: np.ndarray) -> tuple[int, np.ndarray, int]:
    """The fewest bins that any packing of these pieces can have by all functions tried, and the best function with its u(capacity).

    `counts[x]` pieces have length x; the capacity is the greatest length of the array.
    """
    capacity, counts = len(counts) - 1, counts.astype(np.int64)
    weights, tops = _tables(capacity)
    bins = -(-(weights @ counts) // tops)
    k = int(np.argmax(bins))
    most, table, top = int(bins[k]), weights[k], int(tops[k])
    x = np.arange(capacity + 1, dtype=np.int64)
    volume, number = np.concatenate([[0], np.cumsum(counts * x)]), np.concatenate([[0], np.cumsum(counts)])
    least = np.arange(1, capacity // 2 + 1)
    cut = -(-(volume[capacity - least + 1] - volume[least] + capacity * (number[-1] - number[capacity - least + 1])) // capacity)
    if len(cut) and int(cut.max()) > most:
        at = int(np.argmax(cut))
        return int(cut[at]), _cut_off(int(least[at]), capacity), capacity
    return most, table, top


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, longest first into the fullest bin that has room, and the number of bins.

    Bins lie on stacks by their room; the rooms that have a bin are the bits of one whole number, so the next larger one is found at once.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, made = 0, 0
    order = np.argsort(-lengths, kind="stable")
    for at, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, made
            made += 1
        bins[at], offsets[at] = b, capacity - room
        if room > n:
            stacks[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins, offsets, made


def settle(lengths: np.ndarray, bins: np.ndarray, made: int, table: np.ndarray, top: int, allowed: int) -> np.ndarray:
    """Which bins stay as they are: those of least waste by the function `table`, together `allowed` at most."""
    waste = np.full(made, top, np.int64)
    np.subtract.at(waste, bins, table[lengths])
    order = np.argsort(waste, kind="stable")
    out = np.zeros(made, bool)
    out[order] = np.cumsum(waste[order]) <= allowed
    return out


@dataclass
class Certificate:
    """How many sequences there are, and how many any packing of these pieces must have."""

    sequences: int
    at_least: int
    rounds: int
    released: list[int]


def _counts(rows: DataFrame, capacity: int) -> np.ndarray:
    found = rows.groupBy("length").count().toArrow()  # a row a length
    out = np.zeros(capacity + 1, np.int64)
    out[found.column("length").to_numpy()] = found.column("count").to_numpy()
    return out


_ROUND = PIECE + ", sequence_id long, offset long, settled boolean, bins long, at_least long, open_bins long"


def _packed(pool: DataFrame, round_: int, parts: int, capacity: int, table: np.ndarray, top: int) -> DataFrame:
    """One round: the pool dealt to `parts` partitions and packed in each. A partition's first row has its number of bins, its bound and its bins that aren't settled."""
    last, allowed = parts == 1, (top - 1) // (parts << round_ + 1)

    def work(rows: pa.Table) -> pa.Table:
        lengths = rows.column("length").to_numpy()
        bins, offsets, made = best_fit(lengths, capacity)
        least, _, _ = bound(np.bincount(lengths, minlength=capacity + 1))
        done = np.ones(made, bool) if last else settle(lengths, bins, made, table, top, allowed if made == least else 0)
        bucket = rows.column("bucket")[0].as_py()
        told = [pa.array([x] + [None] * (len(lengths) - 1), pa.int64()) for x in (made, least, int((~done).sum()))]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        number = pa.array((round_ << 56) + (bucket << 20) + bins, pa.int64())
        return pa.table([*(rows.column(c) for c in names), number, pa.array(offsets), pa.array(done[bins]), *told], names=[f.split()[0] for f in _ROUND.split(", ")])

    dealt = pool.withColumn("bucket", F.pmod(F.monotonically_increasing_id(), F.lit(parts)))
    return dealt.groupBy("bucket").applyInArrow(work, _ROUND)


def pack(found: DataFrame, capacity: int = 4096, items: int = ITEMS, rounds: int = ROUNDS) -> tuple[DataFrame, Certificate]:
    """Pieces (columns of `PIECE`) with `sequence_id` and `offset`, and what the packing is held against.

    `found` is read several times: a table that is written, whose rows come in the same order each time.
    """
    spark = found.sparkSession
    every = _counts(found, capacity)
    full = int(every[capacity])
    every[capacity] = 0
    least, table, top = bound(every)
    out = [found.filter(F.col("length") == capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    pool, left, total, released, before = found.filter(F.col("length") < capacity), int(every.sum()), full, [], None
    round_ = 0
    while left:
        parts = -(-left // items)
        folder = new_folder(spark, "packed")
        _packed(pool, round_, parts, capacity, table, top).write.partitionBy("settled").option("compression", "zstd").parquet(folder)
        made = spark.read.schema(_ROUND).parquet(folder)
        sums = made.agg(F.sum("bins").alias("bins"), F.sum("open_bins").alias("open")).first()
        settled, rest = made.filter("settled").select(*found.columns, "sequence_id", "offset"), made.filter("not settled")
        out.append(settled)
        total += sums.bins - sums.open
        counts = _counts(rest, capacity)
        left = int(counts.sum())
        released.append(left)
        round_ += 1
        stuck = before is not None and left >= before  # an exchange that left as many pieces over
        if left and (sums.open == bound(counts)[0] or round_ == rounds or stuck):
            out.append(rest.select(*found.columns, "sequence_id", "offset"))
            total += sums.open
            break
        pool, before = rest.select(*found.columns), left
    certificate = Certificate(total, full + least, round_, released)
    log.info("packed into %d sequences, no fewer than %d can hold them; pieces left over by round: %s", total, certificate.at_least, released)
    united = out[0]
    for x in out[1:]:
        united = united.unionByName(x)
    return united, certificate


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece of every document with its place: `doc_id`, `piece`, `start`, `length`, `ids_crc32`, `sequence_id`, `offset`."""
    return pack(written(pieces(docs, tokenizer, end_id, capacity, key, text), "pieces"), capacity)[0]
