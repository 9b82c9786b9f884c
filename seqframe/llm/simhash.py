"""Operator 4: SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint's 64 bits are three segments of 21, 21 and 22 bits, each a word of
the perfect (23,12) Golay code, whose decoder maps every word to the codeword at
most three bits away. Two segments that differ in one bit have different parity.
So a segment of even parity has one key, its own codeword, and one of odd parity
has those of all words one bit away and its own: two segments at distance one or
zero share a key.

At most three differing bits over three segments leave either one segment equal
and another with one bit at most, or one bit in each. The first kind meets in
(equal segment, codeword of another), six ordered pairs; the second in the
codewords of all three. So every pair within three bits meets under some key of
at least 33 bits, and few others do.

Under a key, a breadth-first search over those not yet reached yields a spanning
forest of the links, never all pairs. A key with more fingerprints than
`BLOCK` is dealt to several tasks, one for each pair of blocks. Equal
fingerprints are one from the start, whatever their number.

Defined results: null and word-less texts have fingerprint zero and are linked
like any other; a text with fewer words than a shingle has one shingle; rows with
an equal or a null key are rows of their own and link like any other; a component
is named by its smallest key that isn't null, and by null only if it has none;
other columns are ignored or, in `first_of_each`, kept, whatever their names; keys
may be of any ordered type; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqframe.llm.common import hot_keys, row_columns, small_batches, spread_join, with_facts, worker_cache, written
from seqframe.llm.components import Forest, components

#: Bits that may differ (what the keys below are made for); seed of the shingles' hash; fingerprints that one task compares under one key.
DISTANCE, SEED, BLOCK = 3, 42, 8192
#: Generator polynomial of the (23,12) Golay code, a fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: First bit and width of each segment.
SEGMENTS = ((0, 21), (21, 21), (42, 22))


def _remainders() -> np.ndarray:
    """The syndrome of each single bit of a 23-bit word."""
    out, x = [], 1
    for _ in range(23):
        out.append(x)
        x <<= 1
        if x >> 11:
            x ^= GENERATOR
    return np.array(out, np.int64)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits of a word, and the error that each syndrome stands for."""
    bits = _remainders()
    low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
    for i in range(12):
        low[np.arange(1 << 12) >> i & 1 == 1] ^= bits[i]
    for i in range(11):
        high[np.arange(1 << 11) >> i & 1 == 1] ^= bits[12 + i]
    errors = np.full(1 << 11, -1, np.int64)
    places = range(23)
    for wrong in [(), *((i,) for i in places), *((i, j) for i in places for j in range(i)), *((i, j, k) for i in places for j in range(i) for k in range(j))]:
        syndrome = 0
        for i in wrong:
            syndrome ^= int(bits[i])
        errors[syndrome] = sum(1 << i for i in wrong)
    return low, high, errors


_LOW, _HIGH, _ERRORS = _tables()


def decode(word: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword at most three bits from each 23-bit word."""
    return (word ^ _ERRORS[_LOW[word & 0xFFF] ^ _HIGH[word >> 12]]) >> 11


def _segment_keys(word: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of one segment for each fingerprint, `width` + 1 columns, and which of them count (distinct ones, and one alone for even parity)."""
    near = np.concatenate([word[:, None], word[:, None] ^ (1 << np.arange(width))[None, :]], axis=1)
    keys = decode(near)
    order = np.sort(keys[:, 1:], axis=1)
    odd = (np.bitwise_count(word.astype(np.uint64)) & 1).astype(bool)[:, None]
    new = np.ones(order.shape, bool)
    new[:, 1:] = order[:, 1:] != order[:, :-1]
    return np.concatenate([keys[:, :1], order], axis=1), np.concatenate([np.ones((len(word), 1), bool), odd & new & (order != keys[:, :1])], axis=1)


def keys_of(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints (unsigned 64-bit) and, beside each, the place of its fingerprint."""
    fp = fingerprints.astype(np.uint64)
    parts = [(fp >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    near = [_segment_keys(p, width) for p, (_, width) in zip(parts, SEGMENTS, strict=True)]
    keys, owners = [], []
    for kind, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        row, column = np.nonzero(near[j][1])
        keys.append((kind << 58) | (parts[i][row] << 12) | near[j][0][row, column])
        owners.append(row)
    row, column = np.nonzero(near[0][1])
    key = near[0][0][row, column]
    for codes, counted in near[1:]:
        some, column = np.nonzero(counted[row])
        key = key[some] << 12 | codes[row[some], column]
        row = row[some]
    keys.append((6 << 58) | key)
    owners.append(row)
    return np.concatenate(keys), np.concatenate(owners)


def fingerprint(text: str | None, shingle: int) -> int:
    """The SimHash of a text's word shingles, repeats included."""
    tokens = text.encode().lower().split() if text else []
    if not tokens:
        return 0
    line = b" ".join(tokens)
    if len(tokens) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(tokens) - shingle + 1].tolist()
    stops = ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        set_bits += np.unpackbits(hashes[i : i + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id`, `h1`, `h2` (a row's identity, see `row_columns`) and `fp`, the fingerprint as a signed long, of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("simhash")
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(3)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fps, pa.int64())], ["doc_id", "h1", "h2", "fp"])

    rows = small_batches(docs).select(*row_columns(f"`{key}`", f"`{text}`"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(work, f"doc_id {docs.schema[key].dataType.simpleString()}, h1 long, h2 int, fp long")


def _with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            fps = batch.slice(at, 4096).column(0).to_numpy()
            keys, owner = keys_of(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(fps[owner], pa.int64())], ["key", "fp"])


def spanning_links(fps: np.ndarray, distance: int = DISTANCE) -> Iterator[tuple[int, np.ndarray]]:
    """Places (i, those newly reached from i) of a spanning forest of the links among distinct fingerprints."""
    left = np.arange(len(fps))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[i]) <= distance
            if near.any():
                reached, left = left[near], left[~near]
                queue.extend(reached.tolist())
                yield int(i), reached


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each run of rows with equal (key, first block, second block); those that join nothing new in this task are left out."""
    worker_cache("simhash")
    forest, made = Forest(), []

    def group(fps: np.ndarray) -> None:
        for i, reached in spanning_links(fps.view(np.uint64)):
            a = int(fps[i])
            made.extend((a, b) for b in fps[reached].tolist() if forest.join(a, b))

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64())], ["a", "b"])

    held: list[np.ndarray] = []
    name = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names, fps = np.stack([batch.column(i).to_numpy() for i in range(3)]), batch.column(3).to_numpy()
        cuts = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            here = tuple(names[:, i].tolist())
            if here != name:
                if held:
                    group(np.concatenate(held))
                held, name = [], here
            held.append(fps[i:j])
        if made:
            yield rows()
            made.clear()
    if held:
        group(np.concatenate(held))
    yield rows()


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links a, b between the fingerprints of `distinct` (fp, distinct longs) that join all within `DISTANCE` bits.

    Keys that over 1/HOT of all fingerprints' keys are equal to are counted apart and found by broadcast; all others are ordered by key.
    """
    keyed = distinct.select("fp").mapInArrow(_with_keys, "key long, fp long")
    hot = hot_keys(keyed, "key", F.count("*").alias("n"))
    rest = keyed if hot is None else keyed.join(F.broadcast(hot.select("key")), "key", "left_anti")
    met = rest.withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1")
    if hot is not None:
        met = met.unionByName(keyed.join(F.broadcast(hot), "key"))
    blocks = F.ceil(F.col("n") / block).cast("long")
    own = F.pmod(F.xxhash64("fp"), blocks)
    # a key with several blocks: each fingerprint goes to the pairs of its own block with every block
    dealt = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_linked, "a long, b long")


def _row():
    """A row's identity, in the order of rows: by key, null keys last."""
    return F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h1", "h2")


def with_first(docs: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`fingerprints` with `first`, the identity (last, doc_id, h1, h2) of the first row in the component that links of `DISTANCE` bits at most join."""
    prints = written(fingerprints(docs, shingle, key, text), "fingerprints")
    counted = written(prints.groupBy("fp").agg(F.min(_row()).alias("first"), F.count("*").alias("rows")), "distinct-fingerprints")
    found = components(links(counted), "simhash")
    rooted = written(counted.join(found, F.col("fp") == F.col("node"), "left").select("fp", "rows", "first", F.coalesce("component", "fp").alias("root")), "rooted-fingerprints")
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first"), F.count("*").alias("_n"))
    named = spread_join(rooted.drop("first"), firsts, "root", rooted.count()).select("fp", "first", F.col("rows").alias("_n"))
    return spread_join(prints, named, "fp", prints.count())


def near_duplicates(docs: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `fp` (signed long) and `component_id`, the smallest `key` reachable over links of `DISTANCE` bits at most (null if all keys there are), for every row."""
    return with_first(docs, shingle, key, text).select(F.col("doc_id").alias(key), "fp", F.col("first.doc_id").alias("component_id"))


def first_of_each(docs: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that are the first of their component, by `key`; of repeated rows (equal in key and text) all stay or go.

    Texts without words have nothing that could be alike: they take no part, and all stay.
    """
    worded = docs.filter(F.col(f"`{text}`").rlike(r"[^\x20\x09-\x0D]"))
    gone = with_first(worded, shingle, key, text).filter(_row() != F.col("first")).select("doc_id", "h1", "h2").distinct()
    return with_facts(docs, gone, key, text, "left_anti").select("row.*")


def hexadecimal(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
