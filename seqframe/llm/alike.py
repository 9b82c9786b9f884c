"""Groups of equal or similar pieces of text: MinHash candidates, exact Jaccard similarity, union-find.

A `Kind` says how a text is cut into pieces, what a piece's normal form is, and what its shingles are. Equal normal forms
are one piece, named by a 128-bit hash; a short name of 64 bits is enough to find groups, as pieces that share one only meet
there once more. `signed`, `links` and `components` of `links` are the steps; operator 8 uses them for lines, the near-duplicate stage of the
pipeline for whole documents.

Defined results: a null or blank text has no pieces with a name; equal pieces are one, however many rows have them; a piece of
any length is compared whole; rows are told apart by key and text, so null and repeated keys are rows of their own; other columns
are ignored or kept, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqframe.llm.common import HOT, give_back, row_columns, small_batches, spread_join, threshold, with_facts, worker_cache, written
from seqframe.llm.components import Forest, components

#: Characters of a line's shingle and words of a document's; least Jaccard similarity; bands and rows of a signature.
SHINGLE, WORDS, LEAST, BANDS, ROWS = 8, 5, 0.8, 16, 6
#: Characters of the second, finer shingle that lines of `SHINGLE` to `SHORT` characters have too: one changed word of up to 14
#: characters leaves a longer line at `LEAST` by the first.
FINE, SHORT = 4, 200
#: Characters that a task compares at once under one group, about; most bits of the bitmap of names.
BLOCK_CHARS, MOST_BITS = 1 << 20, 1 << 26
#: Names that a task remembers, so as to send each piece once; characters and pieces hashed at a time.
REMEMBERED, AT_ONCE, MANY = 400_000, 1 << 18, 2048
#: Characters whose windows are hashed in one go, so that the steps stay in a core's cache.
IN_CACHE = 1 << 15
#: Pieces and characters up to which a group is compared by sets, which is faster there than arrays.
FEW_PIECES, FEW_CHARS = 8, 8000

_BINS = BANDS * ROWS
_EMPTY = np.uint32(0xFFFFFFFF)


def normal(piece: str) -> str:
    """White space squeezed, lower case."""
    if piece.isprintable() and "  " not in piece:  # no white space but single blanks
        return piece.strip(" ").lower()
    return " ".join(piece.split()).lower()


def name_of(piece: str) -> bytes:
    """The 128-bit name of a normal form."""
    return xxhash.xxh3_128_digest(piece.encode())


def _windows(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of `size` characters."""
    h = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    width, factor = 1, 0xD6E8FEB86659FD93
    while width < size:  # by doubling; the last two parts overlap if `size` is no power of two
        step = min(width, size - width)
        h = h[:-step] * np.uint64(factor) + h[step:]
        h ^= h >> np.uint64(29)
        factor = factor * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF | 1
        width += step
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def shingles(lines: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of `size` characters of all lines, and how many each line has."""
    padded = [x if len(x) >= size else x.ljust(size, "\0") for x in lines]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    h = np.empty(max(0, len(codes) - size + 1), np.uint64)
    for start in range(0, len(h), IN_CACHE):
        h[start : start + IN_CACHE] = _windows(codes[start : start + IN_CACHE + size - 1], size)
    counts = sizes - size + 1
    before = np.cumsum(counts) - counts
    at = np.repeat(np.cumsum(sizes) - sizes - before, counts) + np.arange(int(counts.sum()))
    return h[at], counts


#: An odd factor and its inverse modulo 2^64, and a number for each byte.
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CODES = np.array([xxhash.xxh3_64_intdigest(bytes([b]), 7) for b in range(256)], np.uint64)


def word_shingles(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of `WORDS` words of all pieces (in normal form), and how many each has; one of fewer words is one window."""
    out, counts = [], []
    for piece in pieces:
        raw = np.frombuffer(piece.encode(), np.uint8)
        # a window's hash is its bytes' polynomial: a difference of running sums, moved back to the power of its start
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_CODES[raw] * _powers(_FACTOR, len(raw)), out=sums[1:])
        blanks = np.flatnonzero(raw == 32)
        starts, ends = np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [len(raw)]])
        k = min(WORDS, len(starts))
        s, e = starts[: len(starts) - k + 1], ends[k - 1 :]
        h = (sums[e] - sums[s]) * _powers(_INVERSE, len(raw) + 1)[s]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
        out.append(h)
        counts.append(len(h))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.array(counts, np.int64)


_POWERS: dict[int, np.ndarray] = {}


def _powers(factor: np.uint64, n: int) -> np.ndarray:
    """The first `n` powers; those of usual lengths are kept."""
    found = _POWERS.get(int(factor))
    if found is None or len(found) < n:
        found = np.full(max(n, 1 << 16), factor)
        found[0] = 1
        np.multiply.accumulate(found, out=found)
        if len(found) <= 1 << 20:
            _POWERS[int(factor)] = found
    return found[:n]


def shingle_set(piece: str, size: int = SHINGLE) -> set[str]:
    """The shingles themselves; a shorter piece is one."""
    return {piece[i : i + size] for i in range(len(piece) - size + 1)} if len(piece) > size else {piece}


def word_set(piece: str) -> set[tuple[str, ...]]:
    words = piece.split(" ")
    return {tuple(words[i : i + WORDS]) for i in range(max(1, len(words) - WORDS + 1))}


#: Hashes of shingles and how many each piece has, of many pieces at once.
Hashes = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]

fine_shingles = partial(shingles, size=FINE)
fine_set = partial(shingle_set, size=FINE)


@dataclass(frozen=True)
class Kind:
    """`fine`, if given, are the second shingles of pieces of `SHINGLE` to `SHORT` characters: two such are also alike if alike by these. The sets are of the same shingles, unhashed."""

    cut: Callable[[str], list[str]]
    shingles: Hashes
    set_of: Callable[[str], set]
    fine: Hashes | None = None
    fine_set_of: Callable[[str], set] | None = None

    def has_fine(self, piece: str) -> bool:
        return self.fine is not None and SHINGLE <= len(piece) <= SHORT


#: For each bin, all bins in an order of its own.
_ORDERS = np.argsort(np.random.default_rng(1).random((_BINS, _BINS)), axis=1)


def _filled(least: np.ndarray, few: bool) -> np.ndarray:
    """`least` with each empty bin given another's value: that of the next full one and how far it is, or with `few` the first full one in the bin's own order, so that the bins of a band differ in what they borrow, however few shingles a piece has."""
    out = least.astype(np.uint64)
    piece, place = np.nonzero(least == _EMPTY)
    for step in range(_BINS):
        if not len(piece):
            break
        other = _ORDERS[place, step] if few else (place + step) % _BINS
        found = least[piece, other]
        good = found != _EMPTY
        out[piece[good], place[good]] = found[good].astype(np.uint64) + (np.uint64(0) if few else np.uint64(step * 0x1000193))
        piece, place = piece[~good], place[~good]
    return out


def _least_of_windows(pieces: list[str], size: int) -> np.ndarray:
    """The least hash in each bin of each piece's shingles of `size` characters."""
    padded = [x if len(x) >= size else x.ljust(size, "\0") for x in pieces]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    row = np.repeat(np.arange(len(pieces)) * _BINS, sizes)
    row[(np.cumsum(sizes)[:, None] - np.arange(1, size)).ravel()] = len(pieces) * _BINS  # windows that reach into the next piece
    out = np.full((len(pieces) + 1) * _BINS, _EMPTY)
    for start in range(0, len(codes) - size + 1, IN_CACHE):
        h = _windows(codes[start : start + IN_CACHE + size - 1], size)
        at = ((h >> np.uint64(32)) * np.uint64(_BINS) >> np.uint64(32)).astype(np.int64)
        at += row[start : start + len(h)]
        np.minimum.at(out, at, h.astype(np.uint32))
    return out[:-_BINS].reshape(-1, _BINS)


def _least(pieces: list[str], hashes: Hashes) -> np.ndarray:
    """The same of any shingles."""
    h, counts = hashes(pieces)
    row = np.repeat(np.arange(len(pieces)) * _BINS, counts)
    bins = ((h >> np.uint64(32)) * np.uint64(_BINS) >> np.uint64(32)).astype(np.int64)
    out = np.full(len(pieces) * _BINS, _EMPTY)
    np.minimum.at(out, row + bins, h.astype(np.uint32))
    return out.reshape(-1, _BINS)


_WINDOWS = {shingles: SHINGLE, fine_shingles: FINE}


def band_keys(pieces: list[str], hashes: Hashes = shingles, few: bool = False) -> np.ndarray:
    """Band keys of each piece, `BANDS` signed 64-bit numbers; `few`: pieces have few shingles, and common ones, so a key must not hang on one of them."""
    least = _least_of_windows(pieces, _WINDOWS[hashes]) if hashes in _WINDOWS and pieces else _least(pieces, hashes)
    values = _filled(least, few)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F), (len(pieces), BANDS)).copy()
    for row in values.reshape(len(pieces), BANDS, ROWS).transpose(2, 0, 1):
        keys ^= row
        keys *= np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(30)
    return keys.view(np.int64)


def _groups(sizes: Iterable[int]) -> Iterator[tuple[int, int]]:
    """Ranges of pieces of these sizes that have `AT_ONCE` characters and `MANY` pieces at most (one longer piece stays alone)."""
    start = held = end = 0
    for end, size in enumerate(sizes):
        if end > start and (held + size > AT_ONCE or end - start >= MANY):
            yield start, end
            start, held = end, 0
        held += size
    if held:
        yield start, end + 1


def _bands(pieces: list[str], kind: Kind) -> tuple[np.ndarray, np.ndarray]:
    """Places of pieces, and `BANDS` band keys for each; a piece with finer shingles is there twice."""
    owners, keys = [np.zeros(0, np.int64)], [np.zeros((0, BANDS), np.int64)]
    for hashes, some, few in ((kind.shingles, range(len(pieces)), False), (kind.fine, [k for k, x in enumerate(pieces) if kind.has_fine(x)], True)):
        for i, j in _groups(len(pieces[k]) for k in some):
            owners.append(np.array(some[i:j], np.int64))
            keys.append(band_keys([pieces[k] for k in some[i:j]], hashes, few))
    return np.concatenate(owners), np.concatenate(keys)


def _blobs(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Runs of `sizes` of the 64-bit `values`, one after another, as binary values."""
    ends = np.concatenate([[0], np.cumsum(sizes * 8)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _numbers(blobs: pa.Array) -> np.ndarray:
    """The values of such runs, one after another."""
    return np.frombuffer(b"".join(blobs.to_pylist()), np.int64)


#: Bits of a short name that are a hash; those above tell about how long the piece is, in steps of `STEP`.
HASH_BITS, STEP = 56, 1.2


def short_names(names: list[bytes], sizes: Iterable[int]) -> np.ndarray:
    """For each name a positive 64-bit number to find groups by, which holds the piece's length, up to a fifth too large."""
    hashes = np.frombuffer(b"".join(names), "<u8")[::2] >> np.uint64(64 - HASH_BITS)
    steps = np.ceil(np.log(np.fromiter(sizes, np.float64, len(names)) + 1) / math.log(STEP))
    return (np.minimum(steps, 127).astype(np.uint64) << np.uint64(HASH_BITS) | hashes).view(np.int64)


def chars_of(line: Column) -> Column:
    """About how many characters the piece of a short name has."""
    return F.pow(F.lit(STEP), F.shiftright(line, HASH_BITS))


#: Bits of a band key that name the bucket it is counted in.
BUCKET_BITS = 16
#: Short names whose band keys are one value of a table (small ones, as a table's writer looks at its memory every hundred values).
PACKED = 256
#: Band keys that a task matches, about, and that a task deals at a time.
MATCHED, DEALT = 1 << 20, 1 << 21


def signed(docs: DataFrame, kind: Kind, key: str, text: str) -> DataFrame:
    """`doc_id`, `h1`, `h2` (a row's identity, see `row_columns`), `names` (of a text's pieces, null for blank ones), `fresh`, `heavy` and `keys`.

    `fresh`, in a batch's last row, are the pieces that the task hadn't seen before: blocks of their short names, and of `BANDS` band keys for
    each, as bytes, since these are by far the most numbers here and only arrays are made of them. In a task's last row `keys` is the number of its band keys, and `heavy` are the
    buckets that have 1/HOT of them or more: a key that has that share of all has it in some task.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("alike")
        sent: set[bytes] = set()
        counts, held = np.zeros(1 << BUCKET_BITS, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield held
            names: list[bytes | None] = []
            ends, places, fresh = [0], [], []
            for value in batch.column(3).to_pylist():
                for piece in kind.cut(value) if value is not None else ():
                    if piece := normal(piece):
                        names.append(name := name_of(piece))
                        if name not in sent:
                            if len(sent) > REMEMBERED:
                                sent.clear()
                            sent.add(name)
                            places.append(len(names) - 1)
                            fresh.append(piece)
                    else:
                        names.append(None)
                ends.append(len(names))
            owners, keys = _bands(fresh, kind)
            counts += np.bincount(keys.ravel().view(np.uint64) >> np.uint64(64 - BUCKET_BITS), minlength=len(counts))
            sizes = np.diff([*range(0, len(owners), PACKED), len(owners)])
            lines = short_names([names[i] for i in places], map(len, fresh))[owners]
            blocks = pa.StructArray.from_arrays([_blobs(lines, sizes), _blobs(keys, sizes * BANDS)], ["lines", "bands"])
            new = pa.ListArray.from_arrays(pa.array([0] * batch.num_rows + [len(blocks)], pa.int32()), blocks)
            named = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names, pa.binary()))
            told = [pa.nulls(batch.num_rows, pa.list_(pa.int32())), pa.nulls(batch.num_rows, pa.int64())]
            held = pa.RecordBatch.from_arrays([*batch.columns[:3], named, new, *told], ["doc_id", "h1", "h2", "names", "fresh", "heavy", "keys"])
        if held is not None:
            heavy, before = np.flatnonzero((counts > 0) & (counts * HOT >= counts.sum())).tolist(), [None] * (held.num_rows - 1)
            held = held.set_column(5, "heavy", pa.array([*before, heavy], pa.list_(pa.int32())))
            yield held.set_column(6, "keys", pa.array([*before, int(counts.sum())], pa.int64()))
        sent.clear()
        give_back()

    doc_id = docs.schema[key].dataType.simpleString()
    rows = small_batches(docs).select(*row_columns(f"`{key}`", f"`{text}`"), F.col(f"`{text}`").alias("text"))
    return written(rows.mapInArrow(work, f"doc_id {doc_id}, h1 long, h2 int, names array<binary>, fresh array<struct<lines: binary, bands: binary>>, heavy array<int>, keys long"), "signatures")


def _bitmap(lines: DataFrame) -> tuple[int, np.ndarray]:
    """A bitmap of hashed names in `lines` (line), of 16 bits a name and `MOST_BITS` at most; a full one only sends more texts."""
    count = lines.count()
    bits = min(MOST_BITS, max(1 << 16, 1 << (16 * count).bit_length()))
    place = F.pmod(F.col("line"), F.lit(bits))
    words = lines.groupBy((place / 64).cast("long").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).alias("bits"))
    out = np.zeros(bits // 64, np.int64)
    found = words.toArrow()
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return bits, out.view(np.uint64)


def _texts(docs: DataFrame, lines: DataFrame, kind: Kind, text: str) -> DataFrame:
    """`line`, `name` and `value`, the normal form, of the pieces whose short names are in `lines` (and of few others)."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(lines))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("alike")
        (bits, bitmap), sent = shared.value, set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                values = [x for t in batch.column(0).slice(at, 512).to_pylist() if t for piece in kind.cut(t) if (x := normal(piece))]
                names = list(map(name_of, values))
                halves = short_names(names, map(len, values))
                place = halves % bits
                out = []
                for k in np.flatnonzero(bitmap[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).tolist():
                    if names[k] not in sent:
                        if len(sent) > REMEMBERED:
                            sent.clear()
                        sent.add(names[k])
                        out.append(k)
                yield pa.RecordBatch.from_arrays([pa.array(halves[out], pa.int64()), pa.array([names[k] for k in out], pa.binary()), pa.array([values[k] for k in out], pa.string())], ["line", "name", "value"])
        sent.clear()
        give_back()

    return small_batches(docs).select(f"`{text}`").mapInArrow(work, "line long, name binary, value string")


def set_links(sets: list[set], least: float = LEAST) -> Iterator[tuple[int, list[int]]]:
    """Places (i, those newly reached from i) of a spanning forest of the links among sets, by exact Jaccard similarity."""
    left = list(range(len(sets)))
    while len(left) > 1:
        queue = [left.pop(0)]
        while queue and left:
            i = queue.pop()
            near = []
            for j in left:
                n, m = len(sets[i]), len(sets[j])
                if min(n, m) >= least * max(n, m):
                    both = len(sets[i] & sets[j])
                    if both >= least * (n + m - both):
                        near.append(j)
            if near:
                left = [j for j in left if j not in near]
                queue += near
                yield i, near


def similar_links(values: list[str], least: float = LEAST, hashes: Hashes = shingles) -> Iterator[tuple[int, np.ndarray]]:
    """The same among pieces, by the hashes of their shingles; for groups with many or long ones."""
    h, counts = hashes(values)
    owner = np.repeat(np.arange(len(values)), counts)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[first], owner[first]
    _, codes = np.unique(h, return_inverse=True)
    sizes = np.bincount(owner, minlength=len(values))
    ends = np.cumsum(sizes)
    flag = np.zeros(int(codes.max(initial=-1)) + 1, bool)
    left = np.arange(len(values))
    left_codes, left_sizes = codes, sizes
    while len(left) > 1:
        queue = [int(left[0])]
        left_codes, left_sizes, left = left_codes[left_sizes[0] :], left_sizes[1:], left[1:]
        while queue and len(left):
            i = queue.pop()
            own = codes[ends[i] - sizes[i] : ends[i]]
            flag[own] = True
            both = np.add.reduceat(flag[left_codes], np.cumsum(left_sizes) - left_sizes, dtype=np.int64)
            flag[own] = False
            near = both >= least * (len(own) + left_sizes - both)
            if near.any():
                reached = left[near]
                queue.extend(reached.tolist())
                left_codes = left_codes[np.repeat(~near, left_sizes)]
                left, left_sizes = left[~near], left_sizes[~near]
                yield i, reached.tolist()


def _linked(kind: Kind, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each run of rows with equal (group, first block, second block); those that join nothing new in this task are left out."""
    worker_cache("alike")
    forest = Forest()

    def group(names: list[bytes], values: list[str]) -> list[tuple[bytes, bytes]]:
        one = dict(zip(names, values, strict=True))
        names, values = list(one), list(one.values())
        if len(names) < 2 or len(names) == 2 and forest.root(names[0]) == forest.root(names[1]):
            return []
        short = [i for i, x in enumerate(values) if kind.has_fine(x)]
        ways = [(kind.shingles, kind.set_of, range(len(values))), (kind.fine, kind.fine_set_of, short)]
        small = len(values) <= FEW_PIECES and sum(map(len, values)) <= FEW_CHARS
        found, linked = [], 0
        for hashes, set_of, some in ways[::-1] if len(short) == len(values) else ways:
            if linked == len(values) - 1 or len(some) < 2:  # all are in one component already, or none can be joined
                continue
            linked, those = 0, [values[k] for k in some]
            for i, reached in set_links(list(map(set_of, those))) if small else similar_links(those, hashes=hashes):
                linked += len(reached)
                found += [(names[some[i]], names[some[j]]) for j in reached if forest.join(names[some[i]], names[some[j]])]
        return found

    def rows(made: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.binary())], ["a", "b"])

    held: tuple[list[bytes], list[str]] = ([], [])
    now, made = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
        names, values = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            here = tuple(keys[:, i].tolist())
            if here != now:
                made += group(*held)
                held, now = ([], []), here
            held[0].extend(names[i:j])
            held[1].extend(values[i:j])
        yield rows(made)
        made = []
    yield rows(made + group(*held))
    del held, forest
    give_back()


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Short names and band keys, one for one, about `DEALT` at a time, of batches with blocks of `fresh`."""
    lines: list[np.ndarray] = []
    bands: list[np.ndarray] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            some = batch.slice(at, 64)
            lines.append(np.repeat(_numbers(some.column(0)), BANDS))
            bands.append(_numbers(some.column(1)))
            if sum(map(len, bands)) >= DEALT:
                yield np.concatenate(lines), np.concatenate(bands)
                lines, bands = [], []
    if bands:
        yield np.concatenate(lines), np.concatenate(bands)


def _suspected(heavy: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The band keys of `heavy` buckets."""
    is_heavy = np.zeros(1 << BUCKET_BITS, bool)
    is_heavy[heavy] = True
    for lines, bands in _keys(batches):
        those = is_heavy[bands.view(np.uint64) >> np.uint64(64 - BUCKET_BITS)]
        made = pa.RecordBatch.from_arrays([pa.array(lines[those]), pa.array(bands[those])], ["line", "band"])
        for i in range(0, made.num_rows, 1 << 17):
            yield made.slice(i, 1 << 17)


def _dealt(buckets: int, hot: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The band keys but `hot` ones, a row for each bucket that some of those dealt at a time are in; `buckets` is 2^16 at most."""
    for lines, bands in _keys(batches):
        if len(hot):
            rest = ~np.isin(bands, hot)
            lines, bands = lines[rest], bands[rest]
        bucket = ((bands.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16)
        order, sizes = np.argsort(bucket, kind="stable"), np.bincount(bucket, minlength=buckets)
        full = np.flatnonzero(sizes)
        made = pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), _blobs(lines[order], sizes[full]), _blobs(bands[order], sizes[full])], ["bucket", "lines", "bands"])
        for i in range(0, made.num_rows, 4096):
            yield made.slice(i, 4096)
    give_back()


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`hub` and `line` of the band keys of whole buckets, each once."""
    parts = [(_numbers(batch.column(1)), _numbers(batch.column(2))) for batch in batches if batch.num_rows]
    if parts:
        lines, bands = map(np.concatenate, zip(*parts, strict=True))
        del parts
        order = np.argsort(bands)
        lines, bands = lines[order], bands[order]
        again = np.concatenate([[False], bands[1:] == bands[:-1], [False]])
        shared = again[1:] | again[:-1]  # most keys have one line
        lines, starts = lines[shared], np.flatnonzero(~again[:-1][shared])
        if len(lines):
            sizes = np.diff([*starts, len(lines)])
            hub = np.repeat(np.minimum.reduceat(lines, starts), sizes)
            several = hub < np.repeat(np.maximum.reduceat(lines, starts), sizes)
            hub, lines = hub[several], lines[several]
            order = np.lexsort((lines, hub))
            hub, lines = hub[order], lines[order]
            first = np.ones(len(hub), bool)
            first[1:] = (hub[1:] != hub[:-1]) | (lines[1:] != lines[:-1])
            made = pa.RecordBatch.from_arrays([pa.array(hub[first]), pa.array(lines[first])], ["hub", "line"])
            for i in range(0, made.num_rows, 1 << 17):
                yield made.slice(i, 1 << 17)
    give_back()


def _met(signatures: DataFrame) -> DataFrame:
    """`hub`, `line`: which short names meet in which group, that of the smallest under a band key they share.

    Band keys that over 1/HOT of all have are counted apart, in the buckets that are heavy in some task, and their groups are found
    by broadcast; all others are dealt by buckets, packed, to tasks that match `MATCHED` about.
    """
    blocks = small_batches(signatures).select(F.explode("fresh").alias("f")).select("f.lines", "f.bands")
    total = signatures.agg(F.coalesce(F.sum("keys"), F.lit(0))).first()[0]
    heavy = [r.b for r in signatures.select(F.explode("heavy").alias("b")).distinct().collect()]  # a number of buckets that is fixed
    hot, keys = None, np.zeros(0, np.int64)
    if heavy:
        many = F.lit(threshold(total))
        suspected = blocks.mapInArrow(partial(_suspected, heavy), "line long, band long")
        hot = written(suspected.groupBy("band").agg(F.count("*").alias("n"), F.min("line").alias("hub"), F.max("line").alias("last")).filter(F.col("n") > many).drop("n"), "hot-bands")
        keys = hot.select("band").toArrow().column("band").to_numpy()  # HOT rows at most
    tasks = -(-max(total, 1) // MATCHED)
    dealt = blocks.mapInArrow(partial(_dealt, min(8 * tasks, 1 << 16), keys), "bucket int, lines binary, bands binary")
    met = dealt.repartition(tasks, "bucket").mapInArrow(_meeting, "hub long, line long")
    if len(keys):
        met = met.unionByName(suspected.join(F.broadcast(hot), "band").filter("hub < last").select("hub", "line"))
    return written(met.distinct(), "groups")


def links(docs: DataFrame, signatures: DataFrame, kind: Kind, text: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Links a, b between names that join all pieces that share a band key and have a Jaccard similarity of `LEAST` or more by either shingles."""
    met = _met(signatures)
    # dealt by the short name alone, which is the join's key too, so that texts move once; a task sends a piece once, so none is hot
    values = _texts(docs, met.select("line").distinct(), kind, text).repartition("line").groupBy("line", "name").agg(F.min("value").alias("value"))
    sizes = met.groupBy("hub").agg(F.ceil(F.sum(chars_of(F.col("line"))) / block_chars).cast("long").alias("blocks"), F.count("*").alias("_n"))
    group = spread_join(met, sizes, "hub", met.count()).join(values, "line")
    group = group.withColumn("_own", F.pmod(F.xxhash64("name"), F.col("blocks"))).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    group = group.select("hub", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "name", "value")
    return group.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j").mapInArrow(partial(_linked, kind), "a binary, b binary")


def whole(text: str) -> list[str]:
    return [text]


#: Whole documents by windows of `WORDS` words, and the characters of them that a task compares at once.
DOCUMENTS, DOCUMENT_BLOCK = Kind(whole, word_shingles, word_set), 1 << 22


def first_of_similar(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` but those that an earlier one goes before in their component of documents of similarity `LEAST` or more.

    The earlier row is that of the smaller `key`, rows with a null key last; of repeated rows (equal in key and text) all stay or go.
    Null texts and texts without words stay; other columns are kept, whatever their names; an empty table gives none.
    """
    signatures = signed(docs, DOCUMENTS, key, text)
    near = components(links(docs, signatures, DOCUMENTS, text, DOCUMENT_BLOCK), "documents")
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h1", "h2")
    places = signatures.select(row.alias("at"), F.get("names", F.lit(0)).alias("line")).filter("line is not null")
    first = places.groupBy("line").agg(F.min("at").alias("_first"), F.count("*").alias("_n")).join(near, F.col("line") == F.col("node"), "left").select("line", "_first", "_n", F.coalesce("component", "line").alias("component"))
    first = written(first, "first-documents")
    least = first.groupBy("component").agg(F.min("_first").alias("_stays"), F.count("*").alias("_n"))
    named = spread_join(first.select("line", "component", F.col("_n").alias("_rows")), least, "component", first.count()).select("line", "_stays", F.col("_rows").alias("_n"))
    gone = spread_join(places, named, "line", places.count()).filter("at <> _stays").select("at.doc_id", "at.h1", "at.h2").distinct()
    return with_facts(docs, gone, key, text, "left_anti").select("row.*")
