"""Operator 9: benchmark decontamination with an FM-index per training shard.

A shard is a slice of a partition's documents with a bounded number of bytes.
Its words become numbers; a word that no benchmark window has becomes "other".
No window can reach over an "other" word or a document's end, so the index is
built over the runs between them, and a run shorter than the shortest window is
left out: this loses no occurrence. Over those runs the shard has a suffix
array (prefix doubling), its Burrows-Wheeler transform in a wavelet matrix, and
suffix positions sampled at each run's start and every `SAMPLED` words. All
windows search backwards together by wavelet ranks, and rows are located by
walking back to a sample. Occurrences become word spans, merged by document.

Defined results: null and empty texts have no words and no hits; an item with no
words or a null text has no window; repeated items and repeated windows each
count; a null item_id is named by an empty string; rows with equal doc_id stay
rows of their own; other columns are ignored; an empty benchmark marks nothing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqframe.llm.common import fresh_name, give_back, slices, small_batches, worker_cache

#: Words of a window; words between sampled suffix positions; bytes of text in a shard; windows searched, and broadcast, in one pass.
WINDOW, SAMPLED, SHARD_BYTES, PASS_WINDOWS = 10, 8, 8 << 20, 1_000_000

_BLANK = bytes(0x20 if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of characters outside U+0000-2F, 3A-60, 7B-7F."""
    return text.encode().translate(_BLANK).split() if text else []


class Ranks:
    """Counts of set bits before a position, from 64-bit words and their running sums."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, "<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]])

    def __call__(self, at: np.ndarray) -> np.ndarray:
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << rest) - np.uint64(1)))

    def bit(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    def __init__(self, values: np.ndarray, top: int) -> None:
        self.levels: list[tuple[int, Ranks, int]] = []
        for shift in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bits = (values >> shift & 1).astype(bool)
            self.levels.append((shift, Ranks(bits), int(len(bits) - bits.sum())))
            values = np.concatenate([values[~bits], values[bits]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low, high = np.zeros_like(at), at
        for shift, ones, zeros in self.levels:
            up = (symbols >> shift & 1).astype(bool)
            a, b = ones(low), ones(high)
            low, high = np.where(up, zeros + a, low - a), np.where(up, zeros + b, high - b)
        return high - low

    def read(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it stands before."""
        symbol, low = np.zeros_like(at), np.zeros_like(at)
        for shift, ones, zeros in self.levels:
            up, a, b = ones.bit(at), ones(low), ones(at)
            low, at = np.where(up, zeros + a, low - a), np.where(up, zeros + b, at - b)
            symbol |= up.astype(symbol.dtype) << shift
        return symbol, at - low


def suffix_order(symbols: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """The suffix array by prefix doubling; positions marked in `apart` count as symbols of their own, in text order, below the others."""
    n = len(symbols)
    first, second = symbols.astype(np.int64) + n, np.zeros(n, np.int64)
    first[apart] = np.flatnonzero(apart)
    known = 1  # symbols that `first` and `second` together compare
    while True:
        order = np.argsort(first * (n + 2) + second, kind="stable")
        a, b = first[order], second[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])[:n]
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        first, second = rank, np.zeros(n, np.int64)
        second[: n - known] = rank[known:] + 1
        known *= 2


class FMIndex:
    """Search and locate in runs of symbols (2 and up), each followed by symbol 1."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, top: int) -> None:
        apart = symbols == 1
        order = suffix_order(symbols, apart)
        self.bwt = WaveletMatrix(symbols[order - 1].astype(np.int64), top)
        counts = np.bincount(symbols, minlength=top + 2)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        keep = np.zeros(len(symbols), bool)
        keep[::SAMPLED] = True
        keep[starts] = True
        marked = keep[order]
        self.marked, self.samples = Ranks(marked), order[marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows whose suffixes begin with each pattern (a row of the matrix): first and after the last."""
        low = self.first[patterns[:, -1]].copy()
        high = self.first[patterns[:, -1] + 1].copy()
        for k in range(patterns.shape[1] - 2, -1, -1):
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            c = patterns[live, k]
            low[live], high[live] = self.first[c] + self.bwt.rank(c, low[live]), self.first[c] + self.bwt.rank(c, high[live])
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row's suffix: back by LF to a sample; run starts are samples, so no walk leaves its run."""
        found, steps = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        open_, at = np.arange(len(rows)), rows.copy()
        while len(open_):
            done = self.marked.bit(at)
            found[open_[done]] = self.samples[self.marked(at[done])] + steps[open_[done]]
            open_, at = open_[~done], at[~done]
            steps[open_] += 1
            symbol, before = self.bwt.read(at)
            at = self.first[symbol] + before
        return found


class Windows:
    """Distinct windows of one pass, as numbers of their words, with the items that have each."""

    def __init__(self, items: list[tuple[str, list[bytes]]]) -> None:
        self.number: dict[bytes, int] = {}
        of: dict[tuple[int, ...], set[str]] = {}
        for name, tokens in items:
            ids = [self.number.setdefault(w, len(self.number) + 2) for w in tokens]
            for i in range(max(1, len(ids) - WINDOW + 1)) if ids else ():
                of.setdefault(tuple(ids[i : i + WINDOW]), set()).add(name)
        self.items = list(of.values())
        by_length: dict[int, list[int]] = {}
        rows = list(of)
        for k, row in enumerate(rows):
            by_length.setdefault(len(row), []).append(k)
        self.patterns = [(n, np.array(ks), np.array([rows[k] for k in ks], np.int64)) for n, ks in sorted(by_length.items())]
        self.shortest = min(by_length, default=0)

    def occurrences(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window, first word (counted over all `docs`) and length of each occurrence."""
        none = (np.zeros(0, np.int64),) * 3
        sizes = np.array([len(d) for d in docs], np.int64)
        total = int(sizes.sum())
        if not total or not self.patterns:
            return none
        ids = np.empty(total, np.int32)
        at = 0
        for d in docs:
            ids[at : at + len(d)] = list(map(self.number.get, d, repeat(1)))
            at += len(d)
        inside = ids > 1
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        ends = np.cumsum(sizes)
        edge = ends[(ends > 0) & (ends < total)]
        start[edge] |= inside[edge]
        starts = np.flatnonzero(start)
        breaks = np.flatnonzero(~inside | start)
        nxt = np.searchsorted(breaks, starts, "right")
        stops = np.append(breaks, total)[nxt]
        long = stops - starts >= self.shortest
        starts, stops = starts[long], stops[long]
        if not len(starts):
            return none
        lengths = stops - starts + 1  # with the separator
        after = np.cumsum(lengths)
        text_at = np.repeat(starts - (after - lengths), lengths) + np.arange(int(after[-1]))  # the word that each index position stands for
        symbols = np.ones(int(after[-1]), np.int64)
        word_slots = np.ones(len(symbols), bool)
        word_slots[after - 1] = False
        symbols[word_slots] = ids[text_at[word_slots]]
        index = FMIndex(symbols, after - lengths, len(self.number) + 2)
        parts = []
        for n, ks, rows in self.patterns:
            low, high = index.search(rows)
            hits = high - low
            which = np.repeat(np.arange(len(ks)), hits)
            if not len(which):
                continue
            inner = np.arange(len(which)) - np.repeat(np.cumsum(hits) - hits, hits)
            where = text_at[index.locate(low[which] + inner)]
            parts.append((ks[which], where, np.full(len(which), n)))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else none


def _shard(texts: list[str | None], windows: Windows) -> list[tuple[int, list[dict], list[str]]]:
    """Number of words, merged word spans and items of each document."""
    docs = [words(t) for t in texts]
    which, where, length = windows.occurrences(docs)
    ends = np.cumsum([len(d) for d in docs])
    out = [(len(d), [], []) for d in docs]
    if not len(which):
        return out
    doc = np.searchsorted(ends, where, "right")
    order = np.lexsort((where, doc))
    names: dict[int, set[str]] = {}
    for d, w in {(d, w) for d, w in zip(doc.tolist(), which.tolist(), strict=True)}:
        names.setdefault(d, set()).update(windows.items[w])
    for d, a, n in zip(doc[order].tolist(), where[order].tolist(), length[order].tolist(), strict=True):
        spans, a = out[d][1], a - int(ends[d] - len(docs[d]))
        if spans and a <= spans[-1]["end"]:
            spans[-1]["end"] = max(spans[-1]["end"], a + n)
        else:
            spans.append({"start": a, "end": a + n})
    for d, found in names.items():
        out[d][2].extend(sorted(found))
    return out


def _passes(items: DataFrame, item: str, text: str) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in groups that have `PASS_WINDOWS` windows at most; an item of more is in several, with some of its windows in each."""
    held, size = [], 0
    for name, value in items.select(F.coalesce(F.col(item).cast("string"), F.lit("")), text).toLocalIterator():
        tokens = words(value)
        for start in range(0, max(1, len(tokens) - WINDOW + 1), PASS_WINDOWS):
            part = tokens[start : start + PASS_WINDOWS + WINDOW - 1]
            n = max(1, len(part) - WINDOW + 1)
            if held and size + n > PASS_WINDOWS:
                yield held
                held, size = [], 0
            held.append((name, part))
            size += n
    yield held


def _windows(token: str, items: Broadcast) -> Windows:
    """The windows of one pass, made once in a Python worker; `token` names the pass."""
    made = worker_cache("decontaminate")
    if token not in made:
        made.clear()
        made[token] = Windows(items.value)
    return made[token]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _found(docs: DataFrame, items: DataFrame, text: str, item: str, item_text: str, cleaned: bool = False) -> DataFrame:
    """`docs` with three columns added, words, spans and items; if `cleaned`, with its texts cleaned and one column added, the words removed, in the last pass."""
    spark = docs.sparkSession
    n, at = len(docs.columns), docs.columns.index(text)
    words_, spans_, items_, hits_ = (fresh_name(x, docs.columns) for x in ("_words", "_spans", "_items", "_hits"))
    added = T.StructType.fromDDL(f"{words_} long, {spans_} array<struct<start: long, end: long>>, {items_} array<string>")
    schema = T.StructType([*docs.schema.fields, *added.fields])
    out = small_batches(docs)
    groups = _passes(items, item, item_text)
    group, number = next(groups), 0
    while group is not None:
        following = next(groups, None)
        shared = spark.sparkContext.broadcast(group)
        clean = cleaned and following is None

        def work(batches: Iterator[pa.RecordBatch], shared=shared, number=number, clean=clean, token=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            windows = _windows(token, shared)
            for batch in slices(batches, at, SHARD_BYTES):
                texts = batch.column(at).to_pylist()
                rows = _shard(texts, windows)
                if number:
                    rows = [_joined(a, s, i) for a, s, i in zip(rows, batch.column(n + 1).to_pylist(), batch.column(n + 2).to_pylist(), strict=True)]
                if clean:
                    columns = list(batch.columns[:n])
                    columns[at] = pa.array([without_spans(t, r[1]) for t, r in zip(texts, rows, strict=True)], batch.schema.field(at).type)
                    hit = np.array([sum(x["end"] - x["start"] for x in r[1]) for r in rows], np.int64)
                    stays = pa.array((hit == 0) | (hit < np.array([r[0] for r in rows])))
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(hit)], [*batch.schema.names[:n], hits_]).filter(stays)
                else:
                    new = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], _SPANS), pa.array([r[2] for r in rows], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:n], *new], [*batch.schema.names[:n], words_, spans_, items_])
            give_back()

        out = out.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField(hits_, T.LongType())]) if clean else schema)
        group, number = following, number + 1
    return out


def find(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """`key`, `text`, `n_words`, `spans` (merged word spans covered by windows) and `items` (with occurring windows, sorted) of every document.

    One map over the documents, no shuffle, as long as the windows fit one pass; a larger benchmark takes a pass for each group of
    items, and spans are merged as rows go from pass to pass.
    """
    found = _found(docs.select(key, text), items, text, item, item_text)
    return found.toDF(key, text, "n_words", "spans", "items")


def _joined(row: tuple, spans: list[dict], items: list[str]) -> tuple:
    merged: list[dict] = []
    for s in sorted([*row[1], *spans], key=lambda s: s["start"]):
        if merged and s["start"] <= merged[-1]["end"]:
            merged[-1]["end"] = max(merged[-1]["end"], s["end"])
        else:
            merged.append(dict(s))
    return row[0], merged, sorted({*row[2], *items})


def without_spans(text: str | None, spans: list[dict]) -> str | None:
    """`text` without the words of `spans` and what stands between them."""
    if not spans or text is None:
        return text
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for s in spans:
        out.append(text[last : at[s["start"]][0]])
        last = at[s["end"] - 1][1]
    return "".join([*out, text[last:]])


def remove(docs: DataFrame, items: DataFrame, text: str = "text", hits: str | None = "n_hit") -> DataFrame:
    """Every row of `docs` with all its columns, its text without all benchmark spans, and, unless `hits` is None, a column of that name with the number of words removed.

    A row with spans of which no word remains is left out.
    """
    found = _found(docs, items, text, "item_id", "text", cleaned=True)
    return found.drop(found.columns[-1]) if hits is None else found.withColumnRenamed(found.columns[-1], hits)


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digests of `find`'s rows."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        key,
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
