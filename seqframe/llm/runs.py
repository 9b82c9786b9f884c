"""Operator 12: periodic runs of words, by Karp-Miller-Rosenberg naming.

A run is a stretch of consecutive words with smallest period `q` (words `q` apart
are identical), of at least `max(FEWEST, TIMES * q)` words, that no neighbouring
word extends keeping that period.

1. *Names.* Each position of a text has a name for the 2^k words from it: two
   positions have the same name at level k if and only if these words are equal.
   Level 0 numbers the distinct words; level k numbers the distinct pairs (name of
   the first half, name of the second half) of level k - 1. A position whose name no
   other has stays alone at all higher levels, so each level orders only the pairs
   of names that still repeat, and levels end when none do.
2. *Common extensions.* How far two positions agree, forwards or backwards, is
   found from the highest level down: where the names agree, both move on by 2^k.
3. *Candidates.* A run of period `q` holds `run - q` neighbouring pairs (i, i + q),
   so one of each grid of `max(FEWEST, TIMES * q) - q` steps. Pairs of one word
   and its like `q` later on the grid are extended in both directions; those long
   enough are runs of period `q`, and of equal stretches the smallest period stays.

All is done exactly, in NumPy, for many texts at once: they are laid end to end,
with a separator of its own after each, over which nothing agrees. Texts are taken
together with others of like length, as the periods tried go by the longest. The
work is one map without a shuffle; a text is one row's work, whole.

Defined results: a null text has no words; texts without words or runs give no
runs and their words joined by one space; rows are worked on one by one, so null
and repeated keys and repeated rows stay; other columns are kept, whatever their
names, but for those that share a name with the result: these give way to it; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seqframe.llm.common import give_back, slices, small_batches

#: Words of a run at least; periods of a run at least.
FEWEST, TIMES = 6, 4
#: Words that are named together (a longer text goes alone), and bytes of texts that are split together.
TOGETHER, BYTES = 1 << 18, 4 << 20
#: Candidates that are extended together.
EXTENDED = 1 << 18

#: What `find` can give, and its types. `runs` are ordered by start, then period.
COLUMNS = {
    "n_words": "long",
    "n_runs": "long",
    "start": "long",
    "length": "long",
    "period": "long",
    "exponent_milli": "long",
    "runs": "array<struct<start:long,length:long,period:long>>",
    "collapsed": "string",
    "runs_sha256": "string",
    "collapsed_sha256": "string",
}


def named(words: np.ndarray) -> list[np.ndarray]:
    """Names of every position at the levels 0, 1, ...; `words` are numbers from 0 on, less than their count.

    At level k positions of equal 2^k words have equal names. Names of positions that are alone are their own, above all others.
    """
    n = len(words)
    own = np.arange(n, 2 * n, dtype=np.int32)
    counts = np.bincount(words, minlength=1)
    level = np.where(counts[words] > 1, words, own).astype(np.int32)
    levels, step = [level], 1
    while True:
        live = np.flatnonzero(level < n)
        live = live[live + step < n]
        live = live[level[live + step] < n]
        if not len(live):
            return levels
        pairs = level[live].astype(np.int64) * n + level[live + step]
        order = np.argsort(pairs, kind="stable")
        ordered = pairs[order]
        first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        number = np.cumsum(first) - 1
        repeats = np.bincount(number)[number] > 1
        if not repeats.any():
            return levels
        level = own.copy()
        at = live[order[repeats]]
        level[at] = number[repeats]
        levels.append(level)
        step *= 2


def forwards(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words agree from `i` and from `j` on (i < j)."""
    n, moved = len(levels[0]), np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = j + moved < n
        a, b = np.where(inside, i + moved, 0), np.where(inside, j + moved, 0)
        moved += (inside & (levels[k][a] == levels[k][b])).astype(np.int64) << k
    return moved


def backwards(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words agree before `i` and before `j` (i < j)."""
    moved = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = i - moved - (1 << k), j - moved - (1 << k)
        inside = a >= 0
        moved += (inside & (levels[k][np.where(inside, a, 0)] == levels[k][np.where(inside, b, 0)])).astype(np.int64) << k
    return moved


def runs_of(words: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of all runs, by start, then period.

    `words` are texts laid end to end, each followed by a separator that occurs once; `longest` bounds the words of a text.
    """
    levels = named(words)
    base = levels[0]
    found: list[np.ndarray] = [np.zeros((3, 0), np.int64)]
    held: list[tuple[np.ndarray, np.ndarray]] = []
    many = 0
    for q in range(1, longest // TIMES + 1):
        step = max(FEWEST, TIMES * q) - q
        # names of words that occur once differ, so separators meet nothing
        i = np.flatnonzero(base[: len(base) - q : step] == base[q::step]) * step
        if len(i):
            held.append((i, np.full(len(i), q)))
            many += len(i)
        if many > EXTENDED:
            found.append(_extended(levels, held))
            held, many = [], 0
    if held:
        found.append(_extended(levels, held))
    starts, lengths, periods = _distinct(np.concatenate(found, axis=1))
    order = np.lexsort((periods, starts))
    return starts[order], lengths[order], periods[order]


def _distinct(runs: np.ndarray) -> np.ndarray:
    """Of equal stretches the one with the smallest period."""
    runs = runs[:, np.lexsort(runs[::-1])]
    return runs[:, np.concatenate([[True], (runs[:2, 1:] != runs[:2, :-1]).any(axis=0)])] if runs.shape[1] else runs


def _extended(levels: list[np.ndarray], candidates: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Starts, lengths and periods of the runs that hold pairs (i, i + q)."""
    i, q = (np.concatenate(x) for x in zip(*candidates, strict=True))
    back = backwards(levels, i, i + q)
    runs = np.stack([i - back, back + forwards(levels, i, i + q) + q, q])
    return _distinct(runs[:, runs[1] >= np.maximum(FEWEST, TIMES * q)])


def best(starts: list[int], lengths: list[int], periods: list[int]) -> int:
    """The run of greatest exact length / period; of ties the smallest start, then period."""
    at = 0
    for k in range(1, len(starts)):
        ahead = lengths[k] * periods[at] - lengths[at] * periods[k]
        if ahead > 0 or ahead == 0 and (starts[k], periods[k]) < (starts[at], periods[at]):
            at = k
    return at


def _batches(texts: list[list[bytes]]) -> Iterator[list[int]]:
    """Places of the texts, some at a time: of like length, `TOGETHER` words at most or a single one."""
    held: list[int] = []
    words = 0
    for at in sorted(range(len(texts)), key=lambda k: len(texts[k])):
        n = len(texts[at])
        if held and (words + n > TOGETHER or n > 2 * len(texts[held[0]]) + 64):
            yield held
            held, words = [], 0
        held.append(at)
        words += n
    if held:
        yield held


def scan(texts: list[list[bytes]]) -> list[tuple[list[int], list[int], list[int]]]:
    """Starts, lengths and periods of the runs of each list of words."""
    out: list[tuple[list[int], list[int], list[int]]] = [([], [], [])] * len(texts)
    for some in _batches(texts):
        longest = len(texts[some[-1]])
        if longest < FEWEST:
            continue
        numbers: dict[bytes, int] = {}
        flat: list[int] = []
        firsts = []
        for at in some:
            firsts.append(len(flat))
            flat += [numbers.setdefault(w, len(numbers)) for w in texts[at]]
            flat.append(-1)
        words = np.array(flat, np.int64)
        ends = np.flatnonzero(words < 0)
        words[ends] = len(numbers) + np.arange(len(ends))
        starts, lengths, periods = runs_of(words, longest)
        owner = np.searchsorted(firsts, starts, "right") - 1
        for k in np.unique(owner).tolist():
            mine = owner == k
            out[some[k]] = ((starts[mine] - firsts[k]).tolist(), lengths[mine].tolist(), periods[mine].tolist())
    return out


def collapsed(words: list[bytes], starts: list[int], lengths: list[int], periods: list[int]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if not starts:
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.add(starts, periods), 1)
    np.add.at(edges, np.add(starts, lengths), -1)
    kept = np.cumsum(edges[:-1]) == 0
    return b" ".join([words[k] for k in np.flatnonzero(kept).tolist()])


def _row(words: list[bytes], runs: tuple[list[int], list[int], list[int]], wanted: list[str]) -> dict[str, object]:
    starts, lengths, periods = runs
    out: dict[str, object] = {"n_words": len(words), "n_runs": len(starts)}
    if starts:
        k = best(starts, lengths, periods)
        out |= {"start": starts[k], "length": lengths[k], "period": periods[k], "exponent_milli": 1000 * lengths[k] // periods[k]}
    if "runs" in wanted:
        out["runs"] = [{"start": s, "length": n, "period": p} for s, n, p in zip(starts, lengths, periods, strict=True)]
    if "runs_sha256" in wanted:
        out["runs_sha256"] = hashlib.sha256("".join([f"{s},{n},{p}\n" for s, n, p in zip(starts, lengths, periods, strict=True)]).encode()).hexdigest()
    if "collapsed" in wanted or "collapsed_sha256" in wanted:
        text = collapsed(words, starts, lengths, periods)
        out |= {"collapsed": text.decode("utf-8", "replace") if "collapsed" in wanted else None, "collapsed_sha256": hashlib.sha256(text).hexdigest()}
    return out


_KINDS = {"long": pa.int64(), "string": pa.string(), COLUMNS["runs"]: pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))}


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None, columns: tuple[str, ...] = ("n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed")) -> DataFrame:
    """Each row's `keep` columns (all but the text, unless given) and, of `COLUMNS`, those asked for: its runs, the greatest of them, and the text without repeats.

    `start` counts words from 0; `exponent_milli` is 1000 * length / period, rounded down; these are null without a run.
    """
    taken = {c.lower() for c in columns}
    keep = [c for c in (keep if keep is not None else [c for c in docs.columns if c.lower() != text.lower()]) if c.lower() not in taken]
    wanted = list(columns)
    kinds = [_KINDS[COLUMNS[c]] for c in wanted]
    names = [*keep, *wanted]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, BYTES):
            texts = [(t or "").encode().split() for t in batch.column(0).to_pylist()]  # bytes part at just the six blanks of ASCII
            rows = [_row(words, runs, wanted) for words, runs in zip(texts, scan(texts), strict=True)]
            made = [pa.array([r.get(c) for r in rows], kind) for c, kind in zip(wanted, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], names)
        give_back()

    kept = docs.select(*[F.col(f"`{c}`") for c in keep]).schema
    schema = StructType([*kept.fields, *StructType.fromDDL(", ".join(f"{c} {COLUMNS[c]}" for c in wanted)).fields])
    return small_batches(docs).select(F.col(f"`{text}`").cast("string"), *[F.col(f"`{c}`") for c in keep]).mapInArrow(work, schema)


def with_repeats(key: Column, text: Column) -> Column:
    """A text in which, for one in ten keys, words repeat from some word on with some period, as a hash of the key says; null keys stay as they are.

    With h the CRC-32 of the key in decimal and g = floor(h / 10): if h % 10 = 0 and there are n > 0 words, word i >= a becomes
    word a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(key.cast("string"))
    g = F.floor(h / F.lit(10)).cast("long")
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def planted(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        place = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.array_join(F.transform(place, lambda i: F.get(w, i)), " ")

    made = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, planted(w))), F.lit(0))
    return F.when(h % 10 == 0, F.coalesce(made, text)).otherwise(text)
