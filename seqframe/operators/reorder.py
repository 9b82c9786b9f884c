"""One-to-one matching of records that keeps an order.

Both joins are multiset joins: equal keys on the two sides are numbered, and a
number is matched with the same number. A key's rows are numbered by one window, after
the only shuffle of both sides, but not those of keys that have over `SUPPORT` of all rows and over `SLICE` rows (a
poly-N read): these, 1 / `SUPPORT` keys at most, are taken in slices of `SLICE`
ordinals, the slices counted, and the counts of those before added, so that no
large key is one task's work.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqframe.functions.sequence import bkdr_hash, chop2, is_strict, trim_mate_suffix, with_suffix

#: Share of all rows from which a key is sliced; ordinals of a slice, and rows from which a key is sliced; bases of a source chunk.
SUPPORT, SLICE, CHUNK_BASES = 1 / 1000, 1 << 20, 1_000_000_000
#: Buckets that rows are counted in to find large keys; source reads whose bases are summed together to find the ends of chunks.
BUCKETS, READS = 1 << 14, 1 << 20
#: Reads near the ends of chunks that the driver walks over at once.
WALKED = 1 << 22
#: Chunks of a source at most, and ranges of ordinals that are told how many chunks start before them.
MOST_CHUNKS, PARTS = 1 << 22, 1 << 18
_SPAN = 1 << 40


def frequent(rows: DataFrame, key: str, most: int, support: float = SUPPORT) -> list:
    """Values of `key` that have over `most` rows and over `support` of all; 1 / `support` at most.

    Rows are counted first: with `most` or fewer there are none. Else they are counted by a hash of the key into a fixed number of
    buckets, combined before the shuffle; only if a bucket has that many are its keys counted each.
    """
    known = rows.select(key).filter(F.col(key).isNotNull())
    total = known.count()
    many = max(most, support * total)
    if total <= many:
        return []
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS))
    sizes = known.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).filter(F.col("n") > many).toArrow()  # 1 / `support` rows at most
    heavy = sizes.column("bucket").to_pylist()
    if not heavy:
        return []
    counted = known.filter(bucket.isin(heavy)).groupBy(key).count().filter(F.col("count") > many)
    return counted.toArrow().column(0).to_pylist()


def _sliced(rows: DataFrame, key: str, order: Column, slice_: int = SLICE) -> DataFrame:
    """`rows` of a few large keys with their number `_k` (from 1) among equal `key`s by `order`, a distinct long."""
    cut = rows.withColumn("_o", order.cast("bigint")).withColumn("_slice", F.col("_o") - F.pmod(F.col("_o"), F.lit(slice_)))
    local = cut.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_slice").orderBy("_o")))
    counts = cut.groupBy(key, "_slice").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).select(key, "_slice", "_before")
    return local.join(before, [key, "_slice"], "left").withColumn("_k", F.col("_r") + F.coalesce("_before", F.lit(0))).drop("_o", "_slice", "_r", "_before")


def _paired(left: DataFrame, right: DataFrame, key: str, left_order: Column, right_order: Column) -> DataFrame:
    """Rows of `left` with those of `right` by a single shuffle by `key`: both sides are numbered where they meet, and equal numbers follow each other."""

    def side(rows: DataFrame, number: int, order: Column) -> DataFrame:
        own = F.struct(*[c for c in rows.columns if c != key])
        other = F.lit(None).cast((right if number else left).drop(key).schema)
        return rows.select(F.col(key), F.lit(number).cast("tinyint").alias("_side"), order.cast("bigint").alias("_o"), *(x.alias(n) for x, n in zip((own, other) if number else (other, own), ("_left", "_right"), strict=True)))

    both = side(right, 0, right_order).unionByName(side(left, 1, left_order)).repartition(key)
    numbered = both.withColumn("_k", F.row_number().over(Window.partitionBy(key, "_side").orderBy("_o")))
    before = F.lag("_right").over(Window.partitionBy(key, "_k").orderBy("_side"))
    met = numbered.withColumn("_right", F.when(F.col(key).isNotNull(), before)).filter("_side = 1")
    return met.select(key, *[F.col(f"_{n}.`{c}`").alias(c) for n, rows in (("left", left), ("right", right)) for c in rows.columns if c != key])


def multiset_join(left: DataFrame, right: DataFrame, key: str, left_order: Column, right_order: Column, slice_: int = SLICE) -> DataFrame:
    """Each row of `left` with one row of `right` of equal `key` or with nulls, each used once at most: the k-th by order with the k-th.

    The two sides' other columns have names of their own. Rows of a key that is large on either side are numbered in slices and joined by key and
    number; all others are shuffled once, by key.
    """
    large = sorted({*frequent(left, key, slice_), *frequent(right, key, slice_)})
    if not large:
        return _paired(left, right, key, left_order, right_order)
    common = F.coalesce(F.col(key).isin(large), F.lit(False))
    rare = _paired(left.filter(~common), right.filter(~common), key, left_order, right_order)
    a, b = (_sliced(x.filter(common), key, order, slice_) for x, order in ((left, left_order), (right, right_order)))
    return rare.unionByName(a.join(b, [key, "_k"], "left").drop("_k"))


def constant_length_chunk(ordinal: Column, length: int, chunk_bases: int = CHUNK_BASES) -> Column:
    """The chunk of a source read by its ordinal (from 0), all reads having `length` bases."""
    return F.floor(ordinal / -(-chunk_bases // length)).cast("bigint")


def _windows(target: int, chunk_bases: int, longest: int, mean: float, total: int, rows: int) -> list[list[int]]:
    """Ranges of running totals, disjoint and in order, that the next chunks' ends lie in, as many chunks as give about `rows` reads; one at least.

    Each end passes its mark by less than the longest read, so the k-th after a known one lies in a range of k such lengths.
    """
    out: list[list[int]] = []
    k, reads = 1, 0.0
    while target <= total and (k == 1 or reads <= rows):
        low, high = target, target + (k + 1) * longest  # one read more: the next chunk begins with it
        if out and low <= out[-1][1]:
            out[-1][1] = high
        else:
            out.append([low, high])
        reads += (k + 1) * longest / mean
        k, target = k + 1, target + chunk_bases
    return out


def chunk_starts(source: DataFrame, chunk_bases: int = CHUNK_BASES, reads: int = READS, rows: int = WALKED) -> list[int]:
    """W5 for reads of any length: the first ordinal (`sid`, a distinct long from 0 on) of each chunk of a source.

    A chunk ends with the read that brings its bases to `chunk_bases`. Empty reads are none. One job sums bases by ranges of `reads`
    ordinals. Many small chunks are found by ranges: see `_starts_by_ranges`. For few large ones: where a chunk ends is known but for the lengths by which earlier ends passed their marks; so one more job brings the
    reads around the marks of many chunks at once, about `rows` of them, and the driver walks from end to end. With reads of like lengths that is
    a job for some sqrt(2 * rows) chunks: one for any source of fewer. The list has a number for every `chunk_bases` bases of the source.
    """
    each = source.filter("seq <> ''").select(F.col("sid").cast("bigint").alias("sid"), F.length("seq").cast("bigint").alias("l"), F.floor(F.col("sid") / reads).cast("bigint").alias("range"))
    sums = each.groupBy("range").agg(F.sum("l").alias("l"), F.max("l").alias("longest"), F.min("sid").alias("first"), F.count("*").alias("n")).toArrow().sort_by("range")
    if not sums.num_rows:
        return []
    ranges, bases, n = (sums.column(c).to_numpy() for c in ("range", "l", "n"))
    until = np.cumsum(bases)
    longest, total, mean = int(sums.column("longest").to_numpy().max()), int(until[-1]), float(until[-1] / n.sum())
    starts, held = [int(sums.column("first").to_numpy().min())], 0
    each_size = chunk_bases / mean  # reads of a chunk
    # reads that the next chunk's end may fall on, of all ranges, against chunks that one job's windows hold
    if min(each_size, reads) * len(ranges) / rows <= total / chunk_bases / max(1.0, (2 * rows * mean / longest) ** 0.5):
        return _starts_by_ranges(each, sums, chunk_bases, max(1, int(rows // min(each_size + 1, reads))))
    while held + chunk_bases < total:
        windows = _windows(held + chunk_bases, chunk_bases, longest, mean, total, rows)
        lows, highs = np.array(windows, np.int64).T
        asked = np.unique(np.concatenate([np.arange(np.searchsorted(until, low), min(np.searchsorted(until, high), len(ranges) - 1) + 1) for low, high in windows]))
        before = dict(zip(ranges[asked].tolist(), (until - bases)[asked].tolist(), strict=True))

        def near(here: int, sid: np.ndarray, c: np.ndarray, before: dict = before, lows: np.ndarray = lows, highs: np.ndarray = highs) -> pa.Table:
            c = c + before[here]
            at = np.searchsorted(lows, c, "right") - 1
            inside = (at >= 0) & (c <= highs[np.maximum(at, 0)])
            return pa.table({"c": c[inside], "sid": sid[inside]})

        found = _by_range(each, list(before), near, "c long, sid long").toArrow().sort_by("c")
        c, sid = found.column("c").to_numpy(), found.column("sid").to_numpy()
        for low, high in windows:
            while low <= held + chunk_bases <= high + 1 - 2 * longest:  # the end and the read after it are there
                at = int(np.searchsorted(c, held + chunk_bases))
                if at == len(c) or c[at] == total:  # no read comes after
                    return starts
                held = int(c[at])
                starts.append(int(sid[at + 1]))
    return starts


def _by_range(each: DataFrame, ranges: list[int], work: Callable[[int, np.ndarray, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """`work` done on each of these ranges of reads: its number, ordinals in order and running total of bases."""

    def group(table: pa.Table) -> pa.Table:
        sid, l = table.column("sid").to_numpy(), table.column("l").to_numpy()
        order = np.argsort(sid)
        return work(table.column("range")[0].as_py(), sid[order], np.cumsum(l[order]))

    return each.filter(F.col("range").between(min(ranges), max(ranges))).groupBy("range").applyInArrow(_of_those(group, set(ranges), schema), schema)


def _of_those(group: Callable[[pa.Table], pa.Table], ranges: set[int], schema: str) -> Callable[[pa.Table], pa.Table]:
    """`group`, but for ranges that aren't asked for no rows."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.list_(pa.int64()) if "array" in f else pa.int64() for f in schema.split(", ")]
    none = pa.table([pa.array([], k) for k in kinds], names=names)
    return lambda table: group(table) if table.column("range")[0].as_py() in ranges else none


def _next_ends(c: np.ndarray, chunk_bases: int) -> np.ndarray:
    """For a chunk that ends with each read the place of the read that the next one ends with; the number of reads if that is none of these."""
    return np.searchsorted(c, c + chunk_bases)


def _left(c: np.ndarray, chunk_bases: int) -> tuple[np.ndarray, np.ndarray]:
    """What the open chunk still needs behind a range with running total `c`, for all that it may need before it.

    If it needs up to `upper[i]` bases, and more than `upper[i - 1]`, it needs `needs[i]` behind; if more than the last of these, no chunk ends here.
    """
    n, then = len(c), _next_ends(c, chunk_bases)
    last = np.where(then < n, then, np.arange(n))
    while (further := last[last]).tobytes() != last.tobytes():  # twice as many chunks a step
        last = further
    first = min(int(np.searchsorted(c, chunk_bases)) + 1, n)  # reads that the open chunk may end with
    upper, needs = c[:first], chunk_bases - (c[-1] - c[last[:first]])
    edge = np.append(needs[1:] != needs[:-1], True)
    return upper[edge], needs[edge]


def _starts_by_ranges(each: DataFrame, sums: pa.Table, chunk_bases: int, at_once: int) -> list[int]:
    """The same for chunks of any number: a job gives, for `at_once` ranges, what is left of the open chunk behind each for all that it may be before;
    the driver runs through these tables, and then one job walks through all ranges, each by itself."""
    ranges, bases, first = (sums.column(c).to_pylist() for c in ("range", "l", "first"))

    def left(here: int, sid: np.ndarray, c: np.ndarray) -> pa.Table:
        upper, needs = _left(c, chunk_bases)
        return pa.table({"range": [here], "upper": [upper], "needs": [needs]}, pa.schema([("range", pa.int64()), ("upper", pa.list_(pa.int64())), ("needs", pa.list_(pa.int64()))]))

    entered, need = {}, chunk_bases
    for i in range(0, len(ranges), at_once):
        found = _by_range(each, ranges[i : i + at_once], left, "range long, upper array<long>, needs array<long>").toArrow()
        place = {r: k for k, r in enumerate(found.column("range").to_pylist())}
        for r, total in zip(ranges[i : i + at_once], bases[i : i + at_once], strict=True):
            entered[r] = need
            upper, needs = (found.column(c)[place[r]].values.to_numpy() for c in ("upper", "needs"))
            at = int(np.searchsorted(upper, need))
            need = need - total if at == len(upper) else int(needs[at])
    following = dict(zip(ranges, [*first[1:], None], strict=True))

    def walk(here: int, sid: np.ndarray, c: np.ndarray) -> pa.Table:
        then, at, out = _next_ends(c, chunk_bases), int(np.searchsorted(c, entered[here])), []
        while at < len(c):
            out.append(int(sid[at + 1]) if at + 1 < len(c) else following[here])
            at = int(then[at])
        return pa.table({"sid": pa.array([x for x in out if x is not None], pa.int64())})

    return [first[0], *np.sort(_by_range(each, ranges, walk, "sid long").toArrow().column("sid").to_numpy()).tolist()]


def with_chunks(source: DataFrame, starts: list[int], name: str = "chunk") -> DataFrame:
    """`source` with the chunk, from 0, of each read, by the ordinals that chunks start at.

    The ordinals up to the last start are cut into even ranges, about one a chunk and `PARTS` at most; a row a range, with the chunks that start before it and
    those that start in it, is broadcast, and a read looks at its range's row alone.
    """
    if len(starts) >= MOST_CHUNKS:
        raise ValueError(f"{len(starts)} chunks; take larger ones, {MOST_CHUNKS - 1} at most")
    marks = np.array(starts[1:], np.int64)
    span = int(marks[-1]) + 1 if len(marks) else 1
    width = -(-span // max(1, min(len(marks), PARTS)))
    edges = np.arange(span // width + 1, dtype=np.int64) * width
    base = np.searchsorted(marks, edges)
    inside = pa.ListArray.from_arrays(pa.array([*base.tolist(), len(marks)], pa.int32()), pa.array(marks))
    table = F.broadcast(source.sparkSession.createDataFrame(pa.table({"_range": np.arange(len(edges)), "_before": base.astype(np.int64), "_marks": inside})))
    at = F.least(F.floor(F.col("sid") / F.lit(width)).cast("bigint"), F.lit(len(edges) - 1).cast("bigint"))
    joined = source.withColumn("_range", at).join(table, "_range")
    return joined.withColumn(name, F.col("_before") + F.size(F.filter("_marks", lambda x: x <= F.col("sid")))).drop("_range", "_before", "_marks")


def _strict(rows: DataFrame, strict: bool) -> DataFrame:
    if not strict:
        return rows
    sound = F.when(is_strict(F.col("seq")), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("a base that is none of A, C, G, N, T in "), F.col("seq"))).cast("boolean"))
    return rows.filter(sound)


def empty_reads(bare: DataFrame, source: DataFrame) -> DataFrame:
    """how many reads without bases each side has; these take no part."""
    def count(rows: DataFrame, name: str) -> DataFrame:
        return rows.select((F.coalesce(F.col("seq"), F.lit("")) == "").cast("bigint").alias("e"), F.lit(name).alias("side"))

    both = count(bare, "bare").unionByName(count(source, "source"))
    sums = [F.coalesce(F.sum(F.when(F.col("side") == x, F.col("e"))), F.lit(0)).cast("bigint").alias(f"{x}_empty") for x in ("bare", "source")]
    return both.agg(*sums)


def reorder_by_sequence(bare: DataFrame, source: DataFrame, tie: str = "lifo", chunk: Column | None = None, unmatched: str = "keep", slice_: int = SLICE, strict_alphabet: bool = False) -> DataFrame:
    """Bare reads (`rid`, `seq`) with name, comment and quality of a source read (`sid`, `name`, `comment`, `seq`, `qual`) of equal bases.

    Bare reads are served in order. Of equal source reads the last comes first (`lifo`), within each `chunk` (a long made of source
    columns, under 2^22), or the first (`fifo`). Empty sequences are no reads (`empty_reads` counts them). `unmatched` bare reads are kept
    without a name, dropped, or fail. With `strict_alphabet` any base but A, C, G, N and T fails.
    """
    if tie not in ("lifo", "fifo") or unmatched not in ("keep", "drop", "fail"):
        raise ValueError("tie must be lifo or fifo; unmatched keep, drop or fail")
    sid = F.col("sid") if tie == "fifo" else F.lit(_SPAN - 1) - F.col("sid")
    order = sid if chunk is None else chunk * _SPAN + sid
    reads, pool = (_strict(x.filter("seq <> ''"), strict_alphabet) for x in (bare.select("rid", "seq"), source))
    out = multiset_join(reads, pool, "seq", F.col("rid"), order, slice_)
    out = out.select("rid", "name", "comment", "seq", "qual", F.col("sid").isNotNull().alias("_met"))
    if unmatched == "drop":
        out = out.filter("_met")
    if unmatched == "fail":
        out = out.filter(F.when(F.col("_met"), F.lit(True)).otherwise(F.raise_error(F.lit("a bare read has no source")).cast("boolean")))
    return out.drop("_met")


def match_report(bare: DataFrame, source: DataFrame) -> DataFrame:
    """Reads, matched and unmatched bare reads, bases, and repeated source reads; sequences are combined before any shuffle of rows."""
    a = bare.filter("seq <> ''").groupBy("seq").agg(F.count("*").alias("_b"))
    b = source.filter("seq <> ''").groupBy("seq").agg(F.count("*").alias("_s"))
    both = a.join(b, "seq", "full_outer").select(F.length("seq").cast("bigint").alias("_l"), F.coalesce("_b", F.lit(0)).alias("_b"), F.coalesce("_s", F.lit(0)).alias("_s"))

    def total(x: Column, name: str) -> Column:
        return F.coalesce(F.sum(x), F.lit(0)).cast("bigint").alias(name)

    met = F.least("_b", "_s")
    return both.agg(
        total(F.col("_b"), "bare_reads"),
        total(F.col("_s"), "source_reads"),
        total(met, "matched"),
        total(F.col("_b") - met, "unmatched"),
        total(F.col("_l") * F.col("_b"), "bare_bases"),
        total(F.col("_l") * F.col("_s"), "source_bases"),
        total(F.greatest(F.col("_s") - 1, F.lit(0)), "source_duplicates"),
    )


def mate_key(name: Column, suffix: str) -> Column:
    if suffix == "chop2":
        return F.coalesce(chop2(name), F.raise_error(F.lit("a read name has fewer than two characters")).cast("string"))
    if suffix == "slash_digit":
        return trim_mate_suffix(name)
    raise ValueError("suffix must be chop2 or slash_digit")


def reorder_mates(first: DataFrame, second: DataFrame, suffix: str = "chop2", unmatched: str = "fail", slice_: int = SLICE) -> DataFrame:
    """The reads of `second` in the order of `first` (both `rid`, `name`; `second` with more columns), named like `first` with /2.

    Equal names are paired in order. A first read without a mate fails, or is left out (`unmatched='drop'`); mates without a first read are.
    """
    if unmatched not in ("fail", "drop"):
        raise ValueError("unmatched must be fail or drop")
    a = first.select("rid", mate_key(F.col("name"), suffix).alias("_name"))
    b = second.withColumn("_name", mate_key(F.col("name"), suffix)).withColumnRenamed("rid", "_rid2").drop("name")
    out = multiset_join(a, b, "_name", F.col("rid"), F.col("_rid2"), slice_)
    met = F.col("_rid2").isNotNull()
    if unmatched == "fail":
        met = F.when(met, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no mate for "), F.col("_name"))).cast("boolean"))
    return out.filter(met).select("rid", with_suffix(F.col("_name")).alias("name"), *[c for c in second.columns if c not in ("rid", "name")])


def mates_missing(first: DataFrame, second: DataFrame, suffix: str = "chop2", slice_: int = SLICE) -> DataFrame:
    """First reads (`rid`, `name` without suffix) that find no mate."""
    a = first.select("rid", mate_key(F.col("name"), suffix).alias("name"))
    b = second.select(mate_key(F.col("name"), suffix).alias("name"), F.col("rid").alias("_rid2"))
    return multiset_join(a, b, "name", F.col("rid"), F.col("_rid2"), slice_).filter("_rid2 is null").select("rid", "name")


def hash_collisions(names: DataFrame, name: str = "name") -> DataFrame:
    """Names, distinct hashes, and the share of names whose hash an earlier one has (equal names count)."""
    each = names.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("_n")).withColumn("_h", bkdr_hash(F.col("name")))
    hashes = each.groupBy("_h").agg(F.sum("_n").alias("_n"))
    return hashes.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("names"), F.count("*").alias("hashes")).withColumn("collision_rate", F.try_divide((F.col("names") - F.col("hashes")).cast("double"), F.col("names")))
