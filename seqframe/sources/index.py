"""J5, X15, F7 by random access: an index of FASTA files, written once, and bases read by byte ranges.

`write_index` reads the files once, in pieces, and writes two Parquet tables:

- `records`: `file_id`, `path`, `rec_no` (from 0 in its file), `name`, `comment`, `l_seq`;
- `segments`: stretches of a record whose lines have one layout: `base_start` (from 0 in the record), `bases`, `offset` (the byte of
  the first base), `line_bases`, `line_bytes`. A record of even lines has two a piece, one of them its last line.

A piece numbers its headers and bases from its own start; a scan over pieces, a row each, adds what came before. `fetch` joins
requests with segments, makes byte ranges of them by expressions, and reads those alone: what is read is about what is asked for,
whatever the files' sizes.

Only plain FASTA has such places; compressed files and records with qualities are an error. Text before the first line with `>` is skipped.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqframe.sources.fastx import header_parts
from seqframe.sources.files import GZIP, found, reached, store_of

#: Bytes of a piece of a file, and of a range that is read at once.
PIECE_BYTES, RANGE_BYTES = 64 << 20, 16 << 20
_BLOCK = 4 << 20

_EVENT = "file_id int, path string, piece int, header boolean, local_no int, name string, comment string, base_start long, bases long, offset long, line_bases long, line_bytes long"


def _lines(path: str, start: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, bytes]]]]:
    """Places, bases and bytes of the lines that begin in [start, end), some at a time, with the text of those that begin with `>`, `@` or `+`."""
    store, inner = store_of(path)
    with store.open_input_file(inner) as raw:
        stream = io.BufferedReader(raw, 1 << 20)
        if start == 0 and stream.peek(2)[:2] == GZIP:
            raise ValueError(f"{path} is compressed; only plain FASTA has byte ranges")
        at = start
        if start:
            stream.seek(start - 1)
            at = start - 1 + len(stream.readline())
        while at < end:
            body = stream.read(min(_BLOCK, end - at))
            if not body:
                return
            if not body.endswith(b"\n"):
                body += stream.readline()
            buffer = np.frombuffer(body, np.uint8)
            ends = np.flatnonzero(buffer == 10)
            if not body.endswith(b"\n"):
                ends = np.append(ends, len(body))
            starts = np.concatenate([[0], ends[:-1] + 1])
            sizes = ends - starts
            bases = sizes - ((sizes > 1) & (buffer[np.maximum(ends - 1, 0)] == 13))
            first = buffer[np.minimum(starts, len(body) - 1)]
            marks = np.flatnonzero((sizes > 0) & np.isin(first, (62, 64, 43)))
            texts = [(i, body[starts[i] : starts[i] + bases[i]]) for i in marks.tolist()]
            yield at + starts, bases, np.minimum(ends + 1, len(body)) - starts, texts
            at += len(body)


def _piece(file_id: int, path: str, piece: int, start: int, end: int) -> Iterator[tuple]:
    """Events of a piece in order: headers, and segments of lines of one layout; bases from the last header in the piece, or from its start."""
    number, base = 0, 0
    held: list[int] | None = None  # first base, bases, offset, bases and bytes of a line, bytes so far

    def closed() -> Iterator[tuple]:
        if held:
            yield (file_id, path, piece, False, number, None, None, held[0], held[1], held[2], held[3], held[4])

    for places, bases, sizes, texts in _lines(path, start, end):
        heads = dict(texts)
        # lines of equal layout in a row are one stretch; headers and blank lines are stretches of their own
        kind = np.zeros(len(places), np.int64)
        kind[list(heads)] = 1 + np.arange(len(heads))
        edges = np.flatnonzero((bases[1:] != bases[:-1]) | (sizes[1:] != sizes[:-1]) | (kind[1:] != kind[:-1])) + 1
        for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(places)], strict=True):
            if i in heads:
                text = heads[i]
                if text[:1] == b"+":
                    raise ValueError(f"{path} has records with qualities at byte {places[i]}; only FASTA can be indexed")
                yield from closed()
                held, base, number = None, 0, number + 1
                name, comment = header_parts(text, 1)
                yield (file_id, path, piece, True, number, name, comment, 0, 0, int(places[i]), 0, 0)
                continue
            n, width, size = int(bases[i]), int(sizes[i]), j - i
            if held and n == held[3] and width == held[4] and int(places[i]) == held[2] + held[5]:
                held[1] += n * size
                held[5] += width * size
            else:
                yield from closed()
                held = [base, n * size, int(places[i]), n, width, width * size] if n else None
            base += n * size
    yield from closed()
    # a row that says how many headers and how many bases after the last of them the piece has, so that pieces without events count too
    yield (file_id, path, piece, None, number, None, None, base, 0, start, 0, 0)


def _events(spark: SparkSession, files: list[tuple[str, int]], piece_bytes: int) -> DataFrame:
    pieces = [(i, path, k, at, min(at + piece_bytes, size)) for i, (path, size) in enumerate(files) for k, at in enumerate(range(0, max(size, 1), piece_bytes))]
    names = [f.split()[0] for f in _EVENT.split(", ")]
    kinds = [{"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "long": pa.int64()}[f.split()[1]] for f in _EVENT.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows: list[tuple] = []
                for row in _piece(*piece):
                    rows.append(row)
                    if len(rows) == 1 << 16:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows = spark.createDataFrame(pieces, "file_id int, path string, piece int, start long, end long")
    return rows.repartition(max(1, len(pieces)), "file_id", "piece").mapInArrow(work, _EVENT)


def write_index(spark: SparkSession, folder: str, *paths: str, piece_bytes: int = PIECE_BYTES) -> str:
    """Index FASTA files (or those below folders) into `folder`, which is returned; what was there is replaced."""
    files = [f for p in paths for f in found([reached(spark, p)])]
    _events(spark, files, piece_bytes).write.mode("overwrite").parquet(f"{folder}/events")
    events = spark.read.parquet(f"{folder}/events")
    # a row a piece: how many headers come before it, and how many bases the record that it begins in has had
    pieces = events.filter("header is null").select("file_id", "piece", F.col("local_no").alias("heads"), F.col("base_start").alias("tail"))
    order = Window.partitionBy("file_id").orderBy("piece")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    scan = pieces.withColumn("before", F.coalesce(F.sum("heads").over(earlier), F.lit(0))).withColumn("upto", F.sum("heads").over(order))
    # bases since the last header: pieces up to and with the one of that header have the same `upto`
    same = Window.partitionBy("file_id", "upto").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)
    scan = scan.withColumn("since", F.sum("tail").over(same)).withColumn("carried", F.coalesce(F.lag("since").over(order), F.lit(0)))
    placed = events.join(F.broadcast(scan.select("file_id", "piece", "before", "carried")), ["file_id", "piece"])
    number = (F.col("before") + F.col("local_no") - 1).alias("rec_no")
    start = F.when(F.col("local_no") == 0, F.col("base_start") + F.col("carried")).otherwise(F.col("base_start"))
    segments = placed.filter("header = false").select("file_id", "path", number, start.alias("base_start"), "bases", "offset", "line_bases", "line_bytes").filter("rec_no >= 0")
    segments.write.mode("overwrite").parquet(f"{folder}/segments")
    lengths = spark.read.parquet(f"{folder}/segments").groupBy("file_id", "rec_no").agg(F.sum("bases").alias("l_seq"))
    heads = placed.filter("header").select("file_id", "path", number, "name", "comment")
    records = heads.join(lengths, ["file_id", "rec_no"], "left").withColumn("l_seq", F.coalesce("l_seq", F.lit(0)))
    records.select("file_id", "path", "rec_no", "name", "comment", "l_seq").write.mode("overwrite").parquet(f"{folder}/records")
    return folder


def index_records(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/records")


_RANGE = "name string, start int, length int, place long, bases string, n_bytes long"


def read_ranges(ranges: DataFrame) -> DataFrame:
    """`name`, `start`, `length`, `place`, `bases` and `n_bytes` (read for it) of byte ranges (`path`, `first`, `until`, `column`, `line_bases`, `line_bytes`), in order of files and places."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, stream = None, None
        for batch in batches:
            out = []
            for path, first, until, column, line_bases, line_bytes, *asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != opened:
                    store, inner = store_of(path)
                    opened, stream = path, store.open_input_file(inner)
                raw = stream.read_at(until - first, first)
                kept = (np.arange(len(raw)) + column) % line_bytes < line_bases
                out.append((*asked, np.frombuffer(raw, np.uint8)[kept].tobytes().decode(), len(raw)))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 6, kinds, strict=True)], [f.split()[0] for f in _RANGE.split(", ")])

    near = ranges.repartitionByRange("path", "first").sortWithinPartitions("path", "first")
    return near.select("path", "first", "until", "column", "line_bases", "line_bytes", "name", "start", "length", "place").mapInArrow(work, _RANGE)


def ranges_of(spark: SparkSession, folder: str, requests: DataFrame, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """The distinct requests (`name`, `start` from 1, `length`) with the record that answers them, and the byte ranges that hold their bases."""
    asked = requests.select("name", F.col("start").cast("int").alias("start"), F.col("length").cast("int").alias("length")).distinct()
    records = index_records(spark, folder).join(asked.select("name").distinct(), "name", "left_semi")
    first = records.groupBy("name").agg(F.min_by(F.struct("file_id", "rec_no", "comment", "l_seq"), F.struct("file_id", "rec_no")).alias("r")).select("name", "r.*")
    answered = asked.join(first, "name").withColumn("in_bounds", (F.col("start") >= 1) & (F.col("start") - 1 + F.col("length") <= F.col("l_seq")))
    wanted = answered.filter(F.col("in_bounds") & (F.col("length") > 0)).withColumn("_from", F.col("start").cast("long") - 1).withColumn("_to", F.col("start").cast("long") - 1 + F.col("length"))
    met = wanted.join(spark.read.parquet(f"{folder}/segments"), ["file_id", "rec_no"]).filter((F.col("base_start") < F.col("_to")) & (F.col("base_start") + F.col("bases") > F.col("_from")))
    a, b = F.greatest(F.col("_from") - F.col("base_start"), F.lit(0)), F.least(F.col("_to") - F.col("base_start"), F.col("bases"))
    step = F.greatest(F.lit(range_bytes).cast("long") * F.col("line_bases") / F.col("line_bytes"), F.lit(1)).cast("long")
    parts = met.withColumn("_a", a).withColumn("_b", b).withColumn("_at", F.explode(F.sequence("_a", F.col("_b") - 1, step)))
    last = F.least(F.col("_at") + step, F.col("_b")) - 1

    def place(base):
        return F.col("offset") + F.floor(base / F.col("line_bases")).cast("long") * F.col("line_bytes") + base % F.col("line_bases")

    ranges = parts.select("name", "start", "length", "path", "line_bases", "line_bytes", place(F.col("_at")).alias("first"), (place(last) + 1).alias("until"), (F.col("_at") % F.col("line_bases")).alias("column"), (F.col("base_start") + F.col("_at")).alias("place"))
    return answered, ranges


def fetch(spark: SparkSession, folder: str, requests: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """For each request the bases of the first record of that name, as `operators.lookup.sequence_view` gives them, from an index.

    An unknown name gives no row, a range beyond the record null bases. Equal requests are read once.
    """
    answered, ranges = ranges_of(spark, folder, requests, range_bytes)
    texts = read_ranges(ranges).groupBy("name", "start", "length").agg(F.array_sort(F.collect_list(F.struct("place", "bases"))).alias("_p"))
    joined = answered.join(texts.select("name", "start", "length", F.array_join(F.col("_p.bases"), "").alias("_text")), ["name", "start", "length"], "left")
    bases = F.when(F.col("in_bounds"), F.coalesce("_text", F.lit("")))
    out = joined.select("name", F.coalesce("comment", F.lit("")).alias("comment"), F.col("l_seq").cast("int").alias("l_seq"), "start", "length", bases.alias("bases"), "in_bounds")
    return requests.select("name", F.col("start").cast("int").alias("start"), F.col("length").cast("int").alias("length")).join(out, ["name", "start", "length"]).select("name", "comment", "l_seq", "start", "length", "bases", "in_bounds")
