"""FASTA and FASTQ records as a Python data source.

`spark.read.format("fastx").load(paths)` after `register(spark)`, a file a
partition; gzip is told by its first bytes, not the name. Files may lie in any store that
pyarrow's file systems reach.

A record begins at `>` or `@`, wherever it stands after the record before. The
name ends at the first blank, the rest of that line is the comment. Sequence
lines follow until a line begins with `>`, `+` or `@`; blank lines and carriage
returns are dropped. After `+` (its own text is ignored) quality lines follow
until they are as long as the sequence, so a quality line may begin with `@`.
Records with and without qualities may be mixed.

Option `malformed`, for a quality that is missing or of another length: `fail`
(default) raises, `skip` leaves the record out, `stop` ends the file there.
A schema given by the user narrows the columns that are sent.

`read_fastx` splits files over `split_bytes`, plain ones and those of gzip blocks (see `pieces`). A piece has the records that begin in it. Of a
known `layout` the first is found by it: `four_line` (FASTQ whose records are four lines each, as sequencers write it), a line with `@`
whose next but one begins with `+` and whose fourth is as long as its second; `fasta`, a line with `>`. For any other layout a pass over all pieces
tells what each begins with. Records are numbered over all pieces of a file, by a pass that counts them.

`fasta_lines` is a way for FASTA without Python, in which large plain files are split.
"""

from __future__ import annotations

import io
import json
import re
from collections import deque
from collections.abc import Iterator
from itertools import islice
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from seqframe.sources.files import found, opened, reached, store_of
from seqframe.sources.pieces import H, Piece, Q, S, State, entries, kinds, per_task

#: Bytes of a piece.
SPLIT_BYTES = 64 << 20

SCHEMA = StructType(
    [
        StructField("file_id", IntegerType(), False),
        StructField("rec_no", LongType(), False),
        StructField("name", StringType(), False),
        StructField("comment", StringType()),
        StructField("seq", StringType(), False),
        StructField("qual", StringType()),
        StructField("l_seq", IntegerType(), False),
    ]
)


_HEADER = re.compile(rb"(\S*)(?:\s(.*))?", re.DOTALL)


def header_parts(line: bytes, at: int) -> tuple[str, str | None]:
    """Name and comment of a header line whose mark stands before `at`."""
    found = _HEADER.match(line, at)
    return found[1].decode(), (found[2] or b"").decode() or None


class MalformedRecord(ValueError):
    pass


def records(stream: BinaryIO, malformed: str = "fail") -> Iterator[tuple[str, str | None, str, str | None]]:
    """(name, comment, seq, qual) of each record."""
    return parsed(((True, line.removesuffix(b"\n")) for line in opened(stream)), malformed)


def parsed(lines: Iterator[tuple[bool, bytes]], malformed: str = "fail", state: State = (H, 0)) -> Iterator[tuple[str, str | None, str, str | None]]:
    """(name, comment, seq, qual) of each record that begins in a line which belongs here; lines come without their ends.

    `state` tells what the first line is part of: of a record that began before, the rest is passed over.
    """
    lines = ((owned, line[:-1] if len(line) > 1 and line.endswith(b"\r") else line) for owned, line in lines)
    end: tuple[bool, bytes | None] = (False, None)
    owned, line = next(lines, end)
    kind, short = state
    if kind == S:
        while line is not None and line[:1] not in (b">", b"+", b"@"):
            short += len(line)
            owned, line = next(lines, end)
        kind = Q if line is not None and line[:1] == b"+" else H
        if kind == Q:
            owned, line = next(lines, end)
    if kind == Q:
        begun = False
        while line is not None and (short > 0 or not begun):
            short, begun = short - len(line), True
            owned, line = next(lines, end)
    while line is not None:
        at = min((i for i in (line.find(b">"), line.find(b"@")) if i >= 0), default=-1)
        if at < 0:
            owned, line = next(lines, end)
            continue
        if not owned:
            return
        name, comment = header_parts(line, at + 1)
        parts: list[bytes] = []
        owned, line = next(lines, end)
        while line is not None and line[:1] not in (b">", b"+", b"@"):
            parts.append(line)
            owned, line = next(lines, end)
        seq = b"".join(parts)
        if line is None or line[:1] != b"+":
            yield name, comment, seq.decode(), None
            continue
        owned, line = next(lines, end)
        missing, quals, size = line is None, [], 0
        while line is not None:  # one line at least
            quals.append(line)
            size += len(line)
            owned, line = next(lines, end)
            if size >= len(seq):
                break
        if missing or size != len(seq):
            if malformed == "fail":
                raise MalformedRecord(f"record {name!r}: {size} qualities for {len(seq)} bases")
            if malformed == "stop":
                return
            continue
        yield name, comment, seq.decode(), b"".join(quals).decode()


def _begins(layout: str, held: list[bytes]) -> bool:
    """Whether a record begins at the first of these lines (without their ends)."""
    if layout == "fasta":
        return held[0].startswith(b">")
    return len(held) > 3 and held[0].startswith(b"@") and held[2].startswith(b"+") and len(held[1]) == len(held[3])


def synced(lines: Iterator[tuple[bool, bytes]], layout: str) -> Iterator[tuple[bool, bytes]]:
    """The lines from the first record's start on, which the layout tells."""
    held: deque[tuple[bool, bytes]] = deque(islice(lines, 4))
    while held and not _begins(layout, [x.removesuffix(b"\r") for _, x in held]):
        held.popleft()
        held.extend(islice(lines, 1))
    yield from held
    yield from lines


class FilePartition(InputPartition):
    """A file, or a piece of it from `start` to `end`, entered in `state` (None: the layout tells where records begin)."""

    def __init__(self, file_id: int, path: str, number: int = 0, kind: str = "", start: int = 0, end: int | None = None, state: State | None = None) -> None:
        self.file_id, self.path, self.number, self.kind, self.start, self.end, self.state = file_id, path, number, kind, start, end, state


class Pieces(InputPartition):
    """Pieces that one task reads, one after another."""

    def __init__(self, parts: list[FilePartition]) -> None:
        self.parts = parts


def packed(pieces: list[list[Any]], split_bytes: int) -> str:
    """Pieces as text, a file's together, so that it grows by files, and by pieces only where their states must be told."""
    out: list[list[Any]] = []
    for i, path, number, kind, _, end, state in pieces:
        if not number:
            out.append([i, path, kind, split_bytes, end, []])
        out[-1][4] = end
        out[-1][5].append(list(state) if state else None)
    return json.dumps([[*f[:5], f[5] if any(f[5]) else len(f[5])] for f in out])


def unpacked(text: str) -> Iterator[FilePartition]:
    for i, path, kind, step, size, states in json.loads(text):
        states = [None] * states if isinstance(states, int) else states
        for k, state in enumerate(states):
            yield FilePartition(i, path, k, kind, k * step, None if size is None else min(k * step + step, size), tuple(state) if state else None)


#: The piece of the file that a record comes from; only where files are split.
PIECE = StructField("piece", IntegerType(), False)
LAYOUTS = ("any", "four_line", "fasta")
#: Records and characters that are sent at once.
RECORDS, CHARACTERS = 1 << 14, 4 << 20


class FastxReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.columns = schema.fieldNames()
        unknown = set(self.columns) - {*SCHEMA.fieldNames(), PIECE.name}
        if unknown:
            raise ValueError(f"fastx has no columns {sorted(unknown)}")
        self.malformed = options.get("malformed", "fail")
        if self.malformed not in ("fail", "skip", "stop"):
            raise ValueError("malformed must be fail, skip or stop")
        self.layout = options.get("layout", "any")
        if self.layout not in LAYOUTS:
            raise ValueError(f"layout must be one of {LAYOUTS}")
        self.pieces, self.at_once = options.get("pieces"), int(options.get("at_once", 0))
        paths = options.get("paths")
        self.paths = json.loads(paths) if paths else [options["path"]]

    def __getstate__(self) -> dict[str, Any]:
        """A task gets its own pieces, not the list of all."""
        return {**self.__dict__, "pieces": None, "paths": []}

    def partitions(self) -> list[FilePartition | Pieces]:
        if self.pieces is None:
            return [FilePartition(i, path) for i, (path, _) in enumerate(found(self.paths))]
        out: list[FilePartition | Pieces] = []
        held: list[FilePartition] = []
        size = 0
        for part in unpacked(self.pieces):
            if part.end is None:
                out.append(part)
                continue
            if held and size + part.end - part.start > self.at_once:
                out.append(Pieces(held))
                held, size = [], 0
            held.append(part)
            size += part.end - part.start
        return [*out, Pieces(held)] if held else out

    def _records(self, part: FilePartition) -> Iterator[tuple[str, str | None, str, str | None]]:
        if part.end is None:
            store, inner = store_of(part.path)
            with store.open_input_stream(inner, compression=None) as stream:
                yield from records(io.BufferedReader(stream), self.malformed)
            return
        with Piece(part.path, part.kind, part.start, part.end) as piece:
            lines = piece.lines()
            if part.state is None and part.start:
                lines = synced(lines, self.layout)
            yield from parsed(lines, self.malformed, part.state or (H, 0))

    def read(self, partition: FilePartition | Pieces | None) -> Iterator[pa.RecordBatch]:
        for part in partition.parts if isinstance(partition, Pieces) else [partition] if partition else []:  # None: there are no files
            yield from self._batches(part)

    def _batches(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        kinds = [{"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[SCHEMA[c].dataType.simpleString() if c != PIECE.name else "int"] for c in self.columns]
        makers = {
            "file_id": lambda first, rows: [partition.file_id] * len(rows),
            "rec_no": lambda first, rows: range(first, first + len(rows)),
            "name": lambda first, rows: [r[0] for r in rows],
            "comment": lambda first, rows: [r[1] for r in rows],
            "seq": lambda first, rows: [r[2] for r in rows],
            "qual": lambda first, rows: [r[3] for r in rows],
            "l_seq": lambda first, rows: [len(r[2]) for r in rows],
            PIECE.name: lambda first, rows: [partition.number] * len(rows),
        }

        def batch(first: int, rows: list[tuple[str, str | None, str, str | None]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(makers[c](first, rows), k) for c, k in zip(self.columns, kinds, strict=True)], self.columns)

        held: list[tuple[str, str | None, str, str | None]] = []
        first, size = 0, 0
        for record in self._records(partition):
            held.append(record)
            size += len(record[2])
            if len(held) == RECORDS or size > CHARACTERS:
                yield batch(first, held)
                first, held, size = first + len(held), [], 0
        if held:
            yield batch(first, held)


class FastxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> FastxReader:
        return FastxReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool):
        from seqframe.sinks.store import FastxWriter

        return FastxWriter(schema, self.options, overwrite, SCHEMA.fieldNames())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastxSource)


def pieces_of(spark: SparkSession, paths: list[str], layout: str, split_bytes: int) -> list[list[Any]]:
    """All pieces of all files, each with its file, number, kind, ends and, where the layout doesn't tell, the state that it is entered in."""
    files = found(paths)
    told = kinds(spark, [p for p, size in files if size > split_bytes])
    out: list[list[Any]] = []
    for i, (path, size) in enumerate(files):
        kind = told.get(path, "gzip")
        if kind == "gzip":  # or a small file, whatever it is
            out.append([i, path, 0, "", 0, None, None])
        else:
            out += [[i, path, k, kind, at, min(at + split_bytes, size), None] for k, at in enumerate(range(0, size, split_bytes))]
    if layout == "any":
        split = [p for p in out if p[5] is not None]
        for piece, state in zip(split, entries(spark, [(p[1], p[3], p[4], p[5]) for p in split]), strict=True):
            piece[6] = state
    return out


def read_fastx(spark: SparkSession, *paths: str, columns: list[str] | None = None, malformed: str = "fail", layout: str = "any", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of all files, numbered by file and within it; `columns` narrows what is read.

    Files over `split_bytes` are read in pieces, plain ones and those of gzip blocks; small pieces share tasks. For `layout="any"` they are read once before, to tell what
    each piece begins with. With `malformed="stop"` files aren't split, as what follows a bad record is another piece's.
    """
    register(spark)
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {LAYOUTS}")
    fields = {f.name: f for f in SCHEMA.fields}
    wanted = columns or list(fields)
    every = [reached(spark, p) for p in paths]
    source = spark.read.format("fastx").option("malformed", malformed).option("paths", json.dumps(every)).option("layout", layout)
    split = [] if malformed == "stop" else pieces_of(spark, every, layout, split_bytes)
    if not any(p[2] for p in split):
        return source.schema(StructType([fields[c] for c in wanted])).load()
    cut = [(*p[:2], p[4], p[5]) for p in split if p[5] is not None]
    source = source.option("pieces", packed(split, split_bytes)).option("at_once", per_task(spark, cut))
    if "rec_no" not in wanted:
        return source.schema(StructType([fields[c] for c in wanted])).load()
    counts = source.schema(StructType([fields["file_id"], PIECE])).load().groupBy("file_id", "piece").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = F.broadcast(counts.select("file_id", "piece", before.alias("before")))  # a row a piece
    rows = source.schema(StructType([*(fields[c] for c in dict.fromkeys([*wanted, "file_id"])), PIECE])).load()
    return rows.join(counts, ["file_id", "piece"]).withColumn("rec_no", F.col("rec_no") + F.col("before")).select(*wanted)


def _batches(rows: Iterator[tuple[Any, ...]], schema: StructType) -> Iterator[pa.RecordBatch]:
    """Rows, whose fifth value is the sequence, in batches of bounded size."""
    kinds = [{"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[f.dataType.simpleString()] for f in schema]

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], schema.fieldNames())

    held: list[tuple[Any, ...]] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[4])
        if len(held) == RECORDS or size > CHARACTERS:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


#: Columns of a stream: the file's path instead of its number.
STREAMED = StructType([StructField("path", StringType(), False), *SCHEMA.fields[1:]])


def stream_fastx(spark: SparkSession, folder: str, malformed: str = "fail", files_per_batch: int = 1000) -> DataFrame:
    """A stream of the records of the files that appear in a folder: `path` and the columns of `read_fastx` but `file_id`.

    Spark's file stream tells which files are new and keeps that in the query's checkpoint, so a restart neither repeats nor loses a
    record; of a file only its name travels, and the task that gets it reads it, a file a task's row, compressed or not. Files must be whole when
    they appear and not change. A file that comes late counts whatever its time says.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inner = store_of(path if "://" in path else path.replace("file:", "file://", 1))
                with store.open_input_stream(inner, compression=None) as stream:
                    found = records(io.BufferedReader(stream), malformed)
                    yield from _batches(((path, n, name, comment, seq, qual, len(seq)) for n, (name, comment, seq, qual) in enumerate(found)), STREAMED)

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", "36500d").load(folder)
    return files.select("path").mapInArrow(work, STREAMED)


def fasta_lines(spark: SparkSession, path: str) -> DataFrame:
    """name, comment, seq, l_seq of FASTA files, split by Spark at record starts; in file order within each file, not numbered."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value"))
    head = F.regexp_replace(F.substring_index("value", "\n", 1), "\r$", "")
    body = F.when(F.contains("value", F.lit("\n")), F.expr("substring(value, instr(value, '\n') + 1)")).otherwise("")
    name = F.regexp_extract(head, r"^(\S*)", 1)
    seq = F.regexp_replace(body, r"[\r\n]", "")
    return rows.filter(F.trim("value") != "").select(name.alias("name"), F.nullif(F.regexp_extract(head, r"^\S*\s(.*)$", 1), F.lit("")).alias("comment"), seq.alias("seq"), F.length(seq).alias("l_seq"))
