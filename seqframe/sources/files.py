"""Files, their sizes, and lines of text whose compression is told by content.

`reached` copies what only the driver can read (a web or FTP address, standard input) once to the shared folder; all else is a path
of Spark's and pyarrow's file systems. Commands are not run.

Spark's text reader goes by a file's name: gzip without its ending gives garbage, and plain text with it an error. `text_lines` looks at the first
bytes of each file, in a job. Files whose name tells the truth are Spark's, split where they are plain; only the others go
through a Python data source, a file a partition, and large gzip files of blocks, in pieces.
"""

from __future__ import annotations

import gzip
import io
import json
import sys
import urllib.parse
import urllib.request
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from seqframe.plans.scratch import new_folder

GZIP = b"\x1f\x8b"
#: Bytes of lines that are sent at once.
AT_ONCE = 4 << 20


def store_of(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def opened(stream: BinaryIO) -> BinaryIO:
    """The stream, or what it holds compressed; several gzip members follow each other."""
    buffered = io.BufferedReader(stream) if not isinstance(stream, io.BufferedReader) else stream
    return gzip.GzipFile(fileobj=buffered) if buffered.peek(2)[:2] == GZIP else buffered


def found(paths: list[str]) -> list[tuple[str, int]]:
    """Files below the given paths, in order, and their sizes."""
    from pyarrow import fs

    out: list[tuple[str, int]] = []
    for path in paths:
        store, inner = store_of(path)
        info = store.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.type == fs.FileType.File:
            out.append((path, info.size))
        else:
            prefix = path.rstrip("/")
            below = store.get_file_info(fs.FileSelector(inner, recursive=True))
            out += sorted((f"{prefix}{x.path[len(inner.rstrip('/')) :]}", x.size) for x in below if x.is_file and not x.base_name.startswith(("_", ".")))
    return out


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """`file`, `bytes` of every file below a path; only listed, not read."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    below = top.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(top, True)
    rows = []
    while below.hasNext():
        file = below.next()
        if not file.getPath().getName().startswith(("_", ".")):
            rows.append((file.getPath().toString(), file.getLen()))
    return spark.createDataFrame(rows, "file string, bytes long")


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_: object) -> None:
        return None


def copied(spark: SparkSession, stream: BinaryIO, name: str) -> str:
    """The path of a copy of a stream in the folder that the driver and all executors share."""
    path = f"{new_folder(spark, 'copied')}/{name}"
    store, inner = store_of(path)
    store.create_dir(inner.rpartition("/")[0])
    with store.open_output_stream(inner, compression=None) as out:
        while some := stream.read(AT_ONCE):
            out.write(some)
    return path


def reached(spark: SparkSession, name: str) -> str:
    """The path of what `name` names: itself, or a copy of `-` (standard input), an `http(s)://` or an `ftp://` address.

    A proxy in the environment is used; an answer other than 200, a redirect among them, is an error.
    """
    if name == "-":
        return copied(spark, sys.stdin.buffer, "stdin")
    if not name.startswith(("http://", "https://", "ftp://")):
        return name
    with urllib.request.build_opener(_NoRedirect).open(name, timeout=60) as stream:
        if getattr(stream, "status", None) not in (None, 200):
            raise OSError(f"{name}: status {stream.status}")
        return copied(spark, stream, urllib.parse.urlsplit(name).path.rpartition("/")[2] or "copy")


class _File(InputPartition):
    def __init__(self, path: str, kind: str, start: int, end: int) -> None:
        self.path, self.kind, self.start, self.end = path, kind, start, end


class LinesReader(DataSourceReader):
    def __init__(self, pieces: list[tuple[str, str, int, int]]) -> None:
        self.pieces = pieces

    def partitions(self) -> list[_File]:
        return [_File(*p) for p in self.pieces]

    def _blocks(self, part: _File) -> Iterator[list[bytes]]:
        from seqframe.sources.pieces import Piece

        if part.kind == "blocks":
            with Piece(part.path, part.kind, part.start, part.end) as piece:
                for body in piece.blocks():
                    yield body.removesuffix(b"\n").split(b"\n")
            return
        store, inner = store_of(part.path)
        with store.open_input_stream(inner, compression=None) as stream:
            lines = opened(io.BufferedReader(stream))
            while some := lines.readlines(AT_ONCE):
                yield [x.removesuffix(b"\n") for x in some]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        for some in self._blocks(partition):
            yield pa.RecordBatch.from_arrays([pa.array([x.removesuffix(b"\r").decode("utf-8", "replace") for x in some], pa.string())], ["value"])


class LinesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lines_by_content"

    def schema(self) -> StructType:
        return StructType([StructField("value", StringType())])

    def reader(self, schema: StructType) -> LinesReader:
        return LinesReader(json.loads(self.options["pieces"]))


def text_lines(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """`value`, the lines of the file, or of the files below the folder, at `path` (see `reached`), whether or not its name says that they are compressed.

    Executors look at the files' first bytes. Gzip files of blocks that are over `split_bytes` are read in pieces, each a task.
    """
    from seqframe.sources.pieces import kinds

    path = reached(spark, path)
    try:
        every = found([path])
    except (ValueError, OSError):  # a store that only Spark's readers reach: the name must tell
        return spark.read.text(path)
    told = kinds(spark, [p for p, _ in every])
    odd: list[tuple[str, str, int, int]] = []
    good = []
    for p, size in every:
        if told[p] == "blocks" and size > split_bytes:
            odd += [(p, "blocks", at, min(at + split_bytes, size)) for at in range(0, size, split_bytes)]
        elif p.endswith(".gz") == (told[p] != "plain"):
            good.append(p)
        else:
            odd.append((p, told[p], 0, size))
    if not odd:
        return spark.read.text(path)
    spark.dataSource.register(LinesSource)
    rows = spark.read.format("lines_by_content").option("pieces", json.dumps(odd)).load()
    return spark.read.text(good).unionByName(rows) if good else rows


def numbered(lines: DataFrame) -> DataFrame:
    """`line_no` (from 0) and `value` of lines, in the order of their files and of the lines in each.

    Without a shuffle of lines: a line's place in its piece of a file comes from `monotonically_increasing_id`, and the lines of the
    pieces before, a row a piece, are counted in a first pass that reads nothing twice but the text.
    """
    try:
        piece = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
        rows = lines.select("value", *piece, F.monotonically_increasing_id().alias("id"))
        rows.schema  # noqa: B018  fails where the lines are no files
    except AnalysisException:
        rows = lines.select("value", F.lit("").alias("file"), F.spark_partition_id().cast("long").alias("start"), F.monotonically_increasing_id().alias("id"))
    pieces = rows.groupBy("file", "start").agg(F.min("id").alias("first"), F.count("*").alias("n")).orderBy("file", "start").toArrow()  # a row a piece
    n = pieces.column("n").to_numpy()
    before = pa.table({"file": pieces.column("file"), "start": pieces.column("start"), "offset": pa.array(n.cumsum() - n - pieces.column("first").to_numpy(), pa.int64())})
    offsets = lines.sparkSession.createDataFrame(before)
    return rows.join(F.broadcast(offsets), ["file", "start"]).select((F.col("id") + F.col("offset")).alias("line_no"), "value")
