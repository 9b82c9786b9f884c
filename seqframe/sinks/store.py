"""K1 as a data sink: `df.write.format("fastx").option("compression", ...).save(path)`, with a manifest of the files in order.

Columns `name` and `seq`, and `comment` and `qual` where there are such, become records (FASTQ with qualities, else FASTA); the other columns of
the reader's schema are left out, any else is an error. Each task writes one file under a name of its own in a folder that readers pass over. Only when all
tasks are done the driver moves the files that Spark took, one a task, to their names, in the order of the partitions, writes
`_manifest.json`, and drops what an overwrite replaces; a failed job leaves nothing but what was there before. A sorted DataFrame's
files follow each other in its order, and so do the generations of files that are appended.

`compression`: `none`, `gzip`, or `blocks`, gzip members of 64 KiB that say their size, which `read_fastx` reads in pieces.
"""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from seqframe.sources.files import store_of
from seqframe.sources.pieces import BLOCK_BYTES, block_member

MANIFEST = "_manifest.json"
ENDINGS = {"none": ".fx", "gzip": ".fx.gz", "blocks": ".fx.gz"}


@dataclass
class WrittenFile(WriterCommitMessage):
    """What a task wrote: its partition, its file (None without records), its records, bases and bytes of text."""

    partition: int
    file: str | None
    records: int = 0
    bases: int = 0
    text_bytes: int = 0


class _Blocks:
    """A stream whose content is written in gzip members of their own."""

    def __init__(self, out: BinaryIO) -> None:
        self.out, self.held = out, bytearray()

    def write(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= BLOCK_BYTES:
            self.out.write(block_member(bytes(self.held[:BLOCK_BYTES])))
            del self.held[:BLOCK_BYTES]

    def close(self) -> None:
        if self.held:
            self.out.write(block_member(bytes(self.held)))
        self.out.write(block_member(b""))


class FastxWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool, known: list[str]) -> None:
        names = schema.fieldNames()
        if not {"name", "seq"} <= set(names) <= set(known):
            raise ValueError(f"a fastx sink takes name and seq and may have {sorted(set(known) - {'name', 'seq'})}, not {names}")
        self.compression = options.get("compression", "gzip")
        if self.compression not in ENDINGS:
            raise ValueError(f"compression must be one of {sorted(ENDINGS)}")
        self.path, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex
        self.folder = f"{self.path}/_writing-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenFile:
        context = TaskContext.get()
        done = WrittenFile(context.partitionId(), None)
        raw = out = None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                done.file = f"{self.folder}/{done.partition:05d}-{context.taskAttemptId()}"
                store, inner = store_of(done.file)
                store.create_dir(inner.rpartition("/")[0])
                raw = store.open_output_stream(inner, compression=None)
                out = {"none": lambda r: r, "gzip": lambda r: gzip.GzipFile(fileobj=r, mode="wb", mtime=0), "blocks": _Blocks}[self.compression](raw)
            text, bases = _text(batch)
            out.write(text)
            done.records, done.bases, done.text_bytes = done.records + batch.num_rows, done.bases + bases, done.text_bytes + len(text)
        if out is not None:
            if out is not raw:
                out.close()
            raw.close()
        return done

    def commit(self, messages: list[WrittenFile | None]) -> None:
        store, top = store_of(self.path)
        store.create_dir(top)
        before = read_manifest(self.path)
        generation = 1 + max([f["generation"] for f in before], default=0)
        files = [] if self.overwrite else before
        for m in sorted((m for m in messages if m and m.file), key=lambda m: m.partition):
            name = f"part-{generation:05d}-{m.partition:05d}{ENDINGS[self.compression]}"
            store.move(store_of(m.file)[1], f"{top}/{name}")
            files = [*files, {"file": name, "generation": generation, "records": m.records, "bases": m.bases, "text_bytes": m.text_bytes}]
        with store.open_output_stream(f"{top}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps({"files": files}, indent=1).encode())
        if self.overwrite:
            for f in before:
                store.delete_file(f"{top}/{f['file']}")
        self._clear()

    def abort(self, messages: list[WrittenFile | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        store, inner = store_of(self.folder)
        if store.get_file_info(inner).type == fs.FileType.Directory:
            store.delete_dir(inner)


def _text(batch: pa.RecordBatch) -> tuple[bytes, int]:
    """The records of a batch as text, and their bases."""
    columns = {n: batch.column(n).to_pylist() if n in batch.schema.names else [None] * batch.num_rows for n in ("name", "comment", "seq", "qual")}
    out, bases = [], 0
    for name, comment, seq, qual in zip(*columns.values(), strict=True):
        head = f"{name or ''}{' ' + comment if comment else ''}"
        seq = seq or ""
        if qual is None:
            out.append(f">{head}\n{seq}\n")
        elif len(qual) != len(seq):
            raise ValueError(f"record {name!r}: {len(qual)} qualities for {len(seq)} bases")
        else:
            out.append(f"@{head}\n{seq}\n+\n{qual}\n")
        bases += len(seq)
    return "".join(out).encode(), bases


def read_manifest(path: str) -> list[dict]:
    """The files of a set of records in order, with their generation, records, bases and bytes of text; none where nothing was written."""
    from pyarrow import fs

    store, top = store_of(path)
    if store.get_file_info(f"{top}/{MANIFEST}").type != fs.FileType.File:
        return []
    with store.open_input_stream(f"{top}/{MANIFEST}", compression=None) as stream:
        return json.loads(stream.read())["files"]
