"""Large files in pieces, whatever their layout, plain or of gzip blocks.

*Pieces.* A plain file is cut every so many bytes; a line belongs to the piece that it begins in. A gzip file made of blocks (members of
64 KiB at most that say their size, as sequencing tools write it) is cut the same way in compressed bytes, members belonging to
the piece that they begin in; a line belongs to the piece in whose uncompressed bytes it begins after the first one, so that no piece has to know what
its first byte follows. The first member of a piece is found by its header, and by being followed by another. Other gzip files are one piece.

*Records over pieces.* What a line means depends on all before it: a line with `@` may be a header, or qualities. Between two
lines the parser is in one of three states: at a header (`H`), in a sequence of s bases so far (`S`), or short of r qualities
(`Q`). `summary` works out, for every state that a piece may be entered in, in which it is left: by walking from its last line
to its first, the state left from `H` before each line is known, and the other two only meet one of these lines: a sequence ends at a
fixed line, and qualities end at the first line with enough of them, so a table of their sums gives all r at once. Wrong guesses soon fall in
with right ones, so the table has few rows. `entries` runs through the summaries of a file's pieces, and tells each piece's true state. So
every piece can then be read by itself, with the records that begin in it.
"""

from __future__ import annotations

import io
import json
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from typing import Any, BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from seqframe.sources.files import GZIP, store_of

#: States between two lines.
H, S, Q = 0, 1, 2
State = tuple[int, int]
#: Bytes of a member of a block gzip file at most, and of a member's fixed header.
_MEMBER, _HEAD = 1 << 16, 12
#: Bytes of content of a member that is written: also what can't be compressed fits in 64 KiB.
BLOCK_BYTES = 0xFF00
_AT_ONCE, _BLOCK = 8 << 20, 1 << 20
#: Bytes of pieces that a task reads one after another, unless one is larger.
TASK_BYTES = 64 << 20


def member_size(head: bytes) -> tuple[int, int] | None:
    """Bytes of the member that begins here and of its header; None if it isn't a block that says its size."""
    if len(head) < _HEAD + 6 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    extra = struct.unpack_from("<H", head, 10)[0]
    at, end = _HEAD, _HEAD + extra
    while at + 4 <= min(end, len(head)):
        length = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and length == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1, end
        at += 4 + length
    return None


def block_member(content: bytes) -> bytes:
    """A member with `BLOCK_BYTES` bytes of content at most that says its size; one without content marks a file's end."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = squeeze.compress(content) + squeeze.flush()
    extra = struct.pack("<2sHH", b"BC", 2, len(data) + _HEAD + 6 + 8 - 1)
    return b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H", len(extra)) + extra + data + struct.pack("<II", zlib.crc32(content), len(content))


def kind_of(path: str) -> str:
    """`plain`, `gzip`, or `blocks`: a gzip file whose members say their sizes."""
    store, inner = store_of(path)
    with store.open_input_stream(inner, compression=None) as stream:
        head = stream.read(64)
    return "plain" if head[:2] != GZIP else "blocks" if member_size(head) else "gzip"


def kinds(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """The kind of each file, looked at by the executors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([kind_of(p) for p in names])], ["path", "kind"])

    if not paths:
        return {}
    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), 4 * spark.sparkContext.defaultParallelism))
    found = rows.mapInArrow(work, "path string, kind string").toArrow()  # a row a file
    return dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True))


def _members(stream: BinaryIO, at: int) -> Iterator[tuple[int, bytes]]:
    """Place and content of each member from the one at `at` on."""
    stream.seek(at)
    while True:
        head = stream.read(_HEAD + 6)
        if not head:
            return
        sizes = member_size(head)
        while sizes is None and len(head) < _HEAD + _MEMBER and (more := stream.read(256)):  # another field comes first
            head += more
            sizes = member_size(head)
        if sizes is None:
            raise ValueError(f"a member at byte {at} doesn't say its size")
        size, start = sizes
        raw = head + stream.read(max(size - len(head), 0))
        if len(head) > size:
            stream.seek(at + size)
        content = zlib.decompress(raw[start : size - 8], -15)
        if zlib.crc32(content) != struct.unpack_from("<I", raw, size - 8)[0]:
            raise ValueError(f"the member at byte {at} is damaged")
        yield at, content
        at += size


def _first_member(stream: BinaryIO, start: int, end: int) -> int | None:
    """Where the first member in [start, end) begins: a header that says a size after which another begins, or the file ends."""
    stream.seek(start)
    window = stream.read(min(end - start, _MEMBER) + 3 * _MEMBER)
    at = -1
    while 0 <= (at := window.find(b"\x1f\x8b\x08\x04", at + 1)) and start + at < end:
        next_, steps = at, 0
        while steps < 3 and (sizes := member_size(window[next_ : next_ + 256])):
            next_, steps = next_ + sizes[0], steps + 1
        if steps and (steps == 3 or next_ == len(window)):
            return start + at
    return None


class Piece:
    """Lines of one piece: `blocks` of whole lines that belong to it, then `after`, the lines that follow, as far as anyone asks."""

    def __init__(self, path: str, kind: str, start: int, end: int | None) -> None:
        self.path, self.kind, self.start, self.end = path, kind, start, end
        self._rest: Iterator[tuple[int, bytes]] = iter(())
        self._tail = b""

    def __enter__(self) -> Piece:
        store, inner = store_of(self.path)
        self._raw = store.open_input_file(inner)
        self._stream = io.BufferedReader(self._raw, 1 << 20)
        return self

    def __exit__(self, *_: object) -> None:
        self._raw.close()

    def blocks(self) -> Iterator[bytes]:
        """The lines that belong to the piece, many at a time, each block ending with a line's end but for the file's last."""
        return self._plain() if self.kind == "plain" else self._blocks()

    def _plain(self) -> Iterator[bytes]:
        at = self.start
        if at:
            self._stream.seek(at - 1)
            at += len(self._stream.readline()) - 1
        while at < self.end:
            body = self._stream.read(min(_AT_ONCE, self.end - at))
            if not body:
                return
            if not body.endswith(b"\n"):
                body += self._stream.readline()
            at += len(body)
            yield body

    def _blocks(self) -> Iterator[bytes]:
        first = 0 if not self.start else _first_member(self._stream, self.start, self.end)
        if first is None:
            return
        self._rest = _members(self._stream, first)
        begun, over = not self.start, False
        held: list[bytes] = []  # content after the last line that was given on
        size = 0
        for at, content in self._rest:
            if at >= self.end:
                over, self._tail = True, content
                break
            if not begun:
                _, begun_now, content = content.partition(b"\n")
                begun = bool(begun_now)
                if not begun:
                    continue
            held.append(content)
            size += len(content)
            if size >= _BLOCK and b"\n" in content:
                body, mark, rest = b"".join(held).rpartition(b"\n")
                held, size = [rest], len(rest)
                yield body + mark
        if over:  # the line that the piece ends in, or the one that begins just after it; or the end of one that goes through the whole piece
            line = self._next_line()
            if begun:
                held.append(line)
        if begun and any(held):
            yield b"".join(held)

    def _next_line(self) -> bytes:
        """The next line with its end; empty at the file's end."""
        held = [self._tail]
        while b"\n" not in held[-1] and (more := next(self._rest, None)):
            held.append(more[1])
        line, mark, self._tail = b"".join(held).partition(b"\n")
        return line + mark

    def after(self) -> Iterator[bytes]:
        """The lines after those of the piece, without their ends."""
        lines = self._stream if self.kind == "plain" else iter(self._next_line, b"")
        for line in lines:
            yield line.removesuffix(b"\n")

    def lines(self) -> Iterator[tuple[bool, bytes]]:
        """All lines from the piece's first on, without their ends, and whether they belong to it."""
        for body in self.blocks():
            for line in body.removesuffix(b"\n").split(b"\n"):
                yield True, line
        for line in self.after():
            yield False, line


def _shape(blocks: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line its length without its end, its first character's class (1 for `>` and `@`, 2 for `+`, else 0), and whether `>` or `@` is anywhere in it."""
    lengths, firsts, marked = [np.zeros(0, np.int64)], [np.zeros(0, np.int8)], [np.zeros(0, bool)]
    for body in blocks:
        buffer = np.frombuffer(body, np.uint8)
        ends = np.flatnonzero(buffer == 10)
        if not body.endswith(b"\n"):
            ends = np.append(ends, len(body))
        starts = np.concatenate([[0], ends[:-1] + 1])
        sizes = ends - starts
        lengths.append(sizes - ((sizes > 1) & (buffer[np.maximum(ends - 1, 0)] == 13)))
        first = np.where(sizes > 0, buffer[np.minimum(starts, len(buffer) - 1)], 0)
        firsts.append(np.where((first == 62) | (first == 64), 1, np.where(first == 43, 2, 0)).astype(np.int8))
        has = np.zeros(len(starts), bool)
        has[np.searchsorted(ends, np.flatnonzero((buffer == 62) | (buffer == 64)))] = True
        marked.append(has)
    return np.concatenate(lengths), np.concatenate(firsts), np.concatenate(marked)


def summary(blocks: Iterator[bytes]) -> dict[str, Any]:
    """In which state a piece is left, for every state that it may be entered in; see `leave`."""
    lengths, first, marked = _shape(blocks)
    n = len(lengths)
    sums = np.concatenate([[0], np.cumsum(lengths)])
    total = int(sums[-1])
    following = np.minimum.accumulate(np.where(marked, np.arange(n), n)[::-1])[::-1] if n else np.zeros(0, np.int64)
    following = np.append(following, n)  # the header at or after each line
    stops = np.minimum.accumulate(np.where(first > 0, np.arange(n), n)[::-1])[::-1] if n else np.zeros(0, np.int64)
    stops = np.append(stops, n)  # the end of a sequence at or after each line
    heads = np.flatnonzero(marked)
    ends = stops[heads + 1]  # of each header's sequence
    bases = sums[ends] - sums[heads + 1]
    plus = (ends < n) & (first[np.minimum(ends, n - 1)] == 2) if n else np.zeros(0, bool)
    begun = np.minimum(ends + 1, n)  # the first line of qualities
    enough = np.maximum(np.searchsorted(sums, sums[begun] + bases), begun + 1)  # the line after them
    after = np.where(plus, enough, ends)

    states: list[State] = [(H, 0)]
    known = {states[0]: 0}
    left = np.zeros(n + 1, np.int64)  # of a header's line, or of n: the state in which the piece is left

    def number(state: State) -> int:
        if state not in known:
            known[state] = len(states)
            states.append(state)
        return known[state]

    spans = zip(heads.tolist(), ends.tolist(), plus.tolist(), begun.tolist(), after.tolist(), bases.tolist(), strict=True)
    for h, end, has_plus, q, then, s in reversed(list(spans)):
        if end == n:
            left[h] = number((S, s))
        elif has_plus and then > n:  # no line has enough: what is missing, or one line at least
            left[h] = number((Q, s - (total - int(sums[q]))))
        else:
            left[h] = left[following[then]]
    from_line = left[following]  # the state left from `H` before each line, and before the end

    fresh = np.flatnonzero(lengths > 0) + 1  # lines after which the sum of lengths is larger than before
    values = from_line[fresh]
    edge = np.append(values[1:] != values[:-1], True) if len(fresh) else np.zeros(0, bool)
    table = [[int(sums[i]), int(v)] for i, v in zip(fresh[edge].tolist(), values[edge].tolist(), strict=True)]
    stop = int(stops[0])
    return {
        "states": states,
        "total": total,
        "lines": n,
        "h": int(from_line[0]),
        "sums": table,
        "one": int(from_line[1]) if n else 0,
        "stop": None if stop == n else [int(first[stop]), int(sums[stop]), int(from_line[stop]), int(sums[stop + 1]), int(from_line[stop + 2]) if stop + 2 <= n else None],
    }


def leave(s: dict[str, Any], state: State) -> State:
    """The state in which a piece with this summary is left if it is entered in `state`."""

    def qualities(r: int, before: int, one: int | None) -> State:
        if r == 0:  # a line at least
            return (Q, 0) if one is None else tuple(s["states"][one])
        at = bisect_left(s["sums"], [before + r, -1])
        return tuple(s["states"][s["sums"][at][1]]) if at < len(s["sums"]) else (Q, r - (s["total"] - before))

    kind, count = state
    if not s["lines"]:
        return state
    if kind == H:
        return tuple(s["states"][s["h"]])
    if kind == Q:
        return qualities(count, 0, s["one"])
    if s["stop"] is None:
        return S, count + s["total"]
    first, bases, header, before, one = s["stop"]
    return tuple(s["states"][header]) if first == 1 else qualities(count + bases, before, one)


def per_task(spark: SparkSession, pieces: list[tuple[str, str, int, int]]) -> int:
    """Bytes of pieces (the last two: start, end) that a task reads, about: a share of all, `TASK_BYTES` at most."""
    total = sum(end - start for *_, start, end in pieces)
    return max(1, min(TASK_BYTES, total // (4 * spark.sparkContext.defaultParallelism)))


def entries(spark: SparkSession, pieces: list[tuple[str, str, int, int]]) -> list[State]:
    """The state in which each piece (path, kind, start, end; in order) is entered; executors read the pieces, the driver gets a short row of each.

    A piece is summed up a block of lines at a time, so a task holds tables of one block only; small pieces share tasks.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, *piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with Piece(*piece) as lines:
                    told = json.dumps([summary(iter([body])) for body in lines.blocks()], default=int)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([told])], ["i", "told"])

    if not pieces:
        return []
    tasks = min(len(pieces), -(-sum(end - start for *_, start, end in pieces) // per_task(spark, pieces)))
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pieces)], "i long, path string, kind string, start long, end long").repartition(tasks, "i")
    found = rows.mapInArrow(work, "i long, told string").toArrow()
    told = dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True))
    out: list[State] = []
    state: State = (H, 0)
    for i, piece in enumerate(pieces):
        if not i or pieces[i - 1][0] != piece[0]:
            state = (H, 0)
        out.append(state)
        for block in json.loads(told[i]):
            state = leave(block, state)
    return out

