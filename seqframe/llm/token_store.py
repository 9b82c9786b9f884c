"""Operator 2: a content-addressed store of token ids.

Layout of a store (all Parquet, below one shared folder):

- `objects/kind=chunk`: each distinct chunk once: `key` (BLAKE2b-128 of the
  payload), `payload` (little-endian ids, 2 bytes each if all fit, else 4, after
  one byte that says which).
- `recipes`: one row a document in ascending `doc_id` order (files follow each
  other, rows are sorted within): `pid` (file number), `doc_id`, `local_start`
  (ids before it in the file), `n_tokens`, `keys`, `sizes` and `root`, the Merkle
  root of the document's chunk keys. A file's last row also has `file_root`, the
  Merkle root of the file's document roots.
- `manifest`: one row: `files`, how many recipe files there are, and `root`, the
  Merkle root of their roots.

Chunks end where a rolling hash of 16 ids meets a mask, so equal passages give
equal chunks wherever they stand; no chunk but a document's last has fewer than
`LEAST` ids and none has more than `MOST`.

Reading checks every chunk against its key, every document against its root, every
file against its root and all files against the manifest, so nothing can be lost or
damaged unnoticed.
`read_digests` never moves payloads: a chunk gives its CRC-32, and the CRC of a
document follows from those of its chunks by arithmetic in GF(2).

Defined results: a null text is empty (its ids are the end id alone); a null
doc_id comes first; rows with the same doc_id are kept as documents of their
own, in the order of their roots; texts of any length are encoded whole; other
columns are ignored, whatever their names; an empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqframe.llm.common import new_folder, small_batches, worker_cache

#: Fewest, usual additional, and most ids of a chunk.
LEAST, USUAL, MOST = 128, 512, 4096
#: Words that a Python worker remembers before it starts afresh, and the longest of them.
REMEMBERED, LONGEST = 900_000, 60


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordEncoder:
    """The ids of whole texts, from the tokenizers library, which encodes each distinct part of a text once.

    Parts end at spaces and line feeds and between Latin letters, digits and ASCII punctuation; the
    vocabulary's normalizer and pre-tokenizer never join what stands on two sides of such an end.
    """

    def __init__(self, spec: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        # the same merges for parts that are one lower-case pre-token already, many of them in one call
        described = json.loads(spec)
        bare = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}
        self.merges = Tokenizer.from_str(json.dumps(described | bare | {"added_tokens": [], "truncation": None, "padding": None}))
        letter, mark = "A-Za-zÀ-ÖØ-öø-įı-ɏ", r"!-&(-/:-;=?-@\[-`{}~"  # no U+0130, whose lower case has a mark; no apostrophe, nor the signs of special tokens
        self.parts = re.compile(rf"[{letter}]+(?=[ \n{mark}]|\Z)|[{mark}]+(?=[ \n{letter}]|\Z)|[^ \n]+").findall
        self.whole = re.compile(rf"[{letter}]+|[{mark}]+").fullmatch
        self.known: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        simple = list(filter(self.whole, new))
        found: dict[str, bytes] = {}
        if simple:
            encoded = self.merges.encode([p.lower() for p in simple], is_pretokenized=True, add_special_tokens=False)
            raw = np.array(encoded.ids, "<u4").tobytes()
            ends = (4 * np.cumsum(np.bincount(encoded.word_ids, minlength=len(simple)))).tolist()
            found = dict(zip(simple, [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)], strict=True))
        rest = [p for p in new if p not in found]
        for p, e in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            found[p] = np.array(e.ids, "<u4").tobytes()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.known.update(found if max(map(len, found)) <= LONGEST else {p: x for p, x in found.items() if len(p) <= LONGEST})
        return found

    def _split(self, text: str) -> list[str]:
        bare = text.replace(" ", "").replace(",", "").replace(".", "").replace("\n", "")
        if bare.isalnum() and _latin(bare) and not any(x in text for x in ("..", ",,", ".,", ",.")):
            # Latin-1 letters and digits with lone commas and full stops: each of these is a pre-token of its own
            return text.replace(".", " .").replace(",", " ,").replace("\n", " ").split(" ")
        return self.parts(text)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        split = list(map(self._split, texts))
        looked = [list(map(self.known.get, parts)) for parts in split]
        gaps = [[i for i, x in enumerate(entries) if x is None] if None in entries else [] for entries in looked]
        missing = {parts[i] for parts, places in zip(split, gaps, strict=True) for i in places}
        if missing:
            found = self._learn(list(missing))
            for parts, entries, places in zip(split, looked, gaps, strict=True):
                for i in places:
                    entries[i] = found[parts[i]]
        return [b"".join(entries) for entries in looked]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


def _encoder(spec: str) -> WordEncoder:
    key, made = hashlib.blake2b(spec.encode(), digest_size=16).digest(), worker_cache("tokens")
    if key not in made:
        made.clear()
        made[key] = WordEncoder(spec)
    return made[key]


def merkle(keys: list[bytes]) -> bytes:
    """Root of a binary tree of BLAKE2b-128 over `keys`; an odd one out moves up as it is."""
    level = [hashlib.blake2b(b"\0" + k, digest_size=16).digest() for k in keys] or [bytes(16)]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + b"".join(level[i : i + 2]), digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


class MerkleStream:
    """The same root from keys that come one after another, with memory for one node a level."""

    def __init__(self) -> None:
        self.levels: list[bytes | None] = []

    def add(self, key: bytes) -> None:
        node = hashlib.blake2b(b"\0" + key, digest_size=16).digest()
        for i, left in enumerate(self.levels):
            if left is None:
                self.levels[i] = node
                return
            self.levels[i] = None
            node = hashlib.blake2b(b"\1" + left + node, digest_size=16).digest()
        self.levels.append(node)

    def root(self) -> bytes:
        node = None
        for left in self.levels:
            if left is not None:
                node = left if node is None else hashlib.blake2b(b"\1" + left + node, digest_size=16).digest()
        return node or bytes(16)


def boundaries(ids: np.ndarray) -> np.ndarray:
    """Whether a chunk may end after each id: a hash of the 16 ids up to it, made by doubling, meets the mask."""
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        for step, factor in ((1, 0xBF58476D1CE4E5B9), (2, 0x94D049BB133111EB), (4, 0xD6E8FEB86659FD93), (8, 0xA0761D6478BD642F)):
            later = h.copy()
            later[step:] += h[:-step] * np.uint64(factor)
            h = later
    return (h >> np.uint64(33)) % np.uint64(USUAL) == 0


def cut(candidates: np.ndarray, n: int) -> list[int]:
    """Ends of the chunks of a document of `n` ids, whose possible ends are `candidates` (positions after an id)."""
    ends, last = [], 0
    for c in candidates.tolist():
        while c - last > MOST:
            last += MOST
            ends.append(last)
        if c - last >= LEAST:
            ends.append(c)
            last = c
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if n > last:
        ends.append(n)
    return ends


def pack(ids: np.ndarray) -> bytes:
    small = not len(ids) or int(ids.max()) < 1 << 16
    return (b"\2" if small else b"\4") + ids.astype("<u2" if small else "<u4").tobytes()


def unpack(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, "<u2" if payload[0] == 2 else "<u4", offset=1).astype("<u4")


def write_store(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, key: str = "doc_id", text: str = "text") -> str:
    """Encode each whole `text` with the tokenizers library (a JSON file that the driver can read), append `end_id`, and write a store; its path is returned."""
    spark = docs.sparkSession
    path = path or new_folder(spark, "tokens")
    with open(tokenizer, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    binary = pa.large_binary() if spark.conf.get("spark.sql.execution.arrow.useLargeVarTypes", "false") == "true" else pa.binary()
    schema = pa.schema([("kind", pa.string()), ("key", binary), ("payload", binary), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("keys", pa.list_(binary)), ("sizes", pa.list_(pa.int32())), ("root", binary)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sent = _encoder(shared.value), set()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                raws = [x + end for x in encoder.encode_many([t or "" for t in some.column(1).to_pylist()])]
                ids = np.frombuffer(b"".join(raws), "<u4")
                lengths = np.array([len(r) // 4 for r in raws])
                stops = np.cumsum(lengths)
                found = np.flatnonzero(boundaries(ids)) + 1
                low, high = np.searchsorted(found, stops - lengths, "right"), np.searchsorted(found, stops, "left")
                chunks: list[tuple[bytes, bytes]] = []
                recipes = []
                for i, (n, stop) in enumerate(zip(lengths.tolist(), stops.tolist(), strict=True)):
                    start, keys, sizes, last = stop - n, [], [], 0
                    for e in cut(found[low[i] : high[i]] - start, n):
                        payload = pack(ids[start + last : start + e])
                        name = hashlib.blake2b(payload, digest_size=16).digest()
                        keys.append(name)
                        sizes.append(e - last)
                        last = e
                        if name not in sent:  # a task sends a chunk once, as far as it remembers
                            if len(sent) > REMEMBERED:
                                sent.clear()
                            sent.add(name)
                            chunks.append((name, payload))
                    recipes.append((n, keys, sizes, merkle(keys)))
                m, r = len(chunks), len(recipes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(["chunk"] * m + ["recipe"] * r),
                        pa.array([c[0] for c in chunks] + [None] * r, binary),
                        pa.array([c[1] for c in chunks] + [None] * r, binary),
                        pa.concat_arrays([pa.nulls(m, pa.int64()), some.column(0).cast(pa.int64())]),
                        pa.array([None] * m + [x[0] for x in recipes], pa.int64()),
                        pa.array([None] * m + [x[1] for x in recipes], pa.list_(binary)),
                        pa.array([None] * m + [x[2] for x in recipes], pa.list_(pa.int32())),
                        pa.array([None] * m + [x[3] for x in recipes], binary),
                    ],
                    schema=schema,
                )

    made = small_batches(docs).select(F.col(key).cast("long"), text).mapInArrow(work, "kind string, key binary, payload binary, doc_id long, n_tokens long, keys array<binary>, sizes array<int>, root binary")
    # each task sends a chunk once, so a key has as many rows as there are tasks at most; recipes are dealt by document and never compared
    nth = F.row_number().over(Window.partitionBy("kind", "key", "doc_id", "root").orderBy("kind"))
    objects = made.withColumn("_nth", nth).filter((F.col("kind") == "recipe") | (F.col("_nth") == 1)).drop("_nth")
    objects.write.partitionBy("kind").option("compression", "snappy").parquet(f"{path}/objects")
    _write_recipes(spark, path)
    return path


_OBJECTS = "key binary, payload binary, doc_id long, n_tokens long, keys array<binary>, sizes array<int>, root binary"
_RECIPES = "pid int, doc_id long, local_start long, n_tokens long, keys array<binary>, sizes array<int>, root binary, file_root binary"


def _objects(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(_OBJECTS + ", kind string").parquet(f"{path}/objects").filter(F.col("kind") == kind).drop("kind")


def _write_recipes(spark: SparkSession, path: str) -> None:
    """Recipes in document order, with running sums within each file."""
    rows = _objects(spark, path, "recipe").select("doc_id", "n_tokens", "keys", "sizes", "root")
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "root").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root")
    rows = rows.withColumn("pid", F.spark_partition_id())

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, roots, held = 0, MerkleStream(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield held
            n = batch.column(1).to_numpy()
            starts = before + np.cumsum(n) - n
            before += int(n.sum())
            for x in batch.column(4):
                roots.add(x.as_py())
            binary = batch.schema.field(4).type
            held = pa.RecordBatch.from_arrays(
                [batch.column(5), batch.column(0), pa.array(starts, pa.int64()), *(batch.column(i) for i in range(1, 5)), pa.nulls(batch.num_rows, binary)],
                ["pid", "doc_id", "local_start", "n_tokens", "keys", "sizes", "root", "file_root"],
            )
        if held is not None:
            last = pa.array([None] * (held.num_rows - 1) + [roots.root()], held.schema.field(7).type)
            yield held.set_column(7, "file_root", last)

    rows.mapInArrow(running, _RECIPES).write.option("compression", "zstd").parquet(f"{path}/recipes")
    stated = spark.read.schema(_RECIPES).parquet(f"{path}/recipes").filter("file_root is not null").select("pid", "file_root").toArrow()  # a row a file
    spark.createDataFrame([_manifest(zip(*(c.to_pylist() for c in stated.columns), strict=True))], _MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")


_MANIFEST = "files long, root binary"


def _manifest(files: Iterable[tuple[int, bytes]]) -> tuple[int, bytes]:
    """How many files of recipes there are, and the Merkle root of their roots in the order of their numbers."""
    ordered, roots = sorted(files), MerkleStream()
    for _, root in ordered:
        roots.add(root)
    return len(ordered), roots.root()


def verify(spark: SparkSession, path: str) -> None:
    """Fail unless all files of recipes are there and meet their roots and the manifest; a row a file comes to the driver."""
    pids, stated, made = (c.to_pylist() for c in file_roots(spark, path).toArrow().columns)
    broken = [p for p, s, m in zip(pids, stated, made, strict=True) if s != m]
    if broken:
        raise ValueError(f"files of recipes don't meet their roots: {broken[:5]}")
    manifest = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").first()
    if manifest is None or (manifest.files, bytes(manifest.root)) != _manifest(zip(pids, stated, strict=True)):
        raise ValueError("files of recipes are missing or don't meet the manifest")


def recipes(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with `start`, the ids of all documents before each."""
    rows = spark.read.schema(_RECIPES).parquet(f"{path}/recipes")
    totals = rows.groupBy("pid").agg(F.sum("n_tokens").alias("n"))
    # one row a file: a window over them is small, and so is its broadcast
    before = totals.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("pid", "_before")
    return rows.join(F.broadcast(before), "pid").withColumn("start", F.col("_before") + F.col("local_start")).drop("_before")


def _applied(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A GF(2) matrix, by columns, times each value."""
    out = np.zeros_like(values)
    for i in range(32):
        out ^= matrix[i] * (values >> np.uint32(i) & np.uint32(1))
    return out


@cache
def _doubled(power: int) -> np.ndarray:
    """The matrix that appends 2**power zero bits to a CRC-32."""
    if power == 0:
        return np.array([0xEDB88320, *(1 << i for i in range(31))], np.uint32)
    return _applied(_doubled(power - 1), _doubled(power - 1))


def join_crcs(crcs: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """CRC-32s of pieces that lie one after the other in groups; `sizes` in bytes, `starts`: the first piece of each group (none is empty)."""
    ends = np.append(starts[1:], len(sizes))
    total = np.cumsum(sizes)
    bits = 8 * (np.repeat(total[ends - 1], ends - starts) - total)  # what follows a piece in its group
    values = crcs.astype(np.uint32)
    for power in range(int(bits.max(initial=0)).bit_length()):
        some = np.flatnonzero(bits >> power & 1)
        values[some] = _applied(_doubled(power), values[some])
    return np.bitwise_xor.reduceat(values, starts)


def _chunk_digests(spark: SparkSession, path: str) -> DataFrame:
    """Each stored chunk's key, number of ids and their CRC-32, after the payload was held against the key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, crcs = [], []
            for name, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if hashlib.blake2b(payload, digest_size=16).digest() != name:
                    raise ValueError(f"chunk {name.hex()} is damaged")
                ids = unpack(payload)
                sizes.append(len(ids))
                crcs.append(zlib.crc32(ids.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(crcs, pa.int64())], ["key", "n", "crc"])

    return _objects(spark, path, "chunk").select("key", "payload").mapInArrow(work, "key binary, n int, crc long")


def _exploded(rows: DataFrame) -> DataFrame:
    return rows.select("pid", "doc_id", "start", "n_tokens", "root", F.posexplode("keys").alias("pos", "key"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, from its files; fails if a chunk or a file is lost or damaged or a recipe doesn't meet its root."""
    verify(spark, path)
    parts = _exploded(recipes(spark, path)).join(_chunk_digests(spark, path), "key", "left")
    docs = parts.groupBy("start", "doc_id", "n_tokens", "root").agg(F.sort_array(F.collect_list(F.struct("pos", "key", "n", "crc"))).alias("parts"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column(4)
            ends = np.cumsum(parts.value_lengths().to_numpy())
            starts = np.concatenate([[0], ends[:-1]])
            _, keys, sizes, crcs = parts.flatten().flatten()
            if sizes.null_count:
                raise ValueError("a document can't be rebuilt from its recipe: chunks are missing")
            sizes, names = sizes.to_numpy(), keys.to_pylist()
            if (np.add.reduceat(sizes, starts) != batch.column(2).to_numpy()).any() or [merkle(names[i:j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)] != batch.column(3).to_pylist():
                raise ValueError("a document can't be rebuilt from its recipe")
            crcs = join_crcs(crcs.to_numpy(), 4 * sizes.astype(np.int64), starts)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), batch.column(2), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return docs.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids of every stored document, put together from its chunks, with the same checks."""
    verify(spark, path)
    chunks = _objects(spark, path, "chunk").select("key", "payload")
    docs = _exploded(recipes(spark, path)).join(chunks, "key", "left").groupBy("start", "doc_id", "n_tokens", "root").agg(F.sort_array(F.collect_list(F.struct("pos", "key", "payload"))).alias("parts"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for root, parts in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if merkle([hashlib.blake2b(p["payload"] or b"", digest_size=16).digest() for p in parts]) != root:
                    raise ValueError("a document can't be rebuilt from its recipe")
                out.append(np.concatenate([unpack(p["payload"]) for p in parts]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "start", "ids"])

    return docs.mapInArrow(work, "doc_id long, start long, ids array<long>")


def file_roots(spark: SparkSession, path: str) -> DataFrame:
    """`pid`, `stated` and `made` of every recipe file: the root that it states and that of its documents' roots."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, roots, stated, kind = None, MerkleStream(), None, pa.binary()
        for batch in batches:
            pid, kind = batch.column(0)[0].as_py(), batch.schema.field(1).type
            for root, file_root in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                roots.add(root)
                stated = file_root or stated
        yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([stated], kind), pa.array([roots.root()], kind)], ["pid", "stated", "made"])

    rows = spark.read.schema(_RECIPES).parquet(f"{path}/recipes")
    order = rows.select("pid", "root", "file_root", "local_start").repartition("pid").sortWithinPartitions("pid", "local_start", F.col("file_root").asc_nulls_first())
    return order.select("pid", "root", "file_root").mapInArrow(_by_file(work), "pid int, stated binary, made binary")


def _by_file(work):
    """Apply `work` to each run of rows with one `pid`; a file's rows are one task's output and so of bounded size."""

    def all_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            pids = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(pids)) + 1).tolist(), len(pids)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if held and j > i and held[0].column(0)[0].as_py() != int(pids[i]):
                    yield from work(iter(held))
                    held = []
                if j > i:
                    held.append(batch.slice(i, j - i))
        if held:
            yield from work(iter(held))

    return all_files
