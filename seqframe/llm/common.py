"""What the operators of this subpackage share: the shared work folder, written tables and samples."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of rows that go to a Python worker at once.
ARROW_BYTES = 4 << 20
#: How many times the keys that a stratum may give are ordered for it.
SLACK = 4

_LEFT: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: `spark.checkpoint.dir`.

    Only where that setting is absent and all tasks run in the driver's own
    process (as in tests) a local folder is made and set as the checkpoint
    folder; a cluster without that setting is an error, as a machine's own
    folder can't be seen by the others.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    set_already = spark.sparkContext.getCheckpointDir()
    if set_already:
        return set_already.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="seqframe-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; removed when the driver ends."""
    path = f"{shared_folder(spark)}/seqframe/{name}-{uuid.uuid4().hex}"
    if not _LEFT:
        atexit.register(_sweep)
    _LEFT.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _sweep() -> None:
    for spark, path in _LEFT:
        with contextlib.suppress(Exception):  # its session may have ended: then it can't be reached any more
            remove(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back, so later uses need neither its lineage nor one executor's disk."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame) -> DataFrame:
    """`df`; from now on its session sends rows to Python in Arrow batches of `ARROW_BYTES` at most (a longer row goes alone), as texts may be long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df


_HELD: dict[str, dict[bytes, object]] = {}


def worker_cache(operator: str) -> dict[bytes, object]:
    """What one operator keeps from task to task in a Python worker; what others kept there is given up, so that memory holds one operator's at a time."""
    if operator not in _HELD:
        _HELD.clear()
        gc.collect()
        give_back()
    return _HELD.setdefault(operator, {})


def give_back() -> None:
    """Give memory that is free in this process back to the system; after a task whose arrays were large."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries can
        ctypes.CDLL(None).malloc_trim(0)


def fresh_name(name: str, *taken: Iterable[str]) -> str:
    """`name`, with underscores before it until no column of `taken` is called so, in whatever case."""
    used = {x.lower() for names in taken for x in names}
    while name.lower() in used:
        name = "_" + name
    return name


def row_columns(key: str, text: str) -> list[Column]:
    """`doc_id`, `h1` and `h2`: a row's identity, 96 bits of hash of its text beside its key, as keys may be null or repeated. Rows that agree in both are repeated rows."""
    return [F.col(key).alias("doc_id"), F.xxhash64(text).alias("h1"), F.hash(text).alias("h2")]


def with_facts(docs: DataFrame, facts: DataFrame, key: str, text: str, how: str) -> DataFrame:
    """`docs` in a struct `row`, joined with `facts` (doc_id, h1, h2 and others, one row each) by identity.

    Columns of any name may stand in `docs`. The facts are small beside the texts: each partition's are hashed, so texts aren't sorted.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_columns(f"`{key}`", f"`{text}`"))
    other = facts.withColumnsRenamed({"doc_id": "_d", "h1": "_h1", "h2": "_h2"}).hint("shuffle_hash")
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("h1").eqNullSafe(F.col("_h1")) & F.col("h2").eqNullSafe(F.col("_h2"))
    out = rows.join(other, same, how)
    return out.drop("doc_id", "h1", "h2", "_d", "_h1", "_h2")


#: A key is hot if it has over 1/HOT of all rows, so there are HOT such keys at most, and over FEW rows.
HOT, FEW = 1000, 64


def threshold(total: int) -> float:
    return max(total / HOT, FEW)


def spread_join(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """`rows` inner joined with `facts` (one row a key; `_n`: how many of all `total` rows, at least, the key has; dropped).

    Facts of hot keys, `HOT` at most, are broadcast and their rows stay where they are; all others meet in a shuffle.
    """
    many = F.lit(threshold(total))
    hot = F.broadcast(facts.filter(F.col("_n") > many).drop("_n"))
    rest = rows.join(hot.select(key), key, "left_anti").join(facts.filter(F.col("_n") <= many).drop("_n"), key)
    return rows.join(hot, key).unionByName(rest)


def hot_keys(rows: DataFrame, key: str, *facts: Column) -> DataFrame | None:
    """The hot values of `key` and their `facts` (aggregates), `HOT` rows at most; None if there are none.

    Rows are counted by a hash of the key into a fixed number of buckets first; only keys of heavy buckets are counted each.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(1 << 16))
    counts = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).toArrow()  # a row a bucket, so of fixed size
    sizes = counts.column("n").to_numpy()
    many = threshold(int(sizes.sum()))
    heavy = counts.column("bucket").to_numpy()[sizes > many].tolist()
    if not heavy:
        return None
    return rows.filter(bucket.isin(heavy)).groupBy(key).agg(F.count("*").alias("_n"), *facts).filter(F.col("_n") > many).drop("_n")


def slices(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose `column` holds about `most_bytes` at most (one longer value stays alone)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column_bytes = batch.column(column).nbytes
        if column_bytes <= most_bytes:
            yield batch
            continue
        sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)]
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def stratified_ids(df: DataFrame, key: str, group: str, each: int, salt: str, sizes: DataFrame | None = None) -> DataFrame:
    """Up to `each` distinct values of `key` per `group`, those of least hash, so alike on every run and partitioning.

    Repeated rows of a key and group are one, before anything is counted. Groups are counted first, so that only about `SLACK` * `each` keys of
    a group go on to be ordered, however large it is. The counts are broadcast: a row a group, far smaller than the model that is made
    of `each` texts a group and broadcast too.
    """
    place = F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(1 << 30))
    pairs = df.select(key, group).distinct()
    sizes = pairs.groupBy(group).agg(F.count("*").alias("_size")) if sizes is None else sizes
    order = Window.partitionBy(group).orderBy("_place", F.col(key))
    # in doubles, as the product leaves 64 bits once a group has 2^33 rows
    near = pairs.select(key, group, place.alias("_place")).join(F.broadcast(sizes), group).filter(F.col("_place").cast("double") * F.col("_size") < F.lit(float(SLACK * each * (1 << 30))))
    return near.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= each).select(key, group)


def bounded_rows(df: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """The rows of `df` whose `columns` are in `ids`, distinct rows of a proven number (see `stratified_ids`), so they may be broadcast."""
    return df.join(F.broadcast(ids), list(columns), "inner")
