"""J2 on streams: mates are paired as their files come, each used once, with what waits for its mate kept as state by name.

`pair_mates` takes two streams of records. A record whose mate is there already gives a row at once; any other waits in the
state of its name, through later batches and restarts from the checkpoint. Each record is in one pair at most, and once all files have
come the pairs are as many as the batch join gives, whatever their order. Where a name isn't repeated they are its rows; of records
that share a name those that come together are paired in order of `rid`, so which of them meet follows their files.

State is a record a waiting name, spread by name; a name's waiting records are one task's, so a name that most records share has no place here: use
`operators.reorder.reorder_mates`, which slices such names.

The state needs Spark's RocksDB store; `start_pairs` sets it for the query that it starts and puts the session's setting back.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from seqframe.functions.sequence import with_suffix
from seqframe.operators.reorder import mate_key

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: What a waiting record is: its ordinal and its other columns as text, so that pandas changes no numbers that may be null.
_WAITING = StructType([StructField("rid", LongType()), StructField("rest", StringType())])
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


class Pairing(StatefulProcessor):
    """Per name: the records of either side that wait, of which one side has none."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first, self.second = handle.getListState("first", _WAITING), handle.getListState("second", _WAITING)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        waiting = [[tuple(r) for r in state.get()] if state.exists() else [] for state in (self.first, self.second)]
        new: list[list[tuple[int, str | None]]] = [[], []]
        for some in rows:
            for side, rid, rest in zip(some["side"].tolist(), some["rid"].tolist(), some["rest"].tolist(), strict=True):
                new[side].append((rid, rest))
        first, second = (old + sorted(more, key=lambda r: r[0]) for old, more in zip(waiting, new, strict=True))
        n = min(len(first), len(second))
        if n:
            yield pd.DataFrame([(key[0], a, rest) for (a, _), (_, rest) in zip(first[:n], second[:n], strict=True)], columns=["name", "rid", "rest"])
        for state, left in ((self.first, first[n:]), (self.second, second[n:])):
            state.clear()
            if left:
                state.put(left)

    def close(self) -> None:
        pass


def pair_mates(first: DataFrame, second: DataFrame, suffix: str = "chop2") -> DataFrame:
    """The streamed records of `second` that have a mate in `first` (both `rid`, a long, and `name`; `second` with more columns), with its `rid`, named like it with /2; in append mode."""
    more = [c for c in second.columns if c not in ("rid", "name")]
    kinds = StructType([StructField(f.name, f.dataType) for f in second.select(*more).schema.fields])
    rest = F.to_json(F.struct(*more), _TIMES) if more else F.lit("{}")
    a = first.select(mate_key(F.col("name"), suffix).alias("_name"), F.lit(0).alias("side"), F.col("rid").cast("long"), F.lit("").alias("rest"))
    b = second.select(mate_key(F.col("name"), suffix).alias("_name"), F.lit(1).alias("side"), F.col("rid").cast("long"), rest.alias("rest"))
    out = StructType([StructField("name", StringType()), *_WAITING.fields])
    paired = a.unionByName(b).groupBy("_name").transformWithStateInPandas(Pairing(), outputStructType=out, outputMode="Append", timeMode="None")
    columns = [F.from_json("rest", kinds, _TIMES)[c].alias(c) for c in more]
    return paired.select("rid", with_suffix(F.col("name")).alias("name"), *columns)


def start_pairs(pairs: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Pair all that is there now, appending Parquet files to `output`; `checkpoint` holds what was read and what waits."""
    conf = pairs.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKS)
    try:
        query = pairs.writeStream.outputMode("append").format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query
    finally:
        conf.set(_PROVIDER, before) if before else conf.unset(_PROVIDER)
