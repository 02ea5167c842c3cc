"""The last state of each entity before and after a cutoff, kept up by a stream of revisions.

Batch before_after() is the definition. The stream holds two versioned states an entity in Spark's
keyed state, takes a revision only if it is later than the one it has, and appends an entity's pair,
numbered, whenever it changes; so revisions may come in any order and more than once. There is no
watermark: a revision may come at any time. The state store and the file sink take care of restarts.
Rows without version or time are no revisions.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastStates(StatefulProcessor):
    """An entity's last state on either side of the cutoff."""

    def __init__(self, keys: list[str], version: T.DataType, state: T.StructType):
        self.keys, self.names = keys, state.names
        self.kind = T.StructType([T.StructField("version", version), T.StructField("state", state)])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sides = {True: handle.getValueState("old", self.kind), False: handle.getValueState("new", self.kind)}
        self.sent = handle.getValueState("sent", "n long")

    def _state(self, value) -> Row | None:
        """A state as a row, whether it comes from the input or (as a dictionary) from the store."""
        return None if value is None else Row(**(value if isinstance(value, dict) else dict(zip(self.names, value, strict=True))))

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        held = {side: value.get() if value.exists() else None for side, value in self.sides.items()}
        later: dict[bool, Row] = {}
        for row in rows:
            known = held[row["dm_before"]]
            if known is None or row["dm_version"] > known[0]:
                held[row["dm_before"]] = later[row["dm_before"]] = (row["dm_version"], row["dm_state"])
        for side, value in later.items():
            self.sides[side].update(value)
        if later:
            n = (self.sent.get()[0] if self.sent.exists() else 0) + 1
            self.sent.update((n,))
            old, new = (self._state(held[side][1]) if held[side] else None for side in (True, False))
            yield Row(**dict(zip(self.keys, key, strict=True)), old=old, new=new, revision=n)


def updates(stream: DataFrame, keys: list[str], order: str, ts: str, state: Column, cutoff: Column) -> DataFrame:
    """Streaming: keys, old, new (state is a struct) and revision, which grows with each row of an entity. Needs the RocksDB state store."""
    rows = stream.select(*keys, F.col(order).alias("dm_version"), (F.col(ts) <= cutoff).alias("dm_before"), state.alias("dm_state")).where("dm_version is not null and dm_before is not null")
    kind = rows.schema["dm_state"].dataType
    out = T.StructType([*(rows.schema[k] for k in keys), T.StructField("old", kind), T.StructField("new", kind), T.StructField("revision", T.LongType())])
    return rows.groupBy(*keys).transformWithState(LastStates(keys, rows.schema["dm_version"].dataType, kind), out, "Append", "None")


def keep(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str, ts: str, state: Column, cutoff: Column) -> StreamingQuery:
    """Start a query that takes in what there is and appends it to the table at ``path``; started again, it goes on."""
    stream.sparkSession.conf.set(STORE, ROCKS)
    made = updates(stream, keys, order, ts, state, cutoff)
    return made.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """keys, old, new: the latest row of each entity in a table that keep() writes."""
    rows = spark.read.parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(F.struct("old", "new"), "revision").alias("dm_last")).select(*keys, "dm_last.old", "dm_last.new")
