"""Row numbers and neighbours in a global order, over sorted ranges of rows.

Rows are dealt into sorted ranges and written down once, so that a second look at them sees the same
ranges. Each range counts its rows and names its first and last key; of that the driver sees one row
a range and gives each range its offset and what stands just outside it. No task holds more than a
range. Rows with equal order go to one range, so an order ends in a key.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_PLACE = (1 << 33) - 1


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written to the checkpoint folder of the session.

    That folder is spark.checkpoint.dir; only where it is unset, and only in local mode (tests), a temporary one stands in.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not named:
            named = tempfile.mkdtemp(prefix="driftmark-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return df.checkpoint()


def in_ranges(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """df in sorted ranges, with dm_part (the range) and dm_at (grows along the whole order); lineage ends there."""
    at = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("dm_at", at)
    return cut(placed).withColumn("dm_part", F.shiftright("dm_at", 33))


def with_offsets(placed: DataFrame, out: str) -> DataFrame:
    """placed (dm_part, dm_at) with the gapless number of each row, from 1, in the order of dm_at."""
    sizes = sorted(tuple(r) for r in placed.groupBy("dm_part").agg(F.count("*")).collect())  # a row for each range
    before, rows = 0, []
    for part, n in sizes:
        rows.append((part, before))
        before += n
    offsets = placed.sparkSession.createDataFrame(rows, "dm_part long, dm_before long")
    numbered = placed.join(F.broadcast(offsets), "dm_part")
    return numbered.withColumn(out, F.col("dm_before") + F.col("dm_at").bitwiseAND(F.lit(_PLACE)) + 1).drop("dm_before")


def numbered(df: DataFrame, order: list[Column | str], out: str) -> DataFrame:
    """df with ``out``: the number of each row in the order, from 1."""
    return with_offsets(in_ranges(df, order), out).drop("dm_part", "dm_at")


def in_read_order(df: DataFrame, out: str) -> DataFrame:
    """df with ``out``: the number of each row, from 0, in the order in which its partitions were read; they are read once."""
    placed = cut(df.withColumn("dm_at", F.monotonically_increasing_id())).withColumn("dm_part", F.shiftright("dm_at", 33))
    return with_offsets(placed, out).withColumn(out, F.col(out) - 1).drop("dm_part", "dm_at")


def neighbours(df: DataFrame, key: str, order: list[Column | str], previous: str = "previous", following: str = "next") -> DataFrame:
    """df with the keys of the rows before and after each row in the order, null at both ends."""
    placed = in_ranges(df, order)
    edges = placed.groupBy("dm_part").agg(F.min_by(key, "dm_at"), F.max_by(key, "dm_at")).collect()  # a row for each range
    ends = sorted((tuple(r) for r in edges), key=lambda r: r[0])
    rows = [(part, ends[i - 1][2] if i else None, ends[i + 1][1] if i + 1 < len(ends) else None) for i, (part, *_) in enumerate(ends)]
    kind = df.schema[key].dataType.simpleString()
    outside = placed.sparkSession.createDataFrame(rows, f"dm_part long, dm_first {kind}, dm_last {kind}")
    w = W.partitionBy("dm_part").orderBy("dm_at")
    # A neighbour in the range is told from none by its place, as keys may be null.
    near = {"dm_b": F.lag(F.struct(key)).over(w), "dm_a": F.lead(F.struct(key)).over(w)}
    met = placed.withColumns(near).join(F.broadcast(outside), "dm_part")
    pick = lambda inner, outer: F.when(F.col(inner).isNull(), F.col(outer)).otherwise(F.col(f"{inner}.{key}"))
    return met.withColumns({previous: pick("dm_b", "dm_first"), following: pick("dm_a", "dm_last")}).select(*df.columns, previous, following)
