"""Connected components of an edge table, by large stars and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def components(edges: DataFrame, scope: str, most: int = 60) -> DataFrame:
    """(node, root) of every node that is not its component's least one; edges: u, v long.

    Each turn hangs the neighbours of a node on the least of them, first the larger ones, then the
    others; edges shrink to stars. Every turn is a table in the shared folder, nothing reaches the
    driver but a count and a checksum. A hub's rows are counted before they are shuffled, and its side of
    a join is split by AQE where it stands out.
    """
    at = shared.stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), scope)
    seen = None
    for _ in range(most):
        both = at.union(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # As a table, so that AQE can broadcast it, or split a hub's rows, in the join that follows.
        least = shared.stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), scope)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        at = shared.stored(small, scope)
        now = tuple(at.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == seen:
            return at.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
    raise RuntimeError("components did not settle")
