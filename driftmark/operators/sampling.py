"""Seeded samples that do not depend on partitioning: order by a hash of seed and key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftmark.functions.text import col
from driftmark.operators import order


class QuotaError(ValueError):
    """A sample cannot reach its size."""


def hash_order(seed: int, key: Column | str) -> Column:
    """What a seeded shuffle sorts by; add the key itself after it."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), col(key).cast("string")))


def shuffled(df: DataFrame, seed: int, key: Column | str) -> DataFrame:
    return df.orderBy(hash_order(seed, key), col(key))


def uniform(df: DataFrame, n: int, seed: int, key: Column | str) -> DataFrame:
    """n rows without replacement."""
    return shuffled(df, seed, key).limit(n)


def numbered(df: DataFrame, seed: int, key: Column | str, pattern: str, out: str = "ID") -> DataFrame:
    """df with ids in shuffled order: numbers over sorted ranges, so no task sees the whole."""
    return order.numbered(df, [hash_order(seed, key), col(key)], "dm_n").withColumn(out, F.format_string(pattern, "dm_n")).drop("dm_n")


def stratified(df: DataFrame, n: int, strata: list[str], seed: int, key: Column | str, at_least_strata: bool = False) -> DataFrame:
    """n rows: first one of each stratum, then the rest uniformly. With ``at_least_strata`` never fewer than strata."""
    by = [hash_order(seed, key), col(key)]
    ranked = df.withColumn("dm_order", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(by)]))
    # The first of a stratum is a partial aggregate, so that no task ranks a whole stratum.
    first = ranked.groupBy(*strata).agg(F.min("dm_order").alias("dm_order"))
    if at_least_strata:
        n = max(n, first.count())
    tagged = ranked.join(first.select("dm_order", F.lit(0).alias("dm_first")), "dm_order", "left").fillna(1, ["dm_first"])
    return tagged.orderBy("dm_first", "dm_order").limit(n).select(df.columns)


def quota_chain(df: DataFrame, kind: str, quotas: dict[str, int], surface: str, seed: int, key: Column | str) -> DataFrame:
    """Per kind, in order, ``quota`` rows whose surface no earlier kind has taken; one row for each surface of a kind."""
    by = [hash_order(seed, key), col(key)]
    taken: list[DataFrame] = []
    for name, n in quotas.items():
        own = df.where(F.col(kind) == name)
        own = own.withColumn("dm_r", F.row_number().over(W.partitionBy(surface).orderBy(*by))).where("dm_r = 1").drop("dm_r")
        for before in taken:
            own = own.join(before.select(surface), surface, "left_anti")
        taken.append(own.orderBy(*by).limit(n).select(df.columns))
    return reduce(DataFrame.unionByName, taken)


def require_size(df: DataFrame, n: int, what: str = "rows") -> DataFrame:
    """df, if it has n rows."""
    got = df.count()
    if got != n:
        raise QuotaError(f"only {got} of {n} {what}")
    return df


def excluding(pool: DataFrame, sampled: DataFrame, key: str) -> DataFrame:
    """The pool without what has been sampled."""
    return pool.join(sampled.select(key), key, "left_anti")
