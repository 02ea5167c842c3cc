"""Coverage of a table on several axes, with zero rows for expected categories, and warnings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def axis_counts(df: DataFrame, axes: dict[str, tuple[Column, list[str]]]) -> DataFrame:
    """(axis, category, n): counts of every axis, zero for an expected category that does not occur."""
    spark = df.sparkSession
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), c.cast("string").alias("category")) for a, (c, _) in axes.items()]))
    seen = df.select(each.alias("r")).select("r.axis", "r.category").groupBy("axis", "category").agg(F.count("*").alias("n"))
    expected = spark.createDataFrame([(a, v) for a, (_, vs) in axes.items() for v in vs], "axis string, category string")
    met = seen.join(expected, ["axis", "category"], "full_outer")
    return met.select("axis", "category", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def top_values(df: DataFrame, value: Column, k: int = 10) -> DataFrame:
    """The k most frequent values (ties by value)."""
    return df.select(value.alias("value")).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def direct_counts(df: DataFrame, direct: Column, group: str, expected: list[str]) -> DataFrame:
    """(subject, n): rows with direct evidence of each group, zero for an expected one without any."""
    got = df.where(direct).groupBy(F.col(group).cast("string").alias("subject")).agg(F.count("*").alias("k"))
    dim = df.sparkSession.createDataFrame([(e,) for e in expected], "subject string")
    return dim.join(got, "subject", "full_outer").select("subject", F.coalesce("k", F.lit(0)).cast("long").alias("n"))


def warnings(df: DataFrame, direct: Column, group: str, expected: list[str], low: tuple[Column, float] | None = None) -> DataFrame:
    """(rule, subject, n, total): no rows at all, groups without a direct row, derived rows at all, and a share that is too low."""
    spark = df.sparkSession
    got = df.groupBy(F.col(group).alias("subject")).agg(F.count_if(direct).alias("n"))
    total = df.agg(F.count("*").alias("total"))
    dim = spark.createDataFrame([(e,) for e in expected], "subject string")
    none = dim.join(got, "subject", "left").where("coalesce(n, 0) = 0").select(F.lit("no_direct_sample").alias("rule"), "subject", F.lit(0).cast("long").alias("n")).crossJoin(F.broadcast(total))  # one row
    derived = df.agg(F.count_if(~direct).alias("n"), F.count("*").alias("total")).where("n > 0").select(F.lit("derived_rows").alias("rule"), F.lit("").alias("subject"), "n", "total")
    empty = total.where("total = 0").select(F.lit("empty").alias("rule"), F.lit("").alias("subject"), F.lit(0).cast("long").alias("n"), "total")
    parts = [none, derived, empty]
    if low:
        parts.append(df.agg(F.count_if(low[0]).alias("n"), F.count("*").alias("total")).where(F.col("n") < low[1] * F.col("total")).select(F.lit("low_share").alias("rule"), F.lit("").alias("subject"), "n", "total"))
    return reduce(DataFrame.unionByName, parts)
