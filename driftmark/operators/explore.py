"""Filtering, searching and paging of records for interactive review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_SIZES = (25, 50, 100, 200)


def tool_pairs(predictions: DataFrame, first: str, second: str) -> DataFrame:
    """A row for each ID with the statuses of two tools (NONE where one has none) and their comparison."""
    side = lambda t, n: predictions.where(F.col("CongCu") == t).select("ID", F.col("DungSai").alias(n))
    ids = predictions.select("ID", "DiaChiGoc", "TruongDung").dropDuplicates(["ID"])
    met = ids.join(side(first, "first"), "ID", "left").join(side(second, "second"), "ID", "left").fillna("NONE", ["first", "second"])
    a, b = F.col("first") == "CORRECT", F.col("second") == "CORRECT"
    return met.withColumn("comparison", F.when(a & b, "both").when(a, "first_only").when(b, "second_only").otherwise("neither"))


def search(df: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """Rows that hold the term in any of the columns, in any case."""
    return df.where(F.lower(F.concat_ws("\n", *[F.col(c).cast("string") for c in columns])).contains(term.lower())) if term else df


def page(df: DataFrame, order: list[Column | str], number: int, size: int = 50) -> DataFrame:
    """The number-th page (from 1)."""
    if size not in PAGE_SIZES:
        raise ValueError(f"page sizes are {PAGE_SIZES}")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def seek(df: DataFrame, order: list[str], after: tuple | None = None, size: int = 50) -> DataFrame:
    """The page of rows that follow the row whose order columns are ``after`` (None: the first page).

    Rows before it are filtered out at the scan, not sorted and skipped. The order ends in a key, is ascending and has no nulls.
    """
    if size not in PAGE_SIZES:
        raise ValueError(f"page sizes are {PAGE_SIZES}")
    if after is not None:
        later = None
        for c, v in reversed(list(zip(order, after, strict=True))):
            later = F.col(c) > F.lit(v) if later is None else (F.col(c) > F.lit(v)) | ((F.col(c) == F.lit(v)) & later)
        df = df.where(F.col(order[0]) >= F.lit(after[0])).where(later)
    return df.orderBy(*order).limit(size)


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, option, n): how many rows each value of each column has, all columns in one pass over the grouping sets; nulls are the option ""."""
    kept = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    counted = kept.groupingSets([[F.col(c)] for c in columns], *columns).agg(F.count("*").alias("n"), F.grouping_id().alias("dm_set"))
    # Of a set's bits, the first column's first, the one that is 0 is the column.
    full = (1 << len(columns)) - 1
    which = {full ^ (1 << (len(columns) - 1 - i)): c for i, c in enumerate(columns)}
    name = F.coalesce(*[F.when(F.col("dm_set") == k, F.lit(c)) for k, c in which.items()])
    return counted.select(name.alias("facet"), F.coalesce(*columns).alias("option"), "n")
