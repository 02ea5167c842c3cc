"""Alias resolution by look-up tables, with a trace of what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.functions import text as T


def alias_table(names: DataFrame, column: str = "name") -> DataFrame:
    """(alias, name) from official names: with and without the level word, with and without accents, and without spaces.

    An alias that two names share is left out.
    """
    full = T.normalise_text(column)
    bare = T.comparable(column)
    forms = F.array_distinct(F.array(full, bare, T.strip_accents(full), T.strip_accents(bare), F.replace(T.strip_accents(bare), F.lit(" "), F.lit(""))))
    every = names.select(F.explode(forms).alias("alias"), F.col(column).alias("name")).where("alias <> ''").distinct()
    return every.groupBy("alias").agg(F.min("name").alias("name"), F.count("*").alias("n")).where("n = 1").select("alias", "name")


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(alias, name) from a two-column CSV file with a header."""
    rows = spark.read.csv(path, header=True, schema="alias string, name string")
    return rows.select(T.normalise_text("alias").alias("alias"), T.clean_value("name").alias("name")).where("alias <> ''").dropDuplicates(["alias"])


def resolve(df: DataFrame, tables: dict[str, DataFrame], suffix: str = "_Chuan") -> DataFrame:
    """df with column + suffix for each column of ``tables``: the name of its alias, or the cleaned value."""
    for c, table in tables.items():
        side = table.select(F.col("alias").alias("dm_alias"), F.col("name").alias("dm_name"))
        df = df.join(side, T.normalise_text(c) == F.col("dm_alias"), "left").withColumn(c + suffix, F.coalesce("dm_name", T.clean_value(c))).drop("dm_alias", "dm_name")
    return df


def trace(columns: list[str], suffix: str = "_Chuan") -> Column:
    """"column: old → new" for each column that resolution changed, in order."""
    each = [F.when(T.clean_value(c) != T.clean_value(c + suffix), F.concat(F.lit(f"{c}: "), T.clean_value(c), F.lit(" → "), T.clean_value(c + suffix))) for c in columns]
    return F.filter(F.array(*each), lambda x: x.isNotNull())
