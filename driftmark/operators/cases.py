"""Cases that can be traced to their raw responses, and the proof that they can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftmark.operators import contracts, order

COLUMNS = ("ID", "CongCu", "Dataset", "LoaiLoi", "DungSai", "TinhHuongMoHo", "DiaChiGoc", "TruongDuDoan", "TruongDung", "GhiChu", "RawStatus")


def dataset_of(record_id: Column) -> Column:
    return F.split_part(record_id, F.lit("_"), F.lit(1))


def untraceable(predictions: DataFrame, raw: DataFrame) -> DataFrame:
    """(rule, key) of (ID, tool) that are not unique on either side, lack the other side, or differ in their input.

    One grouped pass over both. Inputs are compared as numbers made of their digests: of text, Spark would sort all rows for the least and the greatest.
    """
    lean = lambda df, i, t, x, n: df.select(F.col(i).alias("ID"), F.col(t).alias("tool"), F.sha2(F.col(x), 256).alias("x"), F.lit(n).alias("side"))
    both = lean(predictions, "ID", "CongCu", "DiaChiGoc", 1).unionByName(lean(raw, "id", "tool", "input", 2))
    known = lambda h: F.when(F.col("x").isNotNull(), h)
    both = both.select("ID", "tool", "side", known(F.xxhash64("x")).alias("x"), known(F.xxhash64("x", F.lit(1))).alias("y"))
    met = both.groupBy("ID", "tool").agg(F.count_if(F.col("side") == 1).alias("p"), F.count_if(F.col("side") == 2).alias("r"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("x", "y") for f in (F.min, F.max)])
    apart = (F.col("min_x") != F.col("max_x")) | (F.col("min_y") != F.col("max_y"))
    rule = F.when((F.col("p") > 1) | (F.col("r") > 1), "unique").when((F.col("p") != 1) | (F.col("r") != 1) | apart, "raw_response")
    return met.select(rule.alias("rule"), F.concat_ws("|", "ID", "tool").alias("key")).where("rule is not null")


def _those(df: DataFrame, column: str, ids: DataFrame, most: int = 10_000) -> DataFrame:
    """Rows of df whose column is one of ids (one column, nulls equal); up to ``most`` are a condition, which Spark tests before it makes the other columns."""
    some = [r[0] for r in ids.distinct().limit(most + 1).collect()]
    if len(some) > most:
        ids = ids.toDF("dm_id").distinct()
        return df.join(ids, F.col(column).eqNullSafe(F.col("dm_id")), "left_semi")
    named = F.col(column).isin([v for v in some if v is not None])
    return df.where(named | F.col(column).isNull() if None in some else named)


def joined_raw(predictions: DataFrame, raw: DataFrame) -> DataFrame:
    """Predictions with the status of their raw response; both sides have the same unique (ID, tool) and inputs, or it raises."""
    contracts.enforce(untraceable(predictions, raw))
    return _with_raw(predictions, raw)


def _with_raw(predictions: DataFrame, raw: DataFrame) -> DataFrame:
    return predictions.join(raw.select(F.col("id").alias("ID"), F.col("tool").alias("CongCu"), F.col("status").alias("RawStatus")), ["ID", "CongCu"], "left")


def select(predictions: DataFrame, raw: DataFrame, n: int) -> DataFrame:
    """The first n errors by ID of every data set, tool and error class.

    The check of the raw responses reads only keys and inputs, and the ranking only keys and error
    classes; all else is made for the cases alone. The ranks are written down before records without
    error are dropped, as a condition on the class would be computed apart from the class itself.
    """
    contracts.enforce(untraceable(predictions, raw))
    rank = F.row_number().over(W.partitionBy("Dataset", "CongCu", "LoaiLoi").orderBy("ID"))
    ranked = predictions.select("ID", "CongCu", "LoaiLoi", dataset_of(F.col("ID")).alias("Dataset")).withColumn("dm_r", rank).where(F.col("dm_r") <= n)
    bad = order.cut(ranked).where("LoaiLoi <> 'none'").select("ID", "CongCu", "Dataset")
    status = raw.select(F.col("id").alias("ID"), F.col("tool").alias("CongCu"), F.col("status").alias("RawStatus"))
    whole = _those(predictions, "ID", bad.select("ID")).join(bad, ["ID", "CongCu"])
    return whole.join(_those(status, "ID", bad.select("ID")), ["ID", "CongCu"]).select(*COLUMNS).orderBy("Dataset", "CongCu", "LoaiLoi", "ID")


def proof(cases: DataFrame, predictions: DataFrame, raw: DataFrame, checked: bool = False) -> DataFrame:
    """(rule, key) of cases that are no exact projection of a prediction and its raw response.

    Only predictions and responses with the ID of a case can equal one, so the others are not made.
    ``checked``: ``select`` has checked these predictions against these responses already.
    """
    if not checked:
        contracts.enforce(untraceable(predictions, raw))
    cases = order.cut(cases.select(*COLUMNS))
    ids = cases.select("ID")
    known = _with_raw(_those(predictions, "ID", ids), _those(raw, "id", ids)).withColumn("Dataset", dataset_of(F.col("ID"))).select(*COLUMNS)
    odd = cases.exceptAll(known)
    return odd.select(F.lit("not_a_projection").alias("rule"), F.concat_ws("|", "ID", "CongCu").alias("key")).unionByName(contracts.unique(cases, "ID", "CongCu"))
