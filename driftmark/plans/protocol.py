"""Which data set is scored how."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.functions import text as T
from driftmark.operators import parser, scoring

#: Fields scored, scenario and modes of each data set.
PROTOCOL = {
    "D01": {"fields": T.FIELDS, "scenario": "NONE", "modes": ("FROM_2025",)},
    "D02": {"fields": T.FIELDS, "scenario": "NONE", "modes": ("by_system",)},
    "D03": {"fields": T.FIELDS, "scenario": "NONE", "modes": ("LEGACY",)},
    "D04": {"fields": T.FIELDS, "scenario": "NONE", "modes": ("by_system",)},
    "D06": {"fields": T.FIELDS, "scenario": "C", "modes": ("FROM_2025", "LEGACY")},
    "D07": {"fields": ("PhuongXa", "TinhThanh"), "scenario": "A", "modes": ("CONVERT",)},
}


def mode_of(system: Column) -> Column:
    return F.when(system == "moi", "FROM_2025").otherwise("LEGACY")


def record_id(dataset: str, row: Column, suffix: str = "") -> Column:
    """D01_0001 and so on."""
    return F.concat(F.format_string(f"{dataset}_%04d", row), F.lit(suffix))


def evaluate(df: DataFrame, dataset: str, raw: str, tool: str, predict=parser.heuristic, with_status: bool = False) -> DataFrame:
    """Predictions and their scores in the record layout; df has ID, the raw text and truth (struct of the fields).

    ``with_status`` adds TrangThai, the status of the tool's call: the column call_status of what
    ``predict`` returns, success where a tool has none, as expressions do not fail.
    """
    p = PROTOCOL[dataset]
    made = predict(df, raw).withColumn("scenario", F.lit(p["scenario"]))
    out = scoring.score(made, "pred", "truth", "scenario", raw, p["fields"])
    called = F.col("call_status") if "call_status" in made.columns else F.lit("success")
    more = [called.alias("TrangThai")] if with_status else []
    return out.select("ID", F.col(raw).alias("DiaChiGoc"), F.lit(tool).alias("CongCu"), F.to_json("pred").alias("TruongDuDoan"), F.to_json("truth").alias("TruongDung"), F.col("status").alias("DungSai"), F.col("error").alias("LoaiLoi"), F.col("scenario").alias("TinhHuongMoHo"), F.col("note").alias("GhiChu"), *more)
