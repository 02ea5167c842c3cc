"""Address parsers: a rule parser as expressions, and what is made of the labels and traces of external ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.functions import text as T

# Abbreviations and slashed or alley numbers that the rule parser is known to misread.
ABBREVIATED = r"(?iuU)\b(?:[PQ]|TP|TX|TT)\.?\s*\d+"
ABBREVIATED_NAME = r"(?U)\b(?:P\.|Q\.|TP\.|TX\.|TT\.)\s*[A-ZÀ-ỹ]"
SLASHED = r"(?U)^\s*\d+[\w]*[/-]\d+"
ALLEY = r"(?iuU)\b(?:ngõ|ngách|hẻm)\b"


def heuristic(df: DataFrame, raw: str) -> DataFrame:
    """df with ``pred`` (the five fields) by the number of parts between commas, semicolons and line breaks."""
    text = F.regexp_replace(T.blank(raw), r"(?U)^\s+|\s+$", "")
    at = lambda k: T.part_from_end(F.col("dm_p"), k)
    first = lambda k: F.coalesce(F.get("dm_p", F.lit(k)), F.lit(""))
    n = F.size("dm_p")
    out = df.withColumn("dm_t", text).withColumn("dm_p", T.address_split(F.col("dm_t"), r"[,;\n]+"))
    road = F.when(n >= 5, first(1)).when(n >= 2, first(0)).otherwise("")
    house = F.when((n >= 5) & first(0).rlike(r"(?U)^\d+[\w/\-]*$"), first(0)).otherwise("")
    lead = r"(?U)^(\d+[\w/\-]*)\s+(.+)$"
    out = out.withColumns({"dm_road": road, "dm_house": house, "dm_ward": F.when(n >= 5, at(4)).when(n == 4, at(3)).when(n == 3, first(1)).otherwise(""), "dm_cd": F.when(n >= 5, at(3)).otherwise(""), "dm_city": F.when(n >= 4, at(2)).otherwise("")})
    split = (F.col("dm_house") == "") & F.col("dm_road").rlike(lead)
    out = out.withColumns({"dm_house": F.when(split, F.regexp_extract("dm_road", lead, 1)).otherwise(F.col("dm_house")), "dm_road": F.when(split, F.trim(F.regexp_extract("dm_road", lead, 2))).otherwise(F.col("dm_road"))})
    short = F.col("dm_t").rlike(ABBREVIATED) | F.col("dm_t").rlike(ABBREVIATED_NAME)
    hard = F.col("dm_t").rlike(SLASHED) | F.col("dm_t").rlike(ALLEY)
    ward = F.when(short & (F.col("dm_ward").contains("P.") | F.col("dm_road").contains("P.")), "").otherwise(F.col("dm_ward"))
    cd = F.when(short & (F.col("dm_cd").contains("Q.") | F.col("dm_city").contains("Q.")), "").otherwise(F.col("dm_cd"))
    district = F.when(cd != "", cd).otherwise(F.col("dm_city"))
    values = (F.when(hard, "").otherwise(F.col("dm_house")), F.col("dm_road"), ward, district, F.when(n >= 1, at(1)).otherwise(""))
    return out.withColumn("pred", F.struct(*[v.alias(f) for v, f in zip(values, T.FIELDS, strict=True)])).drop("dm_t", "dm_p", "dm_road", "dm_house", "dm_ward", "dm_cd", "dm_city")


def project_labels(labels: Column) -> Column:
    """The five fields of a parser's array of (value, label); repeated labels are joined by spaces."""
    tag = lambda name: F.array_join(F.transform(F.filter(labels, lambda x: x["label"] == name), lambda x: x["value"]), " ")
    first = lambda *c: F.coalesce(*[F.when(x != "", x) for x in c], F.lit(""))
    state, district = tag("state"), first(tag("state_district"), tag("city_district"))
    return F.struct(tag("house_number").alias("SoNha"), tag("road").alias("TenDuong"), first(tag("suburb"), tag("neighbourhood")).alias("PhuongXa"), F.when((state != "") & (district == ""), tag("city")).otherwise(district).alias("QuanHuyen"), first(state, tag("city")).alias("TinhThanh"))


def with_retries(call: Callable[[], object], attempts: int = 2) -> tuple[object, dict]:
    """call(), tried again on errors: (result or None, trace with status, attempts and error types)."""
    errors: list[str] = []
    for i in range(attempts):
        try:
            return call(), {"status": "success", "attempts": i + 1, "error_types": errors}
        except Exception as error:  # noqa: BLE001  any failure of the service counts
            errors.append(type(error).__name__)
    return None, {"status": "unavailable_after_retries", "attempts": attempts, "error_types": errors}


def selection_path(trace: Column) -> Column:
    """How a converter came to its ward, from its trace: key_match, fallback, geocoder or none."""
    return F.when(F.coalesce(trace["selected_ward"], F.lit("")) == "", "none").when(F.coalesce(trace["fallback_used"], F.lit(False)), "fallback").when(trace["geocoder_attempted"] & (trace["geocoder_status"] == "success"), "geocoder").otherwise("key_match")
