"""Rates of surface markers in texts: weak labels over one denominator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MARK = r"(?iuU)(?<!\w){0}(?:\.|\s+)(?=\s*[\wÀ-ỹ])"

#: Markers of address parts.
PATTERNS = {
    "ward_P": _MARK.format("P"),
    "ward_F": _MARK.format("F"),
    "district_Q": _MARK.format("Q"),
    "district_H": _MARK.format("H"),
    "district_TX": _MARK.format("TX"),
    "district_TP": _MARK.format("TP"),
    "city_TPHCM": r"(?iuU)(?<!\w)(?:TP\s*\.?\s*HCM|TPHCM)(?!\w)",
    "city_TP": _MARK.format("TP"),
    "ward_full": r"(?iuU)\b(?:phường|xã|thị trấn)\b",
    "district_full": r"(?iuU)\b(?:quận|huyện|thị xã)\b",
    "housenumber": r"(?iuU)^\s*(?:số\s*)?\d+[A-Za-z]?(?:[/-]\d+[A-Za-z]?)*\b",
}
#: A part counts as missing if none of its markers occurs.
MISSING = {
    "drop_ward": ("ward_P", "ward_F", "ward_full"),
    "drop_district": ("district_Q", "district_H", "district_TX", "district_TP", "district_full"),
    "drop_housenumber": ("housenumber",),
    "drop_housenumber_ward": ("housenumber", "ward_P", "ward_F", "ward_full"),
}


def profile(df: DataFrame, column: str, patterns: dict[str, str] | None = None, missing: dict[str, tuple[str, ...]] | None = None, places: int = 6) -> DataFrame:
    """(kind, name, n, total, rate): marker counts and none-of-these counts over the non-blank texts. No rows without texts."""
    patterns, missing = patterns or PATTERNS, missing if missing is not None else MISSING
    rows = df.select(F.trim(column).alias("t")).where("t <> ''")
    flags = rows.select(*[F.col("t").rlike(p).alias(n) for n, p in patterns.items()])
    none = lambda names: ~reduce(lambda a, b: a | b, [F.col(n) for n in names])
    aggs: list[tuple[str, str, Column]] = [("marker", n, F.count_if(n)) for n in patterns] + [("missing", n, F.count_if(none(own))) for n, own in missing.items()]
    counted = flags.agg(F.count("*").alias("total"), *[a.alias(f"{k}_{n}") for k, n, a in aggs])
    long = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name"), F.col(f"{k}_{n}").alias("n")) for k, n, _ in aggs]))
    out = counted.where("total > 0").select(long.alias("r"), "total").select("r.kind", "r.name", "r.n", "total")
    # Half to even, as the generators' configuration rounds.
    return out.withColumn("rate", F.bround(F.col("n") / F.col("total"), places))


def as_config(rows: list, method: str) -> dict:
    """The collected profile as the nested configuration that the generators read, with a line on how it was measured. Raises without texts."""
    if not rows:
        raise ValueError("no texts to profile")
    tables = {"abbreviations": "marker", "missing_rates": "missing"}
    of = lambda kind, value: {r["name"]: r[value] for r in rows if r["kind"] == kind}
    rates = {name: of(kind, "rate") for name, kind in tables.items()}
    for whole in ("ward_full", "district_full", "housenumber"):  # no abbreviations
        rates["abbreviations"].pop(whole, None)
    return {"sample_size": rows[0]["total"], "method": method, "noise_probabilities": rates, "counts": {name: of(kind, "n") for name, kind in tables.items()}}
