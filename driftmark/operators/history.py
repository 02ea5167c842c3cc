"""Snapshots and differences of versioned entities at a cutoff."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftmark.functions import text as T

#: Fixed value: the last instant before the reform.
CUTOFF = "TIMESTAMP '2025-06-30 23:59:59'"
#: Street names that stand for none.
PLACEHOLDERS = ("không tên", "unnamed", "đang cập nhật")


def before_after(history: DataFrame, keys: list[str], order: str, ts: str, state: Column, cutoff: Column) -> DataFrame:
    """keys, old, new: the last state at or before the cutoff and the last one after it, by order.

    A last state that is null stays null: an entity that was deleted has no state.
    """
    last = lambda when: F.max_by(F.struct(F.when(when, state).alias("s")), F.when(when, F.col(order)))["s"]
    return history.groupBy(*keys).agg(last(F.col(ts) <= cutoff).alias("old"), last(F.col(ts) > cutoff).alias("new"))


def changed(pairs: DataFrame, fields: list[str]) -> DataFrame:
    """Pairs with both states that differ in any of the fields (null counts as empty)."""
    differ = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"old.{f}").cast("string"), F.lit("")) != F.coalesce(F.col(f"new.{f}").cast("string"), F.lit("")) for f in fields])
    return pairs.where(F.col("old").isNotNull() & F.col("new").isNotNull() & differ)


def address_state(tags: Column, fingerprint: Column, visible: Column) -> Column:
    """The address in a map of tags, or null: a street that is no placeholder, an administrative part, no rejected tag."""
    tag = lambda k: T.clean_tag(tags[k])
    first = lambda a, b: F.when(tag(a) != "", tag(a)).otherwise(tag(b))
    street, house, district = tag("addr:street"), tag("addr:housenumber"), tag("addr:district")
    ward, city = first("addr:ward", "addr:subdistrict"), first("addr:city", "addr:province")
    rejected = reduce(lambda a, b: a | b, [(T.blank(tags[k]) != "") & (tag(k) == "") for k in ("addr:housenumber", "addr:ward", "addr:subdistrict", "addr:district", "addr:city", "addr:province")])
    valid = visible & (street != "") & ~F.lower(street).isin(*PLACEHOLDERS) & (F.concat(ward, district, city) != "") & ~rejected
    whole = T.address_join(house, street, ward, district, city)
    return F.when(valid, F.struct(house.alias("house"), street.alias("street"), ward.alias("ward"), district.alias("district"), city.alias("city"), whole.alias("full_address"), fingerprint.alias("geometry")))


def address_pairs(history: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    """osm_type, osm_id, old, new address states of a history table. Invalid rows are dropped before anything is hashed."""
    finger = F.when(F.col("osm_type") == "node", T.point_fingerprint(F.col("lat"), F.col("lon"))).when(F.col("osm_type") == "way", T.way_fingerprint(F.col("refs"))).otherwise("")
    return before_after(history, ["osm_type", "osm_id"], "version", "ts", address_state(F.col("tags"), finger, F.col("visible")), F.expr(cutoff))


def snapshot(pairs: DataFrame, regions: dict[str, list[str]], other: str = "Khac") -> DataFrame:
    """Ten columns of every entity with an old state."""
    o = pairs.where("old is not null")
    return o.select(F.col("osm_type").alias("OSM_Type"), F.col("osm_id").cast("string").alias("OSM_ID"), *[F.col(f"old.{a}").alias(b) for a, b in zip(("house", "street", "ward", "district", "city"), T.FIELDS, strict=True)], F.col("old.full_address").alias("ChuoiDiaChi"), F.col("old.geometry").alias("HinhHoc"), T.region_of(F.concat_ws(" ", "old.city", "old.full_address"), regions, other).alias("VungMien"))


def difference(pairs: DataFrame, regions: dict[str, list[str]], source: str, other: str = "Khac") -> DataFrame:
    """Eighteen columns of every entity whose ward, district or city changed; house and street take the new value, else the old."""
    d = changed(pairs, ["ward", "district", "city"])
    either = lambda f: F.when(F.col(f"new.{f}") != "", F.col(f"new.{f}")).otherwise(F.col(f"old.{f}"))
    known = (F.col("old.geometry") != "") & (F.col("new.geometry") != "")
    side = lambda s, t: [F.col(f"{s}.{a}").alias(f"{b}_{t}") for a, b in zip(("ward", "district", "city", "full_address"), (*T.FIELDS[2:], "DiaChi"), strict=True)]
    word = lambda c: F.when(c, "True").otherwise("False")
    return d.select(F.col("osm_type").alias("OSM_Type"), F.col("osm_id").cast("string").alias("OSM_ID"), either("house").alias("SoNha"), either("street").alias("TenDuong"), *side("old", "Cu"), *side("new", "Moi"), F.col("old.geometry").alias("HinhHoc_Cu"), F.col("new.geometry").alias("HinhHoc_Moi"), word(known).alias("HinhHocCoDuLieu"), word(known & (F.col("old.geometry") != F.col("new.geometry"))).alias("HinhHocThayDoi"), T.region_of(F.concat_ws(" ", either("city"), F.lit("")), regions, other).alias("VungMien"), F.lit(source).alias("Nguon"))


def capped(df: DataFrame, group: str, key: Column, seed: int, cap: int | None = None, least: int = 100) -> DataFrame:
    """At most ``cap`` rows of each group, by hash order; without a cap the smallest group's size, ``least`` at least."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))), key))
    if cap is not None:
        return df.withColumn("dm_r", rank).where(F.col("dm_r") <= cap).drop("dm_r")
    size = df.groupBy(group).count().agg(F.greatest(F.min("count"), F.lit(least)).alias("dm_cap"))
    return df.withColumn("dm_r", rank).join(F.broadcast(size)).where("dm_r <= dm_cap").drop("dm_r", "dm_cap")
