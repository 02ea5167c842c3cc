"""One reason for every difference record: the first rule of a waterfall that applies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftmark.functions import text as T
from driftmark.operators import alias, graph

#: What each reason says.
DETAILS = {
    "accepted_observed": "matched official edge and passed all evidence checks",
    "not_in_old_snapshot": "the old snapshot has no row for this OSM object",
    "house_or_street_changed": "administrative and physical/address text changes cannot be separated",
    "missing_street": "the pair builder requires a street to create a reliable address",
    "missing_new_ward": "new address lacks ward information in OSM tags",
    "new_unit_not_found": "new ward/district field does not match a known unit in the official CSV",
    "missing_old_ward": "old snapshot lacks ward name to verify territorial edge",
    "missing_old_district": "old snapshot lacks district name to resolve ambiguity",
    "possible_geometry_move": "the OSM object geometry changed alongside an unverified administrative edge; review the move before treating the CSV as incomplete",
    "stationary_unverified_edge": "geometry did not change, but the old-to-new edge is absent; review OSM tags and the administrative CSV",
    "unverified_historical_edge": "the old-to-new edge is absent and this legacy diff has no geometry evidence; re-extract OSM to distinguish a move from a mapping/source issue",
    "missing_old_address": "the source did not provide a usable old address string",
    "no_address_change": "old and new canonical address strings are identical",
    "duplicate_observed_pair": "the same text pair or OSM object was already accepted",
}


def geometry_status(available: Column | str, changed: Column | str) -> Column:
    """changed, unchanged, or not_captured (also when the evidence cannot be read)."""
    a, c = T.lenient_bool(available), T.lenient_bool(changed)
    return F.when(~F.coalesce(a, F.lit(False)) | c.isNull(), "not_captured").when(c, "changed").otherwise("unchanged")


def waterfall(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first rule that holds."""
    out = F.when(F.coalesce(rules[0][1], F.lit(False)), rules[0][0])
    for name, rule in rules[1:]:
        out = out.when(F.coalesce(rule, F.lit(False)), name)
    return out.otherwise(otherwise)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, in the given order (which tells all rows of a key apart); a partial aggregate, so a key of many rows is no burden."""
    others = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("dm_first"))
    return first.select([F.col(c) if c in keys else F.col(f"dm_first.`{c}`") for c in df.columns])


def same_place(a: str, b: str) -> Column:
    return F.lower(T.clean_value(a)) == F.lower(T.clean_value(b))


def audit(diff: DataFrame, snapshot: DataFrame, edges: DataFrame, aliases: dict[str, DataFrame], order: str) -> DataFrame:
    """diff with KetQua (reason), ChiTiet (what it says), QuanHe, the resolved columns, the alias trace and the geometry status.

    ``aliases``: table of each of the six administrative columns. Objects are unique in diff, so the
    first accepted record of each address pair is a window, and every later one a duplicate.
    """
    sides = [f"{c}_{s}" for s in ("Cu", "Moi") for c in ("TinhThanh", "QuanHuyen", "PhuongXa")]
    old = snapshot.select(F.col("OSM_Type").alias("dm_t"), F.col("OSM_ID").alias("dm_i"), F.col("SoNha").alias("dm_house"), F.col("TenDuong").alias("dm_street"))
    met = diff.join(old, (F.col("OSM_Type") == F.col("dm_t")) & (F.col("OSM_ID") == F.col("dm_i")), "left")
    met = alias.resolve(met, {c: aliases[c] for c in sides})
    met = graph.resolve_target(met, edges, "TinhThanh_Moi_Chuan", "PhuongXa_Moi_Chuan", "QuanHuyen_Moi_Chuan")
    met = graph.edge_of(met, edges, "TinhThanh_Cu_Chuan", "QuanHuyen_Cu_Chuan", "PhuongXa_Cu_Chuan")
    empty = lambda c: T.clean_value(c) == ""
    met = met.withColumns(
        {
            "dm_geo": geometry_status("HinhHocCoDuLieu", "HinhHocThayDoi"),
            "dm_old": T.clean_value("DiaChi_Cu"),
            "DiaChi_Chuan": T.address_join(T.clean_value("SoNha"), T.clean_value("TenDuong"), T.blank(F.col("edge.new_ward")), T.blank(F.col("edge.new_province"))),
        }
    )
    no_edge = F.col("edge").isNull()
    rules = [
        ("not_in_old_snapshot", F.col("dm_t").isNull()),
        ("house_or_street_changed", ~(same_place("SoNha", "dm_house") & same_place("TenDuong", "dm_street"))),
        ("missing_street", empty("TenDuong")),
        ("missing_new_ward", F.col("target").isNull() & empty("PhuongXa_Moi_Chuan") & empty("QuanHuyen_Moi_Chuan")),
        ("new_unit_not_found", F.col("target").isNull()),
        ("missing_old_ward", no_edge & empty("PhuongXa_Cu_Chuan")),
        ("missing_old_district", no_edge & empty("QuanHuyen_Cu_Chuan")),
        ("possible_geometry_move", no_edge & (F.col("dm_geo") == "changed")),
        ("stationary_unverified_edge", no_edge & (F.col("dm_geo") == "unchanged")),
        ("unverified_historical_edge", no_edge),
        ("missing_old_address", F.col("dm_old") == ""),
        ("no_address_change", F.col("dm_old") == F.col("DiaChi_Chuan")),
    ]
    met = met.withColumn("KetQua", waterfall(rules, "accepted_observed"))
    again = F.row_number().over(W.partitionBy("KetQua", "dm_old", "DiaChi_Chuan").orderBy(order))
    met = met.withColumn("KetQua", F.when((F.col("KetQua") == "accepted_observed") & (again > 1), "duplicate_observed_pair").otherwise(F.col("KetQua")))
    said = F.create_map(*[F.lit(x) for kv in DETAILS.items() for x in kv])
    changes = alias.trace(sides)
    out = met.withColumns(
        {
            "ID_Node": F.concat_ws(":", "OSM_Type", "OSM_ID"),
            "ChiTiet": said[F.col("KetQua")],
            "AliasDaApDung": F.array_join(changes, " | "),
            "SoAliasDaApDung": F.size(changes).cast("string"),
            "TrangThaiHinhHoc": F.col("dm_geo"),
            "QuanHe": F.when(F.col("KetQua").isin("accepted_observed", "duplicate_observed_pair"), F.col("edge.relation")).otherwise(""),
        }
    )
    return out.drop("dm_t", "dm_i", "dm_house", "dm_street", "dm_geo", "dm_old")
