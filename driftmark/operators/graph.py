"""A bipartite graph of old and new units: degrees, relations, look-ups and conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.functions import text as T
from driftmark.operators import order

#: The columns of the mapping table (old ward, district, province; new province, ward, type, code, form, area).
COLUMNS = ("Phường/Xã cũ", "Quận/Huyện cũ", "Tỉnh/TP cũ (trước sáp nhập)", "Tỉnh/TP mới", "Phường/Xã mới (từ 1/7/2025)", "Loại đơn vị mới", "Mã phường/xã mới", "Hình thức sáp nhập", "Diện tích mới (km²)")
NAMES = ("old_ward", "old_district", "old_province", "new_province", "new_ward", "unit_type", "code", "merger_form", "area")


def mapping_edges(mapping: DataFrame) -> DataFrame:
    """The mapping table with plain names, cleaned values, keys of both ends and the order of rows (ord).

    Exact repeats are dropped, the first stays. The table is written down once, as look-ups use it several times.
    """
    rows = mapping.select([F.col(f"`{c}`").alias(n) for c, n in zip(COLUMNS, NAMES, strict=True)] + [F.monotonically_increasing_id().alias("ord") if "ord" not in mapping.columns else F.col("ord")])
    once = rows.groupBy(*NAMES).agg(F.min("ord").alias("ord"))
    clean = once.select(*[T.clean_value(n).alias(n) for n in NAMES], "ord")
    return order.cut(clean.withColumns({"old_key": F.struct(T.province_key("old_province").alias("p"), T.normalise_text("old_district").alias("d"), T.normalise_text("old_ward").alias("w")), "new_key": F.struct(T.province_key("new_province").alias("p"), T.normalise_text("new_ward").alias("w"))}))


def relation(out_degree: Column, in_degree: Column) -> Column:
    """1-1, 1-N, N-1 or M-N; degree 0 counts as M-N."""
    return F.when((out_degree == 1) & (in_degree == 1), "1-1").when((out_degree > 1) & (in_degree == 1), "1-N").when((out_degree == 1) & (in_degree > 1), "N-1").otherwise("M-N")


def scenario(rel: Column) -> Column:
    """The letter of a relation: C, A, B, M."""
    return F.when(rel == "1-1", "C").when(rel == "1-N", "A").when(rel == "N-1", "B").otherwise("M")


#: A unit with more than one in so many of all edges is a hub; there are at most so many hubs on a side.
HUB_SHARE = 1000


def attached(df: DataFrame, key: str, stats: DataFrame, weight: str, total: int, share: int = HUB_SHARE) -> DataFrame:
    """df with the other columns of stats, one row for each key (never null), by the key; weight of stats: the rows of df with it.

    At most ``share`` keys have more than one in ``share`` of the total rows: their statistics are
    broadcast, so that a hub's rows stay where they are. No other key is large enough to burden a task.
    """
    hub = F.col(weight) * share > F.lit(total)
    others = [c for c in stats.columns if c != key]
    few = stats.where(hub).select(F.col(key).alias("dm_hub"), F.struct(*others).alias("dm_known"))
    met = df.join(F.broadcast(few), F.col(key) == F.col("dm_hub"), "left").drop("dm_hub")
    held = met.where("dm_known is not null").select(*df.columns, *[F.col(f"dm_known.{c}").alias(c) for c in others])
    rest = met.where("dm_known is null").select(df.columns).join(stats.where(~hub), key).select(*df.columns, *others)
    return held.unionByName(rest)


def _degrees(once: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """(old, out_degree) and (new, in_degree) of distinct pairs."""
    return once.groupBy(old).agg(F.count("*").alias("out_degree")), once.groupBy(new).agg(F.count("*").alias("in_degree"))


def _with_degrees(once: DataFrame, old: str, new: str) -> DataFrame:
    """once (distinct pairs, written down) with both degrees, which are partial aggregates joined back, and their relation."""
    total = once.count()
    out, into = _degrees(once, old, new)
    both = attached(attached(once, old, out, "out_degree", total), new, into, "in_degree", total)
    return both.withColumn("relation", relation(F.col("out_degree"), F.col("in_degree")))


def classified(edges: DataFrame, old: str, new: str) -> DataFrame:
    """Distinct (old, new) pairs with both degrees and their relation."""
    return _with_degrees(order.cut(edges.select(old, new).distinct()), old, new)


def summary(edges: DataFrame, old: str, new: str) -> DataFrame:
    """One row: edge rows, old units, new units, and edges of each relation. One scan.

    Units are the rows of the degrees: counted as distinct values, each edge would stand in three rows at once.
    """
    once = order.cut(edges.groupBy(old, new).agg(F.count("*").alias("dm_rows")))
    n = lambda r: F.count_if(F.col("relation") == r)
    rows = F.coalesce(F.sum("dm_rows"), F.lit(0)).alias("atomic_edges")
    kinds = _with_degrees(once, old, new).agg(rows, n("1-1").alias("one_to_one_edges"), n("1-N").alias("one_to_many_edges"), n("N-1").alias("many_to_one_edges"), n("M-N").alias("many_to_many_edges"))
    out, into = _degrees(once, old, new)
    units = out.agg(F.count(old).alias("old_units")).crossJoin(into.agg(F.count(new).alias("new_units")))
    return kinds.crossJoin(units).select("atomic_edges", "old_units", "new_units", "one_to_one_edges", "one_to_many_edges", "many_to_one_edges", "many_to_many_edges")


def targets_for_old(edges: DataFrame, old: str, new: str) -> DataFrame:
    """(old, targets): the sorted distinct new units of each old one."""
    return edges.select(old, new).distinct().groupBy(old).agg(F.sort_array(F.collect_list(new)).alias("targets"))


def origins_for_new(edges: DataFrame, old: str, new: str) -> DataFrame:
    """(new, origins): the sorted distinct old units of each new one."""
    return edges.select(new, old).distinct().groupBy(new).agg(F.sort_array(F.collect_list(old)).alias("origins"))


def unique_targets(edges: DataFrame, old: str, new: str) -> DataFrame:
    """(old, new) of old units with a single target."""
    return classified(edges, old, new).where("out_degree = 1").select(old, new)


def convert(records: DataFrame, edges: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """records with their new unit; null where the old unit is unknown or has several targets."""
    return records.join(unique_targets(edges, old, new).withColumnRenamed(old, "dm_old"), F.col(key) == F.col("dm_old"), "left").drop("dm_old")


def abstained(records: DataFrame, edges: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """records whose old unit has several targets."""
    several = classified(edges, old, new).where("out_degree > 1").select(F.col(old).alias("dm_old")).distinct()
    return records.join(several, F.col(key) == F.col("dm_old"), "left_semi")


def new_units(edges: DataFrame) -> DataFrame:
    """The first row of each new unit."""
    columns = ("new_province", "new_ward", "unit_type", "code", "merger_form", "area")
    return edges.groupBy("new_key").agg(F.min_by(F.struct(*columns), "ord").alias("u")).select("new_key", *[f"u.{c}" for c in columns])


def province_names(edges: DataFrame) -> DataFrame:
    """(key, name): new provinces by their own keys, else by the old provinces that they took in; the last row wins."""
    own = edges.groupBy(T.province_key("new_province").alias("key")).agg(F.max_by("new_province", "ord").alias("name"))
    old = edges.groupBy(T.province_key("old_province").alias("key")).agg(F.max_by("new_province", "ord").alias("name"))
    return own.unionByName(old.join(own.select("key"), "key", "left_anti"))


def resolve_target(records: DataFrame, edges: DataFrame, province: str, *wards: str) -> DataFrame:
    """records with ``target`` (a new unit, or null): the first of the ward columns that names one in the resolved province.

    The joins carry no hints: names and units are tables that Spark broadcasts while they are small.
    """
    names, units = province_names(edges), new_units(edges)
    at = records.join(names.withColumnRenamed("key", "dm_pk"), T.province_key(province) == F.col("dm_pk"), "left")
    found = []
    for i, w in enumerate(wards):
        unit = units.select(F.struct(*[c for c in units.columns]).alias(f"dm_u{i}"), F.col("new_key").alias(f"dm_k{i}"))
        key = F.struct(T.province_key("name").alias("p"), T.normalise_text(w).alias("w"))
        at = at.join(unit, F.col("name").isNotNull() & (key == F.col(f"dm_k{i}")), "left").drop(f"dm_k{i}")
        found.append(f"dm_u{i}")
    return at.withColumn("target", F.coalesce(*found)).drop("dm_pk", "name", *found)


def edge_of(records: DataFrame, edges: DataFrame, province: str, district: str, ward: str) -> DataFrame:
    """records with ``edge``: the mapping row from the old unit to ``target`` by names, with its relation, or null. The last row of an edge counts."""
    last = edges.groupBy("old_key", "new_key").agg(F.max_by(F.struct("new_province", "new_ward", "code", "merger_form"), "ord").alias("dm_e"))
    rel = _with_degrees(order.cut(last), "old_key", "new_key")
    side = rel.select(F.col("old_key").alias("dm_o"), F.col("new_key").alias("dm_n"), F.struct("dm_e.new_province", "dm_e.new_ward", "dm_e.code", "dm_e.merger_form", "relation").alias("edge"))
    old = F.struct(T.province_key(province).alias("p"), T.normalise_text(district).alias("d"), T.normalise_text(ward).alias("w"))
    return records.join(side, (old == F.col("dm_o")) & (F.col("target.new_key") == F.col("dm_n")), "left").drop("dm_o", "dm_n")


def mapping_violations(edges: DataFrame) -> DataFrame:
    """(rule, key) of broken rules: a unit without identity, a code of two units, an old province of two new ones."""
    blank = edges.where((F.col("old_district") == "") | (F.col("old_province") == "") | (F.col("new_province") == "") | (F.col("new_ward") == "")).select(F.lit("missing_identity").alias("rule"), F.concat_ws("|", "old_province", "old_district", "old_ward").alias("key"))
    codes = edges.where("code <> ''").groupBy("code").agg(F.count_distinct("new_province").alias("p"), F.count_distinct("new_ward").alias("w")).where("p > 1 or w > 1").select(F.lit("code_conflict").alias("rule"), F.col("code").alias("key"))
    provinces = edges.groupBy(F.col("old_key.p").alias("key")).agg(F.count_distinct("new_province").alias("n")).where("n > 1").select(F.lit("province_conflict").alias("rule"), "key")
    return blank.unionByName(codes).unionByName(provinces)
