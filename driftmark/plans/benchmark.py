"""Builds the benchmark tables from sources and runs a parser over them."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.functions import text as T
from driftmark.operators import alias, audit, contracts, graph, order, parser, sampling, synth
from driftmark.plans import protocol, runs
from driftmark.sources import tables

#: Files and sizes of the benchmark tables.
FILES = {"01": "01_new_clean.csv", "02": "02_noisy.csv", "03": "03_old_clean.csv", "04": "04_missing_fields.csv", "06": "06_hybrid.csv", "07": "07_pairs.csv"}
SIDES = [f"{c}_{s}" for s in ("Cu", "Moi") for c in ("TinhThanh", "QuanHuyen", "PhuongXa")]
OBSERVED, DERIVED = "OSM_Diff", "Snapshot_Single_Target"


def _old_key() -> Column:
    return F.struct(T.province_key("TinhThanh").alias("p"), T.normalise_text("QuanHuyen").alias("d"), T.normalise_text("PhuongXa").alias("w"))


def in_file_order(df: DataFrame) -> DataFrame:
    """df with dm_i, the gapless number of each row in the order in which it was read."""
    return order.in_read_order(df, "dm_i")


def single_targets(edges: DataFrame) -> DataFrame:
    """(dm_o, unit, relation): the mapping row of each old unit with one target."""
    one = graph.classified(edges, "old_key", "new_key").where("out_degree = 1").select("old_key", "new_key", "relation")
    unit = F.struct("new_ward", "new_province", "code", "merger_form").alias("unit")
    return edges.join(one, ["old_key", "new_key"]).select(F.col("old_key").alias("dm_o"), unit, "relation").dropDuplicates(["dm_o"])


def new_addresses(latest: DataFrame, diff: DataFrame, edges: DataFrame, aliases: dict[str, DataFrame]) -> DataFrame:
    """Addresses under new units: latest rows by their new unit, else by the single target of their old one; difference rows by their resolved new ward, else district. The first row of each address stays."""
    house = lambda *c: T.address_join(T.clean_value("SoNha"), T.clean_value("TenDuong"), *c)

    def shaped(df, ward, province, order):
        return df.select(T.clean_value("SoNha").alias("SoNha"), T.clean_value("TenDuong").alias("TenDuong"), ward.alias("PhuongXa"), F.lit("").alias("QuanHuyen"), province.alias("TinhThanh"), house(ward, province).alias("ChuoiDiaChi"), F.lit(order).alias("dm_o1"), F.monotonically_increasing_id().alias("dm_o2")).where("PhuongXa <> ''")

    now = graph.resolve_target(latest, edges, "TinhThanh", "PhuongXa").join(single_targets(edges), _old_key() == F.col("dm_o"), "left")
    a = shaped(now, T.blank(F.coalesce("target.new_ward", "unit.new_ward")), T.blank(F.coalesce("target.new_province", "unit.new_province")), 1)
    moved = graph.resolve_target(alias.resolve(diff, {c: aliases[c] for c in SIDES}), edges, "TinhThanh_Moi_Chuan", "PhuongXa_Moi_Chuan", "QuanHuyen_Moi_Chuan")
    b = shaped(moved, T.blank(F.col("target.new_ward")), T.blank(F.col("target.new_province")), 0)
    return audit.first_per_key(b.unionByName(a), ["ChuoiDiaChi"], ["dm_o1", "dm_o2"]).drop("dm_o1", "dm_o2").withColumn("HeQuyChieu", F.lit("moi"))


def conversion_pairs(diff: DataFrame, full: DataFrame, balanced: DataFrame, edges: DataFrame, aliases: dict[str, DataFrame], size: int, seed: int) -> DataFrame:
    """Old and new addresses of the same object: a sample of observed ones over relations, filled with ones derived from single targets."""
    if size < 0:
        raise ValueError(f"size must not be negative, not {size}")
    order = diff.withColumn("dm_row", F.monotonically_increasing_id())
    seen = audit.audit(order, full, edges, aliases, "dm_row").where("KetQua = 'accepted_observed'")
    columns = ["ID_Node", "DiaChi_Cu", "DiaChi_Moi", "QuanHe", "HinhThucSapNhap", "MaPhuongXaMoi", "Nguon", "dm_row"]
    observed = seen.select("ID_Node", T.clean_value("DiaChi_Cu").alias("DiaChi_Cu"), F.col("DiaChi_Chuan").alias("DiaChi_Moi"), "QuanHe", F.col("edge.merger_form").alias("HinhThucSapNhap"), F.col("edge.code").alias("MaPhuongXaMoi"), F.lit(OBSERVED).alias("Nguon"), "dm_row")
    usable = balanced.where((T.clean_value("TenDuong") != "") & (T.clean_value("ChuoiDiaChi") != "")).withColumn("dm_row", F.monotonically_increasing_id())
    met = usable.join(single_targets(edges), _old_key() == F.col("dm_o"))
    made = T.address_join(T.clean_value("SoNha"), T.clean_value("TenDuong"), F.col("unit.new_ward"), F.col("unit.new_province"))
    derived = met.select(F.concat_ws(":", "OSM_Type", "OSM_ID").alias("ID_Node"), T.clean_value("ChuoiDiaChi").alias("DiaChi_Cu"), made.alias("DiaChi_Moi"), F.col("relation").alias("QuanHe"), F.col("unit.merger_form").alias("HinhThucSapNhap"), F.col("unit.code").alias("MaPhuongXaMoi"), F.lit(DERIVED).alias("Nguon"), "dm_row")
    every = synth.pairs(observed.select(columns), derived.select(columns), "ID_Node", "DiaChi_Cu", "DiaChi_Moi", "dm_row")
    some = sampling.stratified(every.where("observed"), size, ["QuanHe"], seed, "ID_Node")
    rest = sampling.uniform(every.where("not observed"), size, seed, "ID_Node")
    filled = some.unionByName(rest).orderBy(F.desc("observed"), sampling.hash_order(seed, "ID_Node"), "ID_Node").limit(size)
    return filled.select("ID_Node", "DiaChi_Cu", "DiaChi_Moi", graph.scenario(F.col("QuanHe")).alias("LoaiAnhXa"), "QuanHe", "HinhThucSapNhap", "MaPhuongXaMoi", "Nguon")


def build(mapping: DataFrame, latest: DataFrame, diff: DataFrame, full: DataFrame, balanced: DataFrame, aliases: dict[str, DataFrame], probs: dict, missing: dict, sizes: dict[str, int], seed: int = 42) -> dict[str, DataFrame]:
    """The six benchmark tables. A table that its sources cannot fill raises."""
    edges = graph.mapping_edges(mapping)
    contracts.enforce(graph.mapping_violations(edges))
    new = new_addresses(latest, diff, edges, aliases).where(contracts.filled("SoNha", "TenDuong", "PhuongXa", "TinhThanh"))
    old = audit.first_per_key(balanced.where(contracts.filled(*T.FIELDS)).withColumn("dm_row", F.concat_ws(":", "OSM_Type", "OSM_ID")), ["ChuoiDiaChi"], ["dm_row"]).drop("dm_row").withColumn("HeQuyChieu", F.lit("cu"))
    both = old.select(*T.FIELDS, "ChuoiDiaChi", "HeQuyChieu").unionByName(new.select(*T.FIELDS, "ChuoiDiaChi", "HeQuyChieu"))
    half = lambda df, n: sampling.uniform(df, n, seed, "ChuoiDiaChi")
    lost = synth.missing_sample(both, "ChuoiDiaChi", sizes["04"], 0.5, probs, missing, seed)
    out = {
        "01": half(new, sizes["01"]),
        "02": synth.noisy_sample(both, "ChuoiDiaChi", sizes["02"], 0.5, probs, missing, seed).select("ID", "ChuoiDiaChi", "ChuoiDiaChiGoc", *T.FIELDS, *[f"GT_{f}" for f in T.FIELDS], "HeQuyChieu", "MucDoNhieu", "LoaiNhieu", "SoPhepBienDoi", "Seed", "Nguon"),
        "03": half(old, sizes["03"]),
        "04": lost.select("ChuoiDiaChi", *T.FIELDS, *[f"GT_{f}" for f in T.FIELDS], "KieuThieu", "HeQuyChieu"),
        "06": synth.hybrids(old, edges, sizes["06"], seed, "ChuoiDiaChi"),
        "07": conversion_pairs(diff, full, balanced, edges, aliases, sizes["07"], seed),
    }
    targets = edges.select("code", "new_ward", "new_province")
    for n, df in out.items():
        contracts.enforce(contracts.benchmark_violations(n, df, sizes[n], targets))
    return out


def converter(edges: DataFrame):
    """predict(df, raw) for table 07: the single target of the old unit that the address ends with; empty where it has several or none."""

    def predict(df: DataFrame, raw: str) -> DataFrame:
        parts = T.address_split(F.col(raw))
        key = F.struct(T.province_key(T.part_from_end(parts, 1)).alias("p"), T.normalise_text(T.part_from_end(parts, 2)).alias("d"), T.normalise_text(T.part_from_end(parts, 3)).alias("w"))
        met = df.join(single_targets(edges), key == F.col("dm_o"), "left")
        values = {"PhuongXa": T.blank(F.col("unit.new_ward")), "TinhThanh": T.blank(F.col("unit.new_province"))}
        return met.withColumn("pred", F.struct(*[values.get(f, F.lit("")).alias(f) for f in T.FIELDS])).drop("dm_o", "unit", "relation")

    return predict


def records(number: str, df: DataFrame, raw: str = "ChuoiDiaChi") -> DataFrame:
    """ID, raw and truth of a benchmark table's rows, in file order; table 02 has its noisy and clean forms."""
    row = in_file_order(df) if "dm_i" not in df.columns else df
    side = lambda p="": F.struct(*[T.blank(f"{p}{f}").alias(f) for f in T.FIELDS])
    if number == "02":
        forms = [row.select(F.concat(F.lit("D02_"), "ID", F.lit(f"_{s}")).alias("ID"), F.col(c).alias("raw"), side("GT_").alias("truth")) for s, c in (("noisy", "ChuoiDiaChi"), ("clean", "ChuoiDiaChiGoc"))]
        return forms[0].unionByName(forms[1])
    rid = protocol.record_id(f"D{number}", F.col("dm_i"))
    if number == "07":
        parts = T.address_split("DiaChi_Moi")
        truth = F.struct(*[(T.part_from_end(parts, 2) if f == "PhuongXa" else T.part_from_end(parts, 1) if f == "TinhThanh" else F.lit("")).alias(f) for f in T.FIELDS])
        return row.select(F.concat_ws("_", rid, "QuanHe").alias("ID"), F.col("DiaChi_Cu").alias("raw"), truth.alias("truth"))
    return row.select(rid.alias("ID"), F.col(raw).alias("raw"), side().alias("truth"))


STRATA = {"02": ["HeQuyChieu", "MucDoNhieu"], "04": ["HeQuyChieu", "KieuThieu"], "06": ["KieuLai"], "07": ["QuanHe"]}


def pilot(number: str, df: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows over the table's strata, in file order."""
    row = in_file_order(df)
    strata = STRATA.get(number)
    some = sampling.stratified(row, n, strata, seed, "dm_i", at_least_strata=True) if strata else sampling.uniform(row, n, seed, "dm_i")
    return some.orderBy("dm_i")


def run(spark: SparkSession, data: Path, root: Path, name: str, edges: DataFrame | None = None, sample: int | None = None, overwrite: bool = False, tool: str = "heuristic_parser", expected: dict[str, int] | None = None) -> runs.Run:
    """Score the tables of a folder: predictions, raw responses, and a manifest written last. Tables that break their contract (with ``expected`` also their sizes) raise first."""
    at = runs.Run(Path(root), name)
    at.prepare(overwrite)
    found = {n: Path(data) / f for n, f in FILES.items() if (Path(data) / f).exists()}
    frames = {n: tables.read_csv(spark, str(p)) for n, p in found.items()}
    targets = edges.select("code", "new_ward", "new_province") if edges is not None else None
    for n, df in frames.items():
        contracts.check_file(found[n], df.columns)
        contracts.enforce(contracts.benchmark_violations(n, df, (expected or {}).get(n), targets))
    manifest = runs.freeze({n: p for n, p in found.items()}, {n: f.columns for n, f in frames.items()}, {n: f.count() for n, f in frames.items()}, root)
    scored = []
    for n, df in frames.items():
        if sample:
            df = pilot(n, df, sample, 42)
        if n == "07" and edges is None:
            continue
        predict = converter(edges) if n == "07" else parser.heuristic
        scored.append(protocol.evaluate(records(n, df), f"D{n}", "raw", "native_converter" if n == "07" else tool, predict, with_status=True))
    every = reduce(DataFrame.unionByName, scored).orderBy("ID", "CongCu")
    predictions = every.drop("TrangThai")
    tables.write_csv(predictions, at.predictions, overwrite)
    calls = every.select(F.col("ID").alias("id"), F.col("CongCu").alias("tool"), F.col("DiaChiGoc").alias("input"), F.col("TruongDuDoan").alias("prediction"), F.col("DungSai").alias("dung_sai"), F.col("LoaiLoi").alias("loai_loi"), F.col("TrangThai").alias("status"))
    tables.write_json_lines(calls, at.raw_responses, overwrite)
    runs.finish(manifest, {"predictions": at.predictions, "raw_responses": at.raw_responses}, {"predictions": predictions.count()}, at.manifest)
    return at
