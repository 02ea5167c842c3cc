"""Operators on small address tables."""

import math
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from driftmark.functions import lexicon
from driftmark.functions import text as T
from driftmark.operators import alias, audit, cases, contracts, coverage, explore, graph, history, parser, profile, receipts, sampling, scoring, synth
from driftmark.plans import protocol, report, runs
from driftmark.sources import tables
from driftmark.streaming import history as stream


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


def mapping(spark, rows):
    """rows: old ward, old district, old province, new province, new ward."""
    full = [(w, d, p, np, nw, "Phường", "", "Sáp nhập", "1", i) for i, (w, d, p, np, nw) in enumerate(rows)]
    return graph.mapping_edges(spark.createDataFrame(full, [*graph.COLUMNS, "ord"]))


@pytest.fixture(scope="module")
def edges(spark):
    old = lambda x: (f"Xã {x}", "Huyện H", "Tỉnh P")
    new = lambda x: ("Tỉnh Q", f"Phường {x}")
    return mapping(spark, [(*old("Chia"), *new("C1")), (*old("Chia"), *new("C2")), (*old("B1"), *new("B")), (*old("B2"), *new("B")), (*old("M1"), *new("MA")), (*old("M1"), *new("MB")), (*old("M2"), *new("MA")), (*old("M2"), *new("MB")), (*old("Riêng"), *new("R"))]).cache()


def test_text(spark):
    lit = F.lit
    assert one(spark, T.clean_value(lit("  a b ,, "))) == "a b"
    assert one(spark, T.clean_value(lit(None).cast("string"))) == ""
    assert one(spark, T.normalise_text(lit("  PHƯỜNG \t 1 ,"))) == "phường 1"
    assert one(spark, T.province_key(lit("Thành phố  Huế"))) == "huế"
    assert one(spark, T.province_key(lit("TP.HCM"))) == "tp.hcm"
    assert one(spark, T.comparable(lit("Phường 2"))) == one(spark, T.comparable(lit("P. 2"))) == "2"
    assert one(spark, T.strip_accents(lit("Đường Lê Lợi đỗ"))) == "Duong Le Loi do"
    assert one(spark, T.fuzzy_key(lit("12/3 Lê-Lợi,  Q.1"))) == "12 3 le loi q 1"
    assert one(spark, T.house_key(lit("12 3 le loi"))) == "12"
    assert one(spark, T.house_key(lit("le loi"))) is None
    assert one(spark, T.address_join(lit("1"), lit(""), lit(None), lit("b"))) == "1, b"
    df = spark.createDataFrame([("12/5A, Lê Lợi",), ("Lê Lợi",)], "v string")
    assert [tuple(r) for r in df.select(*T.split_house("v")).collect()] == [("12/5A", "Lê Lợi"), ("", "Lê Lợi")]
    decomposed = spark.createDataFrame([("é",), ("é",), (None,)], "v string")
    assert [r["v"] for r in decomposed.select(T.composed("v").alias("v")).orderBy("v").collect()] == ["", "é", "é"]


def test_tags(spark):
    assert one(spark, T.clean_tag(F.lit("Đường Số 10, "))) == "Đường Số 10"
    for bad in ("شارع", "улица", "a,,b", "a;b", ""):
        assert one(spark, T.clean_tag(F.lit(bad))) == ""


def test_receipts_are_cleaned(spark):
    dirty = "VM+ HNI 12 Lê Lợi\n12 Phố Huế\n 12 Phố Huế \nĐT: 024.7106.6866 - 49301"
    got = one(spark, T.clean_receipt(F.lit(dirty)))
    assert got == "HNI 12 Lê Lợi, 12 Phố Huế, ĐT: - 49301"
    ok = lambda t: one(spark, T.valid_text(F.lit(t), ["phố", "đường"]))
    assert ok("12 Phố Huế, Hà Nội") and not ok("12 Phố") and not ok("12 Phố Huế, Hà...") and not ok("no keyword in here")


def test_lexicon(spark):
    df = spark.createDataFrame([("Thành phố Hà Nội",), ("5 Phố Đà Nẵng, TP.HCM",), ("Nowhere",), (None,)], "v string")
    assert [r[0] for r in df.select(T.region_of(T.blank("v"), lexicon.REGIONS, lexicon.OTHER_REGION)).collect()] == ["Bac", "Trung", "Khac", "Khac"]
    rows = spark.createDataFrame([("12 Phố Huế, Hà Nội",), ("nothing to see here",), ("CS1: 12 Phố Huế, Hà Nội",)], "v string")
    assert [r[0] for r in rows.select(T.valid_text(F.col("v"), lexicon.ADDRESS_WORDS)).collect()] == [True, False, False]


def test_relations(spark, edges):
    got = {(r["old_key"]["w"], r["new_key"]["w"]): r["relation"] for r in graph.classified(edges, "old_key", "new_key").collect()}
    assert got["xã chia", "phường c1"] == "1-N" and got["xã b1", "phường b"] == "N-1" and got["xã riêng", "phường r"] == "1-1"
    assert got["xã m1", "phường mb"] == "M-N" and len(got) == 9
    s = graph.summary(edges, "old_key", "new_key").first()
    assert (s["atomic_edges"], s["one_to_one_edges"], s["one_to_many_edges"], s["many_to_one_edges"], s["many_to_many_edges"]) == (9, 1, 2, 2, 4)


def test_targets_and_edges(spark, edges):
    rows = spark.createDataFrame([(1, "Tỉnh P", "Phường B", "", "Huyện H", "Xã B1"), (2, "Q", "x", "phường  r", "Huyện H", "Xã B1"), (3, "Nowhere", "Phường B", "", "", "")], "i int, np string, nw string, nd string, od string, ow string").withColumn("op", F.lit("P"))
    met = graph.edge_of(graph.resolve_target(rows, edges, "np", "nw", "nd"), edges, "op", "od", "ow")
    got = {r["i"]: (r["target"] and r["target"]["new_ward"], r["edge"] and r["edge"]["relation"]) for r in met.collect()}
    assert got == {1: ("Phường B", "N-1"), 2: ("Phường R", None), 3: (None, None)}


def test_mapping_violations(spark):
    bad = mapping(spark, [("a", "d", "P", "N1", "x"), ("b", "d", "P", "N2", "y"), ("", "d", "O", "N1", "z"), ("c", "", "O", "N1", "z")])
    assert {r["rule"] for r in graph.mapping_violations(bad).collect()} == {"province_conflict", "missing_identity"}
    with_codes = bad.withColumn("code", F.lit("7"))
    assert "code_conflict" in {r["rule"] for r in graph.mapping_violations(with_codes).collect()}


def test_alias_trace(spark):
    names = spark.createDataFrame([("Thành phố Hà Nội",), ("Phường Hàng Buồm",), ("Phường Hàng Bồ",)], "name string")
    table = alias.alias_table(names)
    got = {r["alias"]: r["name"] for r in table.collect()}
    assert got["hanoi"] == got["ha noi"] == got["hà nội"] == "Thành phố Hà Nội" and got["hang buom"] == "Phường Hàng Buồm"
    out = alias.resolve(spark.createDataFrame([("Hanoi ", "Hang Buom", "x")], "p string, w string, z string"), {"p": table, "w": table, "z": table})
    row = out.withColumn("t", alias.trace(["p", "w", "z"])).first()
    assert row["t"] == ["p: Hanoi → Thành phố Hà Nội", "w: Hang Buom → Phường Hàng Buồm"] and row["z_Chuan"] == "x"


HISTORY = "osm_type string, osm_id long, version int, ts timestamp, visible boolean, tags map<string,string>, lat double, lon double, refs array<long>"


@pytest.fixture(scope="module")
def revisions(spark):
    from datetime import datetime

    before, after = datetime(2025, 6, 30, 23, 59, 59), datetime(2025, 7, 2)
    tags = lambda w: {"addr:street": "Lê Lợi", "addr:housenumber": "1", "addr:ward": w, "addr:city": "Hà Nội"}
    rows = [("node", 1, 1, before, True, tags("A"), 1.0, 2.0, None), ("node", 1, 2, after, True, tags("B"), 1.0, 2.5, None), ("node", 2, 1, before, True, tags("A"), 1.0, 2.0, None), ("node", 2, 2, after, True, {}, 1.0, 2.0, None), ("way", 3, 1, before, True, tags("A"), None, None, [5, 6]), ("way", 3, 2, after, False, tags("B"), None, None, [5, 6]), ("node", 4, 1, before, True, {"addr:street": "unnamed", "addr:city": "x"}, 1.0, 1.0, None), ("node", 5, 1, before, True, {**tags("A"), "addr:district": "район"}, 1.0, 1.0, None)]
    return spark.createDataFrame(rows, HISTORY)


def test_history(spark, revisions):
    pairs = history.address_pairs(revisions)
    regions = {"Bac": ["hà nội"], "Nam": ["sài gòn"]}
    snap = history.snapshot(pairs, regions).collect()
    assert {r["OSM_ID"] for r in snap} == {"1", "2", "3"} and {r["VungMien"] for r in snap} == {"Bac"}
    import hashlib

    assert {r["HinhHoc"] for r in snap} == {"node:1.0000000,2.0000000", "way:" + hashlib.sha256(b"5,6").hexdigest()}
    diff = history.difference(pairs, regions, "OSM_Diff").collect()
    assert [(r["OSM_ID"], r["PhuongXa_Cu"], r["PhuongXa_Moi"], r["HinhHocThayDoi"]) for r in diff] == [("1", "A", "B", "True")]


def test_streamed_history_equals_batch(spark, revisions, tmp_path):
    folder, table, checkpoint, keys = str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "cp"), ["osm_type", "osm_id"]
    state, cutoff = history.address_state(F.col("tags"), F.lit(""), F.col("visible")), F.expr(history.CUTOFF)

    def run():
        live = spark.readStream.schema(HISTORY).option("maxFilesPerTrigger", 1).parquet(folder)
        query = stream.keep(live, table, checkpoint, keys, "version", "ts", state, cutoff)
        query.awaitTermination()
        return sorted(map(str, stream.current(spark, table, keys).collect()))

    want = lambda df: sorted(map(str, history.before_after(df, keys, "version", "ts", state, cutoff).collect()))
    for v in (2, 1, 1):  # the later revisions come first, the earlier ones twice
        revisions.where(F.col("version") == v).coalesce(1).write.mode("append").parquet(folder)
    seen = revisions.where("version < 3")
    assert run() == want(seen)
    revisions.where("version > 2").union(revisions.withColumn("osm_id", F.col("osm_id") + 1000)).coalesce(1).write.mode("append").parquet(folder)
    assert run() == want(revisions.union(revisions.withColumn("osm_id", F.col("osm_id") + 1000)))  # started again, it goes on


def test_profile(spark):
    df = spark.createDataFrame([("12 Lê Lợi, P. 1, Q. 1, TP.HCM",), ("Đường A, Phường 2, Hà Nội",), (" ",), (None,), ("ườP. 1",)], "t string")
    got = {r["name"]: (r["n"], r["total"]) for r in profile.profile(df, "t").collect()}
    assert got["ward_P"] == (1, 3) and got["district_Q"] == (1, 3) and got["ward_full"] == (1, 3) and got["drop_ward"] == (1, 3) and got["city_TPHCM"] == (1, 3)
    config = profile.as_config(profile.profile(df, "t").collect(), "marker rates")
    assert config["sample_size"] == 3 and config["noise_probabilities"]["abbreviations"]["ward_P"] == 0.333333
    with pytest.raises(ValueError):
        profile.as_config(profile.profile(df.where("false"), "t").collect(), "marker rates")


def test_audit(spark, edges):
    cols = "OSM_Type string, OSM_ID string, SoNha string, TenDuong string, TinhThanh_Cu string, QuanHuyen_Cu string, PhuongXa_Cu string, DiaChi_Cu string, TinhThanh_Moi string, QuanHuyen_Moi string, PhuongXa_Moi string, HinhHocCoDuLieu string, HinhHocThayDoi string, n int"
    base = ("node", "1", "1", "Lê Lợi", "Tỉnh P", "Huyện H", "Xã B1", "1, Lê Lợi, Xã B1, Huyện H, Tỉnh P", "Tỉnh Q", "", "Phường B", "True", "False")
    alter = lambda i, **kw: tuple({**dict(zip([c.split()[0] for c in cols.split(", ")], base)), "OSM_ID": str(i), **kw}.values()) + (i,)
    rows = [alter(1), alter(2), alter(9, DiaChi_Cu="x"), alter(3, SoNha="2"), alter(4, TenDuong=""), alter(5, PhuongXa_Moi=""), alter(6, PhuongXa_Moi="Phường ?"), alter(7, PhuongXa_Cu=""), alter(8, PhuongXa_Cu="Xã M1", QuanHuyen_Cu=""), alter(10, PhuongXa_Cu="Xã M1"), alter(11, PhuongXa_Cu="Xã M1", HinhHocThayDoi="True"), alter(12, PhuongXa_Cu="Xã M1", HinhHocCoDuLieu=""), alter(13, DiaChi_Cu=""), alter(14, DiaChi_Cu="1, Lê Lợi, Phường B, Tỉnh Q"), alter(15, PhuongXa_Moi="", QuanHuyen_Moi="Phường B", DiaChi_Cu="y")]
    diff = spark.createDataFrame(rows, cols)
    snapshot = spark.createDataFrame([("node", str(i), "1", "" if i == 4 else "LÊ LỢI") for i in range(1, 16) if i != 9], "OSM_Type string, OSM_ID string, SoNha string, TenDuong string")
    none = spark.createDataFrame([], "alias string, name string")
    sides = [f"{c}_{s}" for s in ("Cu", "Moi") for c in ("TinhThanh", "QuanHuyen", "PhuongXa")]
    got = {r["n"]: (r["KetQua"], r["QuanHe"]) for r in audit.audit(diff, snapshot, edges, dict.fromkeys(sides, none), "n").collect()}
    want = {1: "accepted_observed", 2: "duplicate_observed_pair", 9: "not_in_old_snapshot", 3: "house_or_street_changed", 4: "missing_street", 5: "missing_new_ward", 6: "new_unit_not_found", 7: "missing_old_ward", 8: "missing_old_district", 10: "stationary_unverified_edge", 11: "possible_geometry_move", 12: "unverified_historical_edge", 13: "missing_old_address", 14: "no_address_change", 15: "accepted_observed"}
    assert {k: v[0] for k, v in got.items()} == want
    assert got[1][1] == got[2][1] == "N-1" and got[3][1] == ""


def test_geometry_status(spark):
    df = spark.createDataFrame([("", ""), ("False", "False"), ("True", "False"), ("True", "True"), ("yes", "?")], "a string, b string")
    assert [r[0] for r in df.select(audit.geometry_status("a", "b")).collect()] == ["not_captured", "not_captured", "unchanged", "changed", "not_captured"]


def fields(**kw):
    return Row(*T.FIELDS)(*[kw.get(f, "") for f in T.FIELDS])


def scored(spark, rows, names=T.FIELDS):
    kind = "struct<" + ",".join(f"{f}:string" for f in T.FIELDS) + ">"
    df = spark.createDataFrame([(i, p, t, s, r) for i, (p, t, s, r) in enumerate(rows)], f"i int, pred {kind}, truth {kind}, scenario string, raw string")
    return scoring.score(df, fields=names).orderBy("i")


def test_scoring(spark):
    truth = fields(SoNha="1", TenDuong="Lê Lợi", PhuongXa="Phường 1", TinhThanh="TP. Huế")
    rows = [
        (fields(SoNha="1", TenDuong="lê  lợi", PhuongXa="P. 1", TinhThanh="Thành phố Huế"), truth, "NONE", ""),
        (fields(SoNha="1", TenDuong="Lê Lợi", PhuongXa="1", QuanHuyen="Q", TinhThanh="Huế"), truth, "NONE", ""),
        (fields(SoNha="1", TenDuong="Lê Lợi", PhuongXa="Phường 2", TinhThanh="Huế"), truth, "A", ""),
        (fields(SoNha="1", TenDuong="Lê Lợi", PhuongXa="Phường 2", TinhThanh="Huế"), truth, "NONE", ""),
        (fields(SoNha="9"), truth, "NONE", "P. 1"),
        (fields(SoNha="9"), truth, "NONE", ""),
        (fields(), fields(), "NONE", ""),
        (fields(SoNha="1"), fields(), "NONE", ""),
    ]
    got = [(r["status"], r["error"], r["field_code"]) for r in scored(spark, rows).collect()]
    assert got == [
        ("CORRECT", "none", "mmmtm"),
        ("PARTIAL", "hallucination_over_imputation", "mmmxm"),
        ("PARTIAL", "wrong_target", "mmxtm"),
        ("PARTIAL", "missing_field", "mmxtm"),
        ("ERROR", "abbreviation_misunderstood", "xooto"),
        ("ERROR", "parse_boundary_error", "xooto"),
        ("CORRECT", "none", "ttttt"),
        ("ERROR", "hallucination_over_imputation", "xtttt"),
    ]
    part = scored(spark, rows[:5], ("PhuongXa", "TinhThanh")).collect()
    assert [r["status"] for r in part] == ["CORRECT", "CORRECT", "ERROR", "ERROR", "ERROR"] and part[0]["field_code"] == "nnmnm"


def test_metrics(spark):
    t = fields(SoNha="1", TenDuong="a", PhuongXa="b", TinhThanh="c")
    s = scored(spark, [(t, t, "NONE", ""), (fields(SoNha="1", TenDuong="x", PhuongXa=""), t, "NONE", "")]).withColumn("tool", F.lit("t"))
    out = scoring.long_outcomes(s, ["tool"])
    assert scoring.micro_f1(out, ["tool"]).first()["micro_f1"] == pytest.approx(2 * 5 / (2 * 5 + 1 + 3))
    assert scoring.macro_f1(out, ["tool"]).first()["macro_f1"] == pytest.approx((1 + 0.5 + 2 / 3 + 0 + 2 / 3) / 5)
    r = scoring.status_rates(s, ["tool"]).first()
    assert r["correct_rate"] == 0.5 and r["total"] == 2
    empty = scoring.long_outcomes(scored(spark, [(fields(), fields(), "NONE", "")]).withColumn("tool", F.lit("t")), ["tool"])
    assert scoring.micro_f1(empty, ["tool"]).first()["micro_f1"] is None and scoring.micro_f1(empty, ["tool"], 0.0).first()["micro_f1"] == 0


@pytest.mark.parametrize(("both", "a", "b", "neither", "stat", "p"), [(2, 0, 971, 27, 969.0, 9.83e-213), (1, 0, 1093, 406, 1091.0, 2.98e-239), (0, 0, 0, 5, 0.0, 1.0)])
def test_mcnemar(spark, both, a, b, neither, stat, p):
    df = spark.createDataFrame([(True, True)] * both + [(True, False)] * a + [(False, True)] * b + [(False, False)] * neither, "a boolean, b boolean")
    r = scoring.with_p_value(scoring.mcnemar(df, "a", "b")).first()
    assert r["statistic"] == pytest.approx(stat, rel=1e-3) and r["p_value"] == pytest.approx(p, rel=0.05)


def test_intervals(spark):
    low, high = (one(spark, c) for c in scoring.wald_interval(F.lit(0.973), F.lit(1000.0)))
    assert (round(low, 3), round(high, 3)) == (0.963, 0.983)
    low, high = (one(spark, c) for c in scoring.wilson_interval(F.lit(0.0), F.lit(10.0)))
    assert low == pytest.approx(0, abs=1e-9) and math.isclose(high, 0.2775, abs_tol=1e-3)


def test_coverage(spark):
    df = spark.createDataFrame([("node:1", "OSM_Diff", "N-1", "x, Hà Nội"), ("way:2", "Derived", "M-N", "y, Sài Gòn")], "ID_Node string, Nguon string, QuanHe string, DiaChi_Moi string")
    axes = {"geometry": (T.kind_before_colon("ID_Node"), ["node", "way", "unknown"]), "relation": (F.col("QuanHe"), ["1-1", "1-N", "N-1", "M-N"])}
    got = {(r["axis"], r["category"]): r["n"] for r in coverage.axis_counts(df, axes).collect()}
    assert got["relation", "1-N"] == 0 and got["relation", "N-1"] == 1 and got["geometry", "unknown"] == 0 and len(got) == 7
    direct = F.col("Nguon").contains("OSM_Diff")
    found = {(r["rule"], r["subject"]) for r in coverage.warnings(df, direct, "QuanHe", ["1-1", "1-N", "N-1", "M-N"]).collect()}
    assert found == {("no_direct_sample", "1-1"), ("no_direct_sample", "1-N"), ("no_direct_sample", "M-N"), ("derived_rows", "")}
    assert {(r["rule"], r["subject"]) for r in coverage.warnings(df.limit(0), direct, "QuanHe", ["1-1"]).collect()} == {("empty", ""), ("no_direct_sample", "1-1")}


def records(spark, n=40):
    rows = [(i, str(i + 1), f"Đường Số {i}", f"Phường {i % 7}", "" if i % 2 else f"Quận {i % 5}", "Thành phố Hồ Chí Minh" if i % 3 else "Tỉnh Bình Dương", "moi" if i % 2 else "cu") for i in range(n)]
    return spark.createDataFrame(rows, "i int, SoNha string, TenDuong string, PhuongXa string, QuanHuyen string, TinhThanh string, HeQuyChieu string")


def test_noisy(spark):
    rates = {"drop_housenumber": 0.5, "drop_ward": 0.4}
    out = synth.noisy_sample(records(spark), "i", 20, 0.5, {}, rates)
    got = out.collect()
    assert len(got) == 20 and sum(r["HeQuyChieu"] == "cu" for r in got) == 10
    assert len({r["ChuoiDiaChi"] for r in got}) == 20 and {r["ID"] for r in got} == {f"N{i:05d}" for i in range(1, 21)}
    assert all(r["ChuoiDiaChi"] != r["ChuoiDiaChiGoc"] and "dinh_dang_phan_cach" in r["LoaiNhieu"] for r in got)
    assert all(r["GT_SoNha"] and r["GT_TenDuong"] for r in got)
    again = synth.noisy_sample(records(spark).repartition(5), "i", 20, 0.5, {}, rates).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_missing_fields(spark):
    got = synth.missing_fields(records(spark, 200), "i", {}).collect()
    assert {r["KieuThieu"] for r in got} == set(synth.MISSING)
    for r in got:
        lost = synth.MISSING[r["KieuThieu"]]
        assert not (r["HeQuyChieu"] == "moi" and r["KieuThieu"] == "drop_district")
        assert all((r[f] == "") == (f in lost or r[f"GT_{f}"] == "") for f in T.FIELDS)
    assert contracts.row_rules(spark.createDataFrame(got), F.col("i"), contracts.benchmark_rules("04")).count() == 0


def test_abbreviations(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("k"))
    ward = {r[0] for r in df.select(synth.abbreviate(F.lit("Phường 5"), "ward", {}, 1, F.col("k"))).collect()}
    assert ward == {"P. 5", "P.5", "P 5", "F. 5", "F.5", "F 5", "5", "Phường 5"}
    city = {r[0] for r in df.select(synth.abbreviate(F.lit("Tỉnh Long An"), "city", {}, 1, F.col("k"))).collect()}
    assert city == {"Long An", "T. Long An", "T.Long An", "T Long An", "Tỉnh Long An"}
    typo = {r[0] for r in df.select(synth.confuse(F.lit("sol"), 1, F.col("k"))).collect()}
    assert typo == {"5ol", "s0l", "so1"} and one(spark, synth.confuse(F.lit("xyz"), 1, F.lit("k"))) == "xyz"


def test_hybrids(spark, edges):
    old = spark.createDataFrame([(i, str(i), "Lê Lợi", f"Xã {w}", "Huyện H", "Tỉnh P") for i, w in enumerate(["B1", "B2", "Riêng", "Chia", "M1", "?"] * 4)], "i int, SoNha string, TenDuong string, PhuongXa string, QuanHuyen string, TinhThanh string")
    made = synth.hybrid_candidates(old, edges).collect()
    assert {r["KieuLai"] for r in made} == {"C1", "C2", "C3"} and {r["QuanHe"] for r in made} == {"N-1", "1-1"}
    c3 = next(r for r in made if r["KieuLai"] == "C3")
    assert c3["PhuongXa"].startswith("Xã") and c3["TinhThanh"] == "Tỉnh Q" and c3["Span_He_Detail"] == '{"PhuongXa":"cu","QuanHuyen":"cu","TinhThanh":"moi"}'
    got = synth.hybrids(old, edges, 10, 1, "i").collect()
    assert [sum(r["KieuLai"] == k for r in got) for k in ("C1", "C2", "C3")] == [7, 2, 1]
    pool = spark.createDataFrame([("C2", "same", 1), ("C3", "same", 2), ("C3", "other", 3)], "k string, s string, i int")
    assert {r["s"] for r in sampling.quota_chain(pool, "k", {"C2": 1, "C3": 1}, "s", 1, "i").collect()} == {"same", "other"}
    with pytest.raises(sampling.QuotaError):
        sampling.require_size(pool, 4)


def test_pairs_equal_the_greedy_rule(spark):
    rng = random.Random(3)
    draw = lambda start: [(start + i, f"o{rng.randrange(6)}", f"n{rng.randrange(6)}", i) for i in range(80)]
    observed, derived = draw(0), draw(50)
    seen_pairs, seen_nodes, want = set(), set(), []
    for flag, rows in ((True, observed), (False, derived)):
        for node, old, new, _ in rows:
            if old != new and (old, new) not in seen_pairs and node not in seen_nodes:
                seen_pairs.add((old, new))
                seen_nodes.add(node)
                want.append((node, old, new, flag))
    frame = lambda rows: spark.createDataFrame(rows, "node int, old string, new string, o int")
    got = synth.pairs(frame(observed), frame(derived), "node", "old", "new", "o")
    assert sorted((r["node"], r["old"], r["new"], r["observed"]) for r in got.collect()) == sorted(want)


def test_samples(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 7)
    a = sampling.uniform(df, 50, 1, "id").collect()
    assert a == sampling.uniform(df.repartition(9), 50, 1, "id").collect() and len({r["id"] for r in a}) == 50
    assert {r["g"] for r in sampling.stratified(df, 9, ["g"], 1, "id").collect()} == set(range(7))
    assert sampling.stratified(df, 3, ["g"], 1, "id", at_least_strata=True).count() == 7
    cap = history.capped(df.where("id < 300 or g = 0"), "g", F.col("id"), 1, least=10).groupBy("g").count()
    assert cap.agg(F.max("count")).first()[0] == 42
    assert {r["count"] for r in history.capped(df, "g", F.col("id"), 1, cap=5).groupBy("g").count().collect()} == {5}


def test_fuzzy_dedup(spark):
    rng = random.Random(8)
    base = [f"{rng.randint(1, 3)} Phố {''.join(rng.choice('abcdeê') for _ in range(12))}" for _ in range(12)]
    rows = []
    for b in base * 6:
        w = list(b)
        w[rng.randrange(5, len(w))] = rng.choice("xyz")
        rows.append("".join(w))
    rows += ["no number here", "no number herе", None, rows[0]]
    key = lambda t: one_key[t]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    one_key = {r["t"]: (r["k"], r["h"]) for r in df.where("t is not null").select("t", T.fuzzy_key("t").alias("k"), T.house_key(T.fuzzy_key("t")).alias("h")).collect()}
    clusters = []
    for t in dict.fromkeys(x for x in rows if x):
        for c in clusters:
            if key(t)[1] == key(c[0])[1] and SequenceMatcher(None, key(t)[0], key(c[0])[0]).ratio() >= 0.82:
                c.append(t)
                break
        else:
            clusters.append([t])
    want = sorted(x for c in clusters for x in sorted(set(c), key=lambda v: (-len(v), v))[:2])
    assert sorted(r["t"] for r in receipts.fuzzy_dedup(df, "t", "i").collect()) == want


def test_heuristic_parser(spark):
    rows = ["12, Đường Lê Lợi, Phường Bến Nghé, Quận 1, Thành phố Hồ Chí Minh", "12 Lê Lợi, Hà Nội", "", " ; ", "12/3 Lê Lợi, P. 1, Huế", "5 A, P. Bến, Q. 1, TP. X", "a\nb\nc\nd"]
    df = parser.heuristic(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r string"), "r").orderBy("i")
    got = [tuple(r["pred"]) for r in df.collect()]
    assert got[0] == ("12", "Đường Lê Lợi", "Đường Lê Lợi", "Phường Bến Nghé", "Thành phố Hồ Chí Minh")
    assert got[1] == ("12", "Lê Lợi", "", "", "Hà Nội") and got[2] == got[3] == ("",) * 5
    assert got[4] == ("", "Lê Lợi", "", "", "Huế")
    assert got[5] == ("5", "A", "", "Q. 1", "TP. X") and got[6] == ("", "a", "b", "c", "d")


def test_labels_of_external_parsers(spark):
    kind = "array<struct<value:string,label:string>>"
    df = spark.createDataFrame([(1, [("12", "house_number"), ("a", "road"), ("b", "road"), ("Huế", "city")]), (2, [("Huế", "city")])], f"k int, labels {kind}")
    got = df.select("k", parser.project_labels(F.col("labels")).alias("p")).orderBy("k").collect()
    assert tuple(got[0]["p"]) == ("12", "a b", "", "", "Huế") and tuple(got[1]["p"]) == ("", "", "", "", "Huế")

    def fail():
        raise TimeoutError

    assert parser.with_retries(fail) == (None, {"status": "unavailable_after_retries", "attempts": 2, "error_types": ["TimeoutError"] * 2})


def test_contracts(spark):
    df = spark.createDataFrame([(1, "moi", "", "1", "a", "b", "c"), (2, "cu", "d", "1", "a", "", "c"), (2, "moi", "", "1", "a", "b", "c")], "i int, HeQuyChieu string, QuanHuyen string, SoNha string, TenDuong string, PhuongXa string, TinhThanh string")
    got = sorted((r["rule"], r["key"]) for r in contracts.row_rules(df, F.col("i"), contracts.benchmark_rules("01")).collect())
    assert got == [("complete", "2"), ("district_empty", "2"), ("system", "2")]
    assert [tuple(r) for r in contracts.unique(df, "i").collect()] == [("unique", "2")]
    assert contracts.domain(df, "HeQuyChieu", ["moi", "cu"], complete=True).count() == 0
    assert {r["key"] for r in contracts.domain(df, "HeQuyChieu", ["moi", "Lai"], complete=True).collect()} == {"cu", "Lai"}
    assert contracts.row_count(df, 3).count() == 0 and contracts.row_count(df, 4).first()["key"] == "3"
    with pytest.raises(contracts.ContractError, match="unique: 2"):
        contracts.enforce(contracts.unique(df, "i"))
    with pytest.raises(contracts.ContractError):
        contracts.require_columns(df, ["nope"])
    pairs = spark.createDataFrame([("1-1", "1, a, w, d, p", "1, a, x, q"), ("1-1", "1, a, w, d, p", "2, a, x, q")], "QuanHe string, DiaChi_Cu string, DiaChi_Moi string").withColumn("i", F.monotonically_increasing_id())
    assert [r["rule"] for r in contracts.row_rules(pairs, F.col("i"), contracts.benchmark_rules("07")).collect()] == ["same_place"]


def predictions(spark):
    rows = [("D01_0001", "raw", "t", "{}", "{}", "ERROR", "missing_field", "NONE", ""), ("D01_0002", "raw", "t", "{}", "{}", "ERROR", "missing_field", "NONE", ""), ("D02_0001", "raw", "t", "{}", "{}", "CORRECT", "none", "NONE", "")]
    p = spark.createDataFrame(rows, "ID string, DiaChiGoc string, CongCu string, TruongDuDoan string, TruongDung string, DungSai string, LoaiLoi string, TinhHuongMoHo string, GhiChu string")
    return p, p.select(F.col("ID").alias("id"), F.col("CongCu").alias("tool"), F.col("DiaChiGoc").alias("input"), F.lit("success").alias("status"))


def test_cases(spark):
    p, raw = predictions(spark)
    picked = cases.select(p, raw, 1)
    assert [r["ID"] for r in picked.collect()] == ["D01_0001"]
    assert cases.proof(picked, p, raw).count() == 0
    assert cases.proof(picked.withColumn("DiaChiGoc", F.lit("edited")), p, raw).first()["rule"] == "not_a_projection"
    for bad in (raw.withColumn("input", F.lit("other")), raw.limit(1), raw.union(raw)):
        with pytest.raises(contracts.ContractError):
            cases.select(p, bad, 1)


def test_explorer(spark):
    p, _ = predictions(spark)
    got = explore.tool_pairs(p, "t", "u").collect()
    assert {(r["first"], r["second"], r["comparison"]) for r in got} == {("ERROR", "NONE", "neither"), ("CORRECT", "NONE", "first_only")}
    assert explore.search(p, "d02", ["ID"]).count() == 1 and explore.search(p, "", ["ID"]).count() == 3
    df = spark.range(60)
    assert [r["id"] for r in explore.page(df, ["id"], 3, 25).collect()] == list(range(50, 60))
    with pytest.raises(ValueError):
        explore.page(df, ["id"], 1, 7)


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("Phường 1", 'a "b", c', None), ("x\ny", "", "z")], "p string, q string, r string")
    path = tmp_path / "t.csv"
    tables.write_csv(df, path)
    assert tables.has_bom(path)
    back = tables.read_csv(spark, str(path), ["p", "q", "r"], ordered=True)
    assert sorted(map(tuple, back.collect())) == sorted([("Phường 1", 'a "b", c', ""), ("x\ny", "", "z")])
    with pytest.raises(FileExistsError):
        tables.write_csv(df, path)
    with pytest.raises(contracts.ContractError):
        tables.read_csv(spark, str(path), ["missing"])
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": {"b": 2}}\n')
    assert tables.read_jsonl(spark, str(tmp_path / "l.jsonl")).count() == 2
    lit = spark.createDataFrame([("{'Địa chỉ': '1 Phố', 'x': None}",), ("oops(",), ("{'y': 1}",), (None,)], "extractions string")
    lit.write.parquet(str(tmp_path / "r"))
    assert [r["text"] for r in tables.read_receipts(spark, str(tmp_path / "r")).collect()] == ["1 Phố"]
    spark.createDataFrame([({"Địa chỉ": "2 Phố"},)], "extractions map<string,string>").write.parquet(str(tmp_path / "m"))
    assert [r["text"] for r in tables.read_addresses(spark, str(tmp_path / "m"), "").collect()] == ["2 Phố"]
    assert tables.read_addresses(spark, None, str(path)).count() == 2
    tables.write_json({"x": "é"}, tmp_path / "c.json")
    assert tables.read_json(tmp_path / "c.json") == {"x": "é"}


def test_runs(tmp_path):
    run = runs.Run(tmp_path, "baseline_v2")
    run.prepare()
    run.predictions.write_text("a")
    with pytest.raises(FileExistsError):
        run.prepare()
    for bad in ("Bad", "1abc", "ab", "a-b-c"):
        with pytest.raises(ValueError):
            runs.Run(tmp_path, bad)
    frozen = runs.freeze({"in": run.predictions}, {"in": ["x"]}, {"in": 1}, tmp_path)
    done = runs.finish(frozen, {"out": run.predictions}, {"out": 1}, run.manifest)
    assert runs.verify(done, {"in": run.predictions, "out": run.predictions}) == []
    run.predictions.write_text("b")
    assert runs.verify(done, {"in": run.predictions, "gone": tmp_path / "gone"}) == ["gone", "in"]
    assert runs.lineage(run, {"p": run.predictions})["run_id"] == "baseline_v2"


def test_report_and_protocol(spark):
    assert report.percent(None) == "n/a" and report.percent(0.1234) == "12.3%"
    df = spark.createDataFrame([("a|b", 1)], "x string, n int")
    assert report.markdown(df) == "| x | n |\n| --- | --- |\n| a\\|b | 1 |\n"
    assert report.document("T", {"S": df, "N": "text"}).startswith("# T\n\n## S\n\n| x")
    truth = spark.createDataFrame([("D07_0001", "5 Lê Lợi, Phường 1, Huế", fields(PhuongXa="1", TinhThanh="Huế"))], "ID string, r string, truth struct<" + ",".join(f"{f}:string" for f in T.FIELDS) + ">")
    row = protocol.evaluate(truth, "D07", "r", "heuristic").first()
    assert row["DungSai"] == "CORRECT" and row["LoaiLoi"] == "none" and row["TinhHuongMoHo"] == "A"
    assert one(spark, protocol.record_id("D01", F.lit(7), "_m25")) == "D01_0007_m25"
