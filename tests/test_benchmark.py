"""The benchmark from sources to materials, on a small town."""

import pytest
from pyspark.sql import functions as F

from driftmark.__main__ import main
from driftmark.functions import text as T
from driftmark.operators import contracts, graph, synth
from driftmark.plans import benchmark, dashboard, documents, runs
from driftmark.sources import tables

SIZES = {"01": 20, "02": 20, "03": 20, "04": 20, "06": 20, "07": 20}


@pytest.fixture(scope="module")
def town(spark):
    wards = [(f"Xã {i}", f"Huyện {i % 3}", "Tỉnh Cũ", "Tỉnh Mới", f"Phường {i // 2}") for i in range(12)] + [("Xã 0", "Huyện 0", "Tỉnh Cũ", "Tỉnh Mới", "Phường 9")]
    mapping = spark.createDataFrame([(w, d, p, np, nw, "Phường", "", "Sáp nhập", "1") for w, d, p, np, nw in wards], list(graph.COLUMNS))
    old = [("node", str(i), str(i + 1), f"Đường {i % 11}", wards[i % 12][0], wards[i % 12][1], "Tỉnh Cũ") for i in range(120)]
    kind = "OSM_Type string, OSM_ID string, SoNha string, TenDuong string, PhuongXa string, QuanHuyen string, TinhThanh string"
    snapshot = spark.createDataFrame(old, kind).withColumn("ChuoiDiaChi", T.address_join(*T.FIELDS))
    diff = snapshot.where("cast(OSM_ID as int) < 30").select("OSM_Type", "OSM_ID", "SoNha", "TenDuong", F.col("PhuongXa").alias("PhuongXa_Cu"), F.col("QuanHuyen").alias("QuanHuyen_Cu"), F.col("TinhThanh").alias("TinhThanh_Cu"), F.col("ChuoiDiaChi").alias("DiaChi_Cu"), F.concat(F.lit("Phường "), F.floor(F.regexp_extract("PhuongXa", r"\d+", 0).cast("int") / 2).cast("string")).alias("PhuongXa_Moi"), F.lit("").alias("QuanHuyen_Moi"), F.lit("Tỉnh Mới").alias("TinhThanh_Moi"), F.lit("").alias("HinhHocCoDuLieu"), F.lit("").alias("HinhHocThayDoi"))
    latest = snapshot.select(*T.FIELDS)
    none = spark.createDataFrame([], "alias string, name string")
    return mapping, latest, diff, snapshot, dict.fromkeys(benchmark.SIDES, none)


def test_build_run_and_report(spark, town, tmp_path):
    mapping, latest, diff, snapshot, aliases = town
    made = benchmark.build(mapping, latest, diff, snapshot, snapshot, aliases, {}, {"drop_housenumber": 0.5, "drop_ward": 0.4}, SIZES)
    data = tmp_path / "data"
    for n, df in made.items():
        tables.write_csv(df, data / benchmark.FILES[n])
        back = tables.read_csv(spark, str(data / benchmark.FILES[n]))
        assert back.count() == SIZES[n]
        rules = contracts.benchmark_rules(n)
        assert contracts.row_rules(back, F.col(back.columns[0]), rules).collect() == [], n
    pairs = tables.read_csv(spark, str(data / benchmark.FILES["07"]))
    edges = graph.mapping_edges(mapping)
    assert pairs.where(F.col("Nguon") == benchmark.OBSERVED).count() > 0
    target = edges.select(F.col("new_ward").alias("w")).distinct()
    assert contracts.reference(pairs.select(T.part_from_end(T.address_split("DiaChi_Moi"), 2).alias("w")), target, ["w"]).count() == 0
    tables.write_csv(mapping, tmp_path / "mapping.csv")

    main(["run", "--run-id", "first_run", "--root", str(tmp_path), "--data", str(data), "--mapping", str(tmp_path / "mapping.csv")])
    at = runs.Run(tmp_path, "first_run")
    got = tables.read_csv(spark, str(at.predictions))
    assert got.count() == sum(SIZES.values()) + SIZES["02"]
    seven = got.where(F.col("ID").startswith("D07"))
    assert seven.where("DungSai = 'CORRECT'").count() >= 15  # abstains where an old unit has several targets
    with pytest.raises(FileExistsError):
        benchmark.run(spark, data, tmp_path, "first_run", edges)
    main(["materials", "--run-id", "first_run", "--root", str(tmp_path), "--materials-id", "mat_v1"])
    folder = tmp_path / "materials/mat_v1"
    texts = {p.name: p.read_text() for p in folder.glob("*.md")}
    assert set(texts) == {"evidence.md", "data_preparation.md", "motivation.md", "method.md", "index.md", "coverage.md"}
    assert all(t.startswith("# ") and "first_run" in t for t in texts.values()) and "Data 02|noisy" in texts["evidence.md"].replace("\\|", "|")
    made = {p.stem: tables.read_csv(spark, str(p)) for p in (folder / "tables").glob("*.csv")}
    assert {"dataset_exact_metrics", "data02_robustness", "data04_recovery", "data06_contract", "data07_scope", "call_status", "case_studies"} <= set(made)
    noisy = made["data02_robustness"].where("MucDoNhieu = ''").first()
    assert int(noisy["n"]) == 20 and int(noisy["flips"]) <= int(noisy["clean_exact"])
    assert sum(int(r["n"]) for r in made["data04_systems"].where("KieuThieu = ''").collect()) == 20
    assert sum(int(r["n"]) for r in made["data07_outcomes"].collect()) == 20
    wrong = got.where("LoaiLoi <> 'none'")
    assert wrong.where("GhiChu = ''").count() == 0 and got.where("LoaiLoi = 'none' and GhiChu <> ''").count() == 0

    main(["dashboard", "--run-id", "first_run", "--root", str(tmp_path), "--second", "native_converter"])
    page = (at.folder / "dashboard.html").read_text()
    assert page.count('"id":"D01_') == 20 and "<script>const records = [" in page
    rows = dashboard.records(got, "heuristic_parser", "native_converter")
    assert dashboard.filtered(rows, dataset="D07", second="CORRECT").count() == seven.where("DungSai = 'CORRECT'").count()
    assert dashboard.filtered(rows, error="none", term="đường").count() <= rows.count() == got.select("ID").distinct().count()
    with pytest.raises(ValueError):
        dashboard.build(got, {}, tmp_path / "x.html", "<t>", "a", "b", most=3)
    main(["pilot", "--run-id", "pilot_run", "--root", str(tmp_path), "--data", str(data)])
    assert tables.read_csv(spark, str(runs.Run(tmp_path, "pilot_run").predictions)).count() >= 100
    at.predictions.write_text("changed")
    with pytest.raises(contracts.ContractError):
        documents.metric_tables(spark, at)


def test_contracts_of_tables(spark, town):
    """Each rule of a benchmark table finds the row that breaks it."""
    full = dict.fromkeys(T.FIELDS, "x")
    truth = {f"GT_{f}": "x" for f in T.FIELDS}
    make = lambda *rows: spark.createDataFrame([tuple(r.values()) for r in rows], [*rows[0]])
    rules = lambda n, df, *more: {r["rule"] for r in contracts.benchmark_violations(n, df, *more).collect()}
    one = {**full, "QuanHuyen": "", "ChuoiDiaChi": "a", "HeQuyChieu": "moi"}
    assert rules("01", make(one), 1) == set()
    assert rules("01", make(one, one, {**one, "ChuoiDiaChi": " ", "QuanHuyen": "q", "SoNha": "", "HeQuyChieu": "cu"}), 1) == {"unique_ChuoiDiaChi", "input", "district_empty", "complete", "system", "row_count"}
    two = {"ID": "N1", "ChuoiDiaChi": "a", "ChuoiDiaChiGoc": "b", "HeQuyChieu": "cu", "MucDoNhieu": "nhe", "LoaiNhieu": "x", **truth}
    assert rules("02", make(two, {**two, "ID": "N2", "ChuoiDiaChi": "c", "HeQuyChieu": "moi", "GT_QuanHuyen": ""})) == set()
    assert rules("02", make(two, {**two, "ChuoiDiaChi": "b", "GT_QuanHuyen": ""})) == {"unique_ID", "changed", "truth", "systems"}
    four = {**full, "PhuongXa": "", "ChuoiDiaChi": "a", "HeQuyChieu": "cu", "KieuThieu": "drop_ward", **truth}
    new = {**four, "ChuoiDiaChi": "b", "HeQuyChieu": "moi", "QuanHuyen": "", "GT_QuanHuyen": ""}
    assert rules("04", make(four, new), 2) == set()
    assert rules("04", make(four, {**new, "KieuThieu": "drop_district"}, {**four, "ChuoiDiaChi": "c"}), 2) == {"fields", "no_district_to_drop", "halves", "row_count"}
    six = {**full, "ChuoiDiaChi": "a", "HeQuyChieu": "Lai", "KieuLai": "C1_x", "Span_He_Detail": '{"PhuongXa":"moi","QuanHuyen":"cu","TinhThanh":"cu"}'}
    assert rules("06", make(six, {**six, "ChuoiDiaChi": "b", "KieuLai": "C2"})) == {"spans"}
    edges = spark.createDataFrame([("7", "W", "P")], "code string, new_ward string, new_province string")
    seven = {"ID_Node": "n:1", "DiaChi_Cu": "1, S, a, b, c", "DiaChi_Moi": "1, S, W, P", "QuanHe": "N-1", "Nguon": "x", "MaPhuongXaMoi": "7"}
    assert rules("07", make(seven), 1, edges) == set()
    assert rules("07", make(seven, {**seven, "DiaChi_Moi": "2, S, V, P", "QuanHe": "?"}), None, edges) == {"unique_ID_Node", "relation", "same_place", "target"}


def test_argument_ranges(spark):
    df = spark.createDataFrame([], "k string")
    for size, share in ((0, 0.5), (5, 1.5), (5, -0.1)):
        with pytest.raises(ValueError):
            synth.noisy_sample(df, "k", size, share, {}, {})
        with pytest.raises(ValueError):
            synth.missing_sample(df, "k", size, share, {})
    with pytest.raises(ValueError):
        benchmark.conversion_pairs(df, df, df, df, {}, -1, 1)


def test_commands(spark, town, tmp_path):
    """extract and audit from files to files."""
    mapping, _, diff, snapshot, _ = town
    tags = lambda w: f'{{"addr:street":"Lê Lợi","addr:ward":"{w}","addr:city":"Hà Nội"}}'
    lines = [f'{{"osm_type":"node","osm_id":{i},"version":{v},"ts":"{t}","visible":true,"tags":{tags(w)},"lat":1.0,"lon":2.0}}' for i in range(4) for v, t, w in ((1, "2025-01-01T00:00:00Z", "A"), (2, "2025-08-01T00:00:00Z", "B" if i else "A"))]
    (tmp_path / "h.jsonl").write_text("\n".join(lines))
    main(["extract", "--history", str(tmp_path / "h.jsonl"), "--out", str(tmp_path / "out")])
    assert tables.read_csv(spark, str(tmp_path / "out/snapshot_full.csv")).count() == 4
    assert tables.read_csv(spark, str(tmp_path / "out/differences.csv")).count() == 3
    assert tables.read_csv(spark, str(tmp_path / "out/snapshot_balanced.csv")).count() == 4
    tables.write_csv(diff, tmp_path / "data/differences.csv")
    tables.write_csv(snapshot, tmp_path / "data/snapshot_full.csv")
    tables.write_csv(mapping, tmp_path / "mapping.csv")
    main(["audit", "--data", str(tmp_path / "data"), "--mapping", str(tmp_path / "mapping.csv"), "--out", str(tmp_path / "out")])
    counts = {r["KetQua"]: int(r["count"]) for r in tables.read_csv(spark, str(tmp_path / "out/audit_counts.csv")).collect()}
    assert sum(counts.values()) == diff.count() and counts["accepted_observed"] > 0
    assert tables.read_csv(spark, str(tmp_path / "out/audit.csv")).count() == diff.count()
