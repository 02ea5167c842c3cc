"""Report documents of a run: its metric tables, five Markdown documents and the coverage of pairs.

Every number comes from a table of the run; the text around it only says how to read it.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.functions import text as T
from driftmark.operators import cases, contracts, coverage, metrics, scoring
from driftmark.plans import benchmark, report, runs
from driftmark.sources import tables

OPERATIONS = ["viet_tat", "bo_dau", "loi_ocr_ky_tu", "thieu_", "dao_thu_tu_hanh_chinh", "dinh_dang_phan_cach"]
METRICS = "exact_match_rate: all scored fields are right. micro_f1_scored_fields: true and false positives and negatives pooled over records and scored fields; a wrong value is one of each false kind. macro_mean_field_f1: the mean over scored fields of their own F1."


def scored(predictions: DataFrame) -> DataFrame:
    """ID, tool, status, error, pred, truth and outcome of the stored predictions."""
    kind = ", ".join(f"{f} string" for f in T.FIELDS)
    pred, truth = F.from_json("TruongDuDoan", kind), F.from_json("TruongDung", kind)
    s = predictions.select("ID", F.col("CongCu").alias("tool"), F.col("DungSai").alias("status"), F.col("LoaiLoi").alias("error"), pred.alias("pred"), truth.alias("truth"))
    return s.withColumn("outcome", T.let(scoring.compare_fields(F.col("pred"), F.col("truth")), lambda o: o))


def metric_tables(spark: SparkSession, at: runs.Run) -> dict[str, DataFrame]:
    """The tables of a run whose files are still those of its manifest, by name."""
    manifest = tables.read_json(at.manifest)
    changed = runs.verify(manifest, {"predictions": at.predictions})
    if changed:
        raise contracts.ContractError(f"files differ from the manifest: {changed}")
    p, raw = tables.read_csv(spark, str(at.predictions)), spark.read.json(str(at.raw_responses))
    s = scored(p)
    contracts.enforce(metrics.missing_raw(s, raw))
    frames = {n: benchmark.in_file_order(tables.read_csv(spark, d["path"])) for n, d in manifest["datasets"].items()}
    out = {"dataset_exact_metrics": metrics.exact_by_condition(s).orderBy("dataset_condition", "tool")}
    keys = ["dataset", "tool"]
    named = s.withColumn("dataset", cases.dataset_of(F.col("ID")))
    out["status_rates"] = scoring.status_rates(named, keys).orderBy(*keys)
    out["field_metrics"] = scoring.field_metrics(scoring.confusion(scoring.long_outcomes(named, keys), [*keys, "field"]), None).orderBy(*keys, "field")
    out["error_classes"] = scoring.error_histogram(named, ["tool"]).orderBy("tool", "error")
    out["call_status"] = metrics.call_status(raw).orderBy("tool", "status")
    if "02" in frames:
        pairs = metrics.paired(s)
        contracts.enforce(metrics.unpaired(pairs))
        meta = frames["02"].select(F.col("ID").alias("base"), "MucDoNhieu", "LoaiNhieu")
        pairs = pairs.join(meta, "base")
        out["data02_robustness"] = metrics.robustness(pairs, "MucDoNhieu").orderBy("tool", "MucDoNhieu")
        out["data02_operations"] = metrics.by_operation(pairs, F.col("LoaiNhieu"), OPERATIONS).orderBy("tool", "operation")
    if "04" in frames:
        met = metrics.with_metadata(s, frames["04"], "D04_", "dm_i", "KieuThieu", *[F.col(f"GT_{f}").alias(f"dm_{f}") for f in T.FIELDS])
        lost = F.filter(F.array(*[F.when(F.col("KieuThieu").isin([k for k, v in contracts.DROPPED.items() if f in v]), F.struct(F.col(f"pred.{f}").alias("p"), F.col(f"dm_{f}").alias("t"))) for f in T.FIELDS]), lambda x: x.isNotNull())
        each = met.select("tool", "KieuThieu", F.explode(lost).alias("x"))
        out["data04_recovery"] = scoring.recovery(each, ["tool"], "KieuThieu", T.comparable("x.p"), T.comparable("x.t")).orderBy("tool", "KieuThieu")
        out["data04_systems"] = metrics.system_kinds(frames["04"]).orderBy("HeQuyChieu", "KieuThieu")
    if "06" in frames:
        out["data06_kinds"] = metrics.hybrid_exact(metrics.with_metadata(s, frames["06"], "D06_", "dm_i", "KieuLai"), F.col("KieuLai")).orderBy("tool", "mode", "kind")
        contract = metrics.hybrid_contract(frames["06"])
        contracts.enforce(contract.where("n = 0 or other_spans > 0 or no_district > 0").select(F.lit("hybrid_contract").alias("rule"), F.col("KieuLai").alias("key")))
        out["data06_contract"] = contract.orderBy("KieuLai")
    if "07" in frames:
        seven = s.where(F.col("ID").startswith("D07_")).withColumn("relation", F.regexp_extract("ID", r"_([^_]+)$", 1))
        out["data07_outcomes"] = metrics.conversion_outcomes(seven, "relation", "status", F.col("pred.PhuongXa")).orderBy("relation")
        out["data07_scope"] = metrics.scope(frames["07"]).orderBy("QuanHe")
    out["case_studies"] = cases.select(p, raw, 1)
    return out


def header(at: runs.Run) -> str:
    """What a document was made from."""
    manifest = tables.read_json(at.manifest)
    rows = sum(d["row_count"] for d in manifest["datasets"].values())
    return f"- run: `{at.name}`\n- manifest SHA-256: `{runs.file_sha256(at.manifest)}`\n- benchmark rows: {rows}; predictions: {manifest['output_row_counts']['predictions']}\n- status: draft, traceable to the run's files\n"


def documents(at: runs.Run, found: dict[str, DataFrame]) -> dict[str, str]:
    """Name and text of the five documents."""
    top = header(at)
    show = lambda *names: {n: found[n] for n in names if n in found}
    write = lambda title, parts: report.document(title, {"source": top, **parts})
    manifest = tables.read_json(at.manifest)
    files = "\n".join(f"- `{n}`: {d['row_count']} rows, SHA-256 `{d['sha256']}`" for n, d in manifest["datasets"].items()) + "\n"
    parts = {"data06_contract", "data07_scope"}
    return {
        "evidence.md": write("Measured results and traceable cases", {"method": f"Cases are the first ID of each data set, tool and error class; each is checked against its prediction and its raw response. {METRICS}\n", **show("dataset_exact_metrics", "data02_robustness", "data02_operations", "data04_recovery", "data06_kinds", "data07_outcomes", *sorted(parts), "case_studies")}),
        "data_preparation.md": write("Benchmark tables and their contracts", {"files": files, "contracts": "Every table passed its contract before the run: columns, unique inputs, systems, complete truth, and for each kind the parts that must be there or must be missing.\n", **show("data04_systems", *sorted(parts))}),
        "motivation.md": write("What is measured", {"question": "Old and new units name the same places. Tools are measured on parsing either system, on noise, on missing parts, on mixed systems and on conversion from old to new; nothing else is claimed.\n", **show("dataset_exact_metrics", *sorted(parts))}),
        "method.md": write("How it is measured", {"metrics": METRICS + "\n", "relations": "A unit's degree before and after gives 1-1, 1-N, N-1 and M-N edges. Only edges with one target convert without further evidence.\n", **show("field_metrics", "error_classes", "call_status")}),
        "index.md": write("Files", {"files": files, "tables": "\n".join(f"- `{n}.csv`" for n in found) + "\n"}),
    }


def pair_coverage(pairs: DataFrame, direct: str, regions: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """Coverage of table 07: counts by source, relation and merger form, direct rows by relation, the most frequent provinces, warnings."""
    relations = ["1-1", "1-N", "N-1", "M-N"]
    seen = F.col("Nguon") == direct
    axes = {"source": (F.col("Nguon"), [direct]), "relation": (F.col("QuanHe"), relations), "merger_form": (F.col("HinhThucSapNhap"), [])}
    if regions:
        axes["region"] = (T.region_of(F.col("DiaChi_Moi"), regions, "Khac"), list(regions))
    return {
        "coverage": coverage.axis_counts(pairs, axes).orderBy("axis", "category"),
        "direct_relations": coverage.direct_counts(pairs, seen, "QuanHe", relations).orderBy("subject"),
        "top_provinces": coverage.top_values(pairs, T.part_from_end(T.address_split("DiaChi_Moi"), 1)),
        "warnings": coverage.warnings(pairs, seen, "QuanHe", relations).orderBy("rule", "subject"),
    }


def write_materials(spark: SparkSession, at: runs.Run, folder: Path, overwrite: bool = False) -> Path:
    """CSV tables, the documents, the coverage of pairs and the lineage of a run; returns the index."""
    found, made = metric_tables(spark, at), {}
    for name, df in found.items():
        made[name] = Path(folder) / "tables" / f"{name}.csv"
        tables.write_csv(df, made[name], overwrite)
    texts = documents(at, found)
    seven = tables.read_json(at.manifest)["datasets"].get("07")
    if seven:
        texts["coverage.md"] = report.document("Coverage of conversion pairs", {"source": header(at), **pair_coverage(tables.read_csv(spark, seven["path"]), benchmark.OBSERVED)})
    for name, text in texts.items():
        made[name] = tables.guard(Path(folder) / name, overwrite)
        made[name].write_text(text, encoding="utf-8")
    tables.write_json(runs.lineage(at, made), Path(folder) / "lineage.json", overwrite)
    return Path(folder) / "index.md"
