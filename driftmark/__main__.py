"""Command line: history extraction, receipts, benchmark tables, audits, runs, reports and the dashboard."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import functions as F

from driftmark.functions import lexicon
from driftmark.functions import text as T
from driftmark.operators import audit, contracts, graph, history, profile, receipts
from driftmark.plans import benchmark, dashboard, documents, runs
from driftmark.session import local_session
from driftmark.sources import history as entities
from driftmark.sources import tables

COMMANDS = {
    "extract": "snapshot, balanced snapshot and differences of an entity history",
    "filter": "clean and deduplicate receipt addresses, and measure their noise",
    "build": "the benchmark tables",
    "audit": "one reason for every difference record",
    "pilot": "20 rows of each table",
    "run": "all rows",
    "report": "metric tables and documents of a run",
    "materials": "the same under a materials id",
    "dashboard": "the page of a run",
}


def _aliases(spark, folder: str | None) -> dict:
    none = spark.createDataFrame([], "alias string, name string")
    return {c: tables.read_csv(spark, str(p), ["alias", "name"]) if folder and (p := Path(folder) / f"{c.split('_')[0]}.csv").exists() else none for c in benchmark.SIDES}


def _extract(spark, a) -> None:
    pairs = history.address_pairs(entities.read(spark, a.history))
    full = history.snapshot(pairs, lexicon.REGIONS)
    tables.write_csv(full, Path(a.out) / "snapshot_full.csv", a.overwrite)
    known = full.where(F.col("VungMien").isin(*lexicon.REGIONS))
    tables.write_csv(history.capped(known, "VungMien", F.concat_ws(":", "OSM_Type", "OSM_ID"), a.seed, a.per_region), Path(a.out) / "snapshot_balanced.csv", a.overwrite)
    tables.write_csv(history.difference(pairs, lexicon.REGIONS, a.source), Path(a.out) / "differences.csv", a.overwrite)


def _filter(spark, a) -> None:
    texts = tables.read_addresses(spark, a.receipts, a.csv).select(T.clean_receipt("text").alias("ChuoiDiaChi"))
    kept = texts.where(T.valid_text(F.col("ChuoiDiaChi"), lexicon.ADDRESS_WORDS)).withColumn("dm_i", F.monotonically_increasing_id())
    once = receipts.fuzzy_dedup(kept, "ChuoiDiaChi", "dm_i").select("ChuoiDiaChi").orderBy("ChuoiDiaChi")
    tables.write_csv(once, Path(a.out) / "receipts.csv", a.overwrite)
    again = tables.read_csv(spark, str(Path(a.out) / "receipts.csv"))
    tables.write_json(profile.as_config(profile.profile(again, "ChuoiDiaChi").collect(), "rates of markers in the text"), Path(a.out) / "noise.json", a.overwrite)


def _build(spark, a) -> None:
    read = lambda name: tables.read_csv(spark, str(Path(a.data) / name))
    noise = tables.read_json(Path(a.data) / "noise.json")["noise_probabilities"]
    made = benchmark.build(tables.read_csv(spark, a.mapping, graph.COLUMNS), read("latest.csv"), read("differences.csv"), read("snapshot_full.csv"), read("snapshot_balanced.csv"), _aliases(spark, a.aliases), noise["abbreviations"], noise["missing_rates"], contracts.EXPECTED_ROWS, a.seed)
    for n, df in made.items():
        tables.write_csv(df, Path(a.out) / benchmark.FILES[n], a.overwrite)


def _audit(spark, a) -> None:
    read = lambda name: tables.read_csv(spark, str(Path(a.data) / name))
    diff = benchmark.in_file_order(read("differences.csv")).withColumnRenamed("dm_i", "dm_row")
    found = audit.audit(diff, read("snapshot_full.csv"), graph.mapping_edges(tables.read_csv(spark, a.mapping, graph.COLUMNS)), _aliases(spark, a.aliases), "dm_row")
    flat = [c for c, kind in found.dtypes if not kind.startswith("struct") and c != "dm_row"]
    tables.write_csv(found.orderBy("dm_row").select(flat), Path(a.out) / "audit.csv", a.overwrite)
    tables.write_csv(found.groupBy("KetQua").count().orderBy(F.desc("count"), "KetQua"), Path(a.out) / "audit_counts.csv", a.overwrite)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="python -m driftmark", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, text in COMMANDS.items():
        c = commands.add_parser(name, help=text)
        c.add_argument("--overwrite", action="store_true")
        if name in ("extract", "filter", "build", "audit"):
            c.add_argument("--out", required=True)
            c.add_argument("--seed", type=int, default=42)
        else:
            c.add_argument("--run-id", required=True)
            c.add_argument("--root", default=".")
        if name == "extract":
            c.add_argument("--history", required=True)
            c.add_argument("--per-region", type=int, default=10_000)
            c.add_argument("--source", default="history")
        if name == "filter":
            c.add_argument("--receipts")
            c.add_argument("--csv", default="")
        if name in ("build", "audit"):
            c.add_argument("--aliases")
        if name in ("build", "audit", "pilot", "run"):
            c.add_argument("--data", required=True)
            c.add_argument("--mapping", required=name in ("build", "audit"))
        if name == "run":
            c.add_argument("--frozen", action="store_true", help="tables must have their frozen sizes")
        if name == "materials":
            c.add_argument("--materials-id", required=True)
        if name == "dashboard":
            c.add_argument("--first", default="heuristic_parser")
            c.add_argument("--second", default="libpostal")
    a = parser.parse_args(argv)
    spark = local_session()
    made = {"extract": _extract, "filter": _filter, "build": _build, "audit": _audit}.get(a.command)
    if made:
        return made(spark, a)
    at = runs.Run(Path(a.root), a.run_id)
    if a.command in ("report", "materials"):
        folder = at.folder / "report" if a.command == "report" else Path(a.root) / "materials" / runs.run_id(a.materials_id)
        print(documents.write_materials(spark, at, folder, a.overwrite))
    elif a.command == "dashboard":
        found = documents.metric_tables(spark, at)
        print(dashboard.build(tables.read_csv(spark, str(at.predictions)), {n: df for n, df in found.items() if n != "case_studies"}, at.folder / "dashboard.html", f"Run {at.name}", a.first, a.second, overwrite=a.overwrite))
    else:
        edges = graph.mapping_edges(tables.read_csv(spark, a.mapping, graph.COLUMNS)) if a.mapping else None
        expected = contracts.EXPECTED_ROWS if a.command == "run" and a.frozen else None
        print(benchmark.run(spark, Path(a.data), Path(a.root), a.run_id, edges, 20 if a.command == "pilot" else None, a.overwrite, expected=expected).folder)


if __name__ == "__main__":
    main()
