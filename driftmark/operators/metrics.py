"""Report tables of a scored run: conditions, pairs of clean and noisy forms, roll-ups by benchmark metadata.

A scored table has ID, tool, status and outcome (a struct of field outcomes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.functions import text as T
from driftmark.operators import contracts, scoring

#: Name, ID prefix and ID suffix of each condition; the single-parse tool has one of its own.
CONDITIONS = (
    ("Data 01|all", "D01_", ""),
    ("Data 02|clean", "D02_", "_clean"),
    ("Data 02|noisy", "D02_", "_noisy"),
    ("Data 03|all", "D03_", ""),
    ("Data 04|surface_parse", "D04_", ""),
    ("Data 06|vn_from_2025", "D06_", "_m25"),
    ("Data 06|vn_legacy", "D06_", "_mleg"),
    ("Data 07|old_to_new", "D07_", ""),
)
SINGLE = ("Data 06|libpostal", "D06_")
#: Fields scored and direction of table 07.
PAIR_FIELDS, DIRECTION = ("PhuongXa", "TinhThanh"), "old_to_new"


def mode_of_id(record_id: Column) -> Column:
    """The mode that an ID's suffix names."""
    return F.when(record_id.endswith("_m25"), "FROM_2025").when(record_id.endswith("_mleg"), "LEGACY").otherwise("single parse")


def condition_of(record_id: Column, tool: Column, single: str = "libpostal") -> Column:
    """The condition of a record, null for none."""
    out = F.when(record_id.startswith(SINGLE[1]) & (tool == single), SINGLE[0])
    for name, prefix, suffix in CONDITIONS:
        out = out.when(record_id.startswith(prefix) & record_id.endswith(suffix), name)
    return out


def counts_of(outcome: Column, fields=T.FIELDS) -> Column:
    """tp, fp and fn of a record; a MISMATCH is one false positive and one false negative."""
    n = lambda *kinds: sum((outcome[f].isin(*kinds).cast("long") for f in fields[1:]), outcome[fields[0]].isin(*kinds).cast("long"))
    return F.struct(n("TP").alias("tp"), n("FP", "MISMATCH").alias("fp"), n("FN", "MISMATCH").alias("fn"))


def f1_of(counts: str, zero: float | None = None) -> Column:
    """Micro F1 over grouped records; ``zero`` (null) where nothing was given or asked."""
    tp, fp, fn = (F.sum(f"{counts}.{k}") for k in ("tp", "fp", "fn"))
    return scoring.ratio(2 * tp, 2 * tp + fp + fn, zero)


def exact_by_condition(scored: DataFrame, single: str = "libpostal") -> DataFrame:
    """(dataset_condition, tool): n, exact_correct, exact_match_rate, micro_f1_scored_fields, macro_mean_field_f1 over the fields scored there.

    One grouped pass: every record adds a count for each field and outcome.
    """
    keys = ["dataset_condition", "tool"]
    rows = scored.withColumn("dataset_condition", condition_of(F.col("ID"), F.col("tool"), single)).where("dataset_condition is not null")
    count = lambda f, *kinds: F.count_if(F.col(f"outcome.{f}").isin(*kinds))
    per = [F.struct(count(f, "TP").alias("tp"), count(f, "FP", "MISMATCH").alias("fp"), count(f, "FN", "MISMATCH").alias("fn"), F.lit(f).alias("field")) for f in T.FIELDS]
    known = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "CORRECT").alias("exact_correct"), F.array(*per).alias("dm_per"))
    pair = F.col("dataset_condition").startswith("Data 07")
    used = known.withColumn("dm_per", F.filter("dm_per", lambda x: ~pair | x["field"].isin(*PAIR_FIELDS)))
    total = lambda k: F.aggregate("dm_per", F.lit(0).cast("long"), lambda a, x: a + x[k])
    tp, fp, fn = total("tp"), total("fp"), total("fn")
    f1 = F.transform("dm_per", lambda x: scoring.ratio(2 * x["tp"], 2 * x["tp"] + x["fp"] + x["fn"]))
    mean = F.aggregate(f1, F.lit(0.0), lambda a, x: a + x) / F.size("dm_per")
    fields = F.when(pair, ",".join(PAIR_FIELDS)).otherwise(",".join(T.FIELDS))
    return used.select(*keys, "n", "exact_correct", scoring.ratio(2 * tp, 2 * tp + fp + fn).alias("micro_f1_scored_fields"), mean.alias("macro_mean_field_f1"), scoring.ratio(F.col("exact_correct"), F.col("n")).alias("exact_match_rate"), fields.alias("scored_fields"))


def paired(scored: DataFrame, prefix: str = "D02_") -> DataFrame:
    """base, tool and, of the clean and the noisy form, whether it is exact (clean, noisy) and its counts (clean_n, noisy_n); null: the form is missing."""
    rows = scored.where(F.col("ID").startswith(prefix)).select(F.regexp_extract("ID", rf"^{prefix}([^_]+)", 1).alias("base"), "tool", F.col("ID").endswith("_clean").alias("dm_c"), (F.col("status") == "CORRECT").alias("ok"), counts_of(F.col("outcome")).alias("dm_n"))
    of = lambda c, when: F.max(F.when(when, F.col(c)))
    return rows.groupBy("base", "tool").agg(of("ok", F.col("dm_c")).alias("clean"), of("ok", ~F.col("dm_c")).alias("noisy"), of("dm_n", F.col("dm_c")).alias("clean_n"), of("dm_n", ~F.col("dm_c")).alias("noisy_n"))


def unpaired(pairs: DataFrame) -> DataFrame:
    """(rule, key) of records without one of the forms."""
    return pairs.where("clean is null or noisy is null").select(F.lit("unpaired").alias("rule"), F.concat_ws("|", "base", "tool").alias("key"))


def _sides() -> list[Column]:
    return [f1_of("clean_n").alias("clean_f1"), f1_of("noisy_n").alias("noisy_f1")]


def robustness(pairs: DataFrame, level: str) -> DataFrame:
    """By tool and level, and over all levels (null): exact counts and F1 of both sides, flips either way, relative F1 drop in per cent."""
    c, n = F.col("clean"), F.col("noisy")
    counted = [F.count("*").alias("n"), F.count_if(c).alias("clean_exact"), F.count_if(n).alias("noisy_exact"), *_sides(), F.count_if(c & ~n).alias("flips"), F.count_if(~c & n).alias("reverse_flips")]
    out = pairs.groupingSets([[F.col("tool"), F.col(level)], [F.col("tool")]], "tool", level).agg(*counted)
    return out.withColumn("f1_drop_percent", F.when(F.col("clean_f1") > 0, 100 * (F.col("clean_f1") - F.col("noisy_f1")) / F.col("clean_f1")))


def by_operation(pairs: DataFrame, operations: Column, families: list[str]) -> DataFrame:
    """By tool and operation: n, exact counts and F1 of both sides. A row counts for every family whose name occurs in its operations."""
    hit = F.filter(F.array(*[F.when(operations.contains(f), F.lit(f)) for f in families]), lambda x: x.isNotNull())
    rows = pairs.withColumn("operation", F.explode(hit))
    return rows.groupBy("tool", "operation").agg(F.count("*").alias("n"), F.count_if("clean").alias("clean_exact"), F.count_if("noisy").alias("noisy_exact"), *_sides())


def conversion_outcomes(rows: DataFrame, relation: str, status: str, ward: Column) -> DataFrame:
    """By relation: n, right targets, wrong ones with an output, and empty outputs. A right one that is empty counts as both right and empty, and less as wrong."""
    right, empty = F.count_if(F.col(status) == "CORRECT"), F.count_if(T.blank(ward) == "")
    return rows.groupBy(relation).agg(F.count("*").alias("n"), right.alias("correct"), (F.count("*") - right - empty).alias("wrong_target"), empty.alias("empty"))


def call_status(raw: DataFrame) -> DataFrame:
    """Calls by tool and status."""
    return raw.groupBy("tool", "status").agg(F.count("*").alias("n"))


def missing_raw(scored: DataFrame, raw: DataFrame) -> DataFrame:
    """(rule, key) if the raw log has not as many rows as there are predictions."""
    both = scored.select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(raw.select(F.lit(0).alias("a"), F.lit(1).alias("b")))
    sums = both.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"))
    return sums.where("a <> b").select(F.lit("raw_count").alias("rule"), F.concat_ws("|", "a", "b").alias("key"))


def with_metadata(scored: DataFrame, table: DataFrame, prefix: str, row: str, *columns: str) -> DataFrame:
    """Records of a data set with columns of the benchmark row that their ID names, by its number or its id."""
    part = F.regexp_extract("ID", rf"^{prefix}([^_]+)", 1)
    key = part.cast("long") if table.schema[row].dataType.typeName() in ("integer", "long") else part
    meta = table.select(F.col(row).alias("dm_row"), *columns)
    return scored.where(F.col("ID").startswith(prefix)).withColumn("dm_at", key).join(meta, F.col("dm_at") == F.col("dm_row")).drop("dm_at", "dm_row")


def hybrid_exact(rows: DataFrame, kind: Column) -> DataFrame:
    """By tool, mode (of the ID) and kind (before its underscore): n and exact records."""
    named = rows.select("tool", mode_of_id(F.col("ID")).alias("mode"), F.split_part(kind, F.lit("_"), F.lit(1)).alias("kind"), (F.col("status") == "CORRECT").alias("ok"))
    return named.groupBy("tool", "mode", "kind").agg(F.count("*").alias("n"), F.count_if("ok").alias("exact"))


def scope(pairs: DataFrame, relation: str = "QuanHe") -> DataFrame:
    """Rows of each relation, with the direction and the fields that are scored."""
    return pairs.groupBy(relation).agg(F.count("*").alias("n")).withColumns({"direction_evaluated": F.lit(DIRECTION), "scored_fields": F.lit(",".join(PAIR_FIELDS))})


def hybrid_contract(rows: DataFrame, kind: str = "KieuLai", spans: str = "Span_He_Detail", district: str = "QuanHuyen") -> DataFrame:
    """Each hybrid kind: n, the system of each part, rows whose spans say otherwise and rows without a district. The last two must be 0, and n must not."""
    spec = "PhuongXa string, QuanHuyen string, TinhThanh string"
    known = rows.sparkSession.createDataFrame([(k, *v.values()) for k, v in contracts.SPANS.items()], "KieuLai string, PhuongXa_he string, QuanHuyen_he string, TinhThanh_he string")
    seen = rows.select(F.split_part(kind, F.lit("_"), F.lit(1)).alias("dm_k"), F.from_json(spans, spec).alias("s"), (T.clean_value(district) == "").alias("dm_e"))
    met = known.join(seen, F.col("KieuLai") == F.col("dm_k"), "left")
    same = F.coalesce(F.col("s") == F.struct(F.col("PhuongXa_he").alias("PhuongXa"), F.col("QuanHuyen_he").alias("QuanHuyen"), F.col("TinhThanh_he").alias("TinhThanh")), F.lit(False))
    return met.groupBy(*known.columns).agg(F.count("dm_k").alias("n"), F.count_if(F.col("dm_k").isNotNull() & ~same).alias("other_spans"), F.count_if("dm_e").alias("no_district"))


def system_kinds(rows: DataFrame, system: str = "HeQuyChieu", kind: str = "KieuThieu") -> DataFrame:
    """Rows of each system and kind, and of each system over all kinds (null)."""
    return rows.groupingSets([[F.col(system), F.col(kind)], [F.col(system)]], system, kind).agg(F.count("*").alias("n"))
