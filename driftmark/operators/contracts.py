"""Data contracts: every rule is a table of violations, which must be empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.functions import text as T


class ContractError(ValueError):
    """A contract does not hold; the message has the first violations."""


def require_columns(df: DataFrame, columns, ordered: bool = False, name: str = "table") -> DataFrame:
    """df, if it has the columns (ordered: exactly these, in this order)."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"{name}: missing required columns {missing}")
    if ordered and df.columns != list(columns):
        raise ContractError(f"{name}: columns are not {list(columns)}")
    return df


def row_rules(df: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """(rule, key) of rows that break a rule; a rule is a condition that must hold (null breaks it). One scan."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return df.select(F.explode(broken).alias("rule"), key.cast("string").alias("key"))


def unique(df: DataFrame, *columns: str, rule: str = "unique") -> DataFrame:
    """(rule, key) of values that occur more than once."""
    n = df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")
    return n.select(F.lit(rule).alias("rule"), F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).alias("key"))


def conflicts(df: DataFrame, key: str, *columns: str, rule: str = "conflict") -> DataFrame:
    """(rule, key) of keys with more than one value in any of the columns."""
    n = df.groupBy(key).agg(*[F.count_distinct(c).alias(f"dm_{c}") for c in columns])
    more = reduce(lambda a, b: a | b, [F.col(f"dm_{c}") > 1 for c in columns])
    return n.where(more).select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def domain(df: DataFrame, column: str, allowed: list[str], complete: bool = False, rule: str = "domain") -> DataFrame:
    """(rule, key) of values outside the domain, and with ``complete`` of domain values that do not occur."""
    dim = df.sparkSession.createDataFrame([(a,) for a in allowed], "key string")
    seen = df.select(F.col(column).cast("string").alias("key")).distinct()
    out = seen.join(dim, "key", "left_anti")
    if complete:
        out = out.unionByName(dim.join(seen, "key", "left_anti"))
    return out.select(F.lit(rule).alias("rule"), "key")


def reference(df: DataFrame, target: DataFrame, columns: list[str], rule: str = "reference") -> DataFrame:
    """(rule, key) of tuples that the target does not hold."""
    gone = df.select(*columns).distinct().join(target.select(*columns).distinct(), columns, "left_anti")
    return gone.select(F.lit(rule).alias("rule"), F.concat_ws("|", *columns).alias("key"))


def row_count(df: DataFrame, expected: int, rule: str = "row_count") -> DataFrame:
    """(rule, key) with the count, if it is not the expected one."""
    return df.agg(F.count("*").alias("n")).where(F.col("n") != expected).select(F.lit(rule).alias("rule"), F.col("n").cast("string").alias("key"))


def same_keys(a: DataFrame, b: DataFrame, keys: list[str], rule: str = "same_keys") -> DataFrame:
    """(rule, key) of keys that only one side has."""
    left = a.select(*keys).distinct().withColumn("dm_a", F.lit(True))
    right = b.select(*keys).distinct().withColumn("dm_b", F.lit(True))
    odd = left.join(right, keys, "full_outer").where("dm_a is null or dm_b is null")
    return odd.select(F.lit(rule).alias("rule"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"))


def enforce(*violations: DataFrame) -> None:
    """Raise ContractError if any table of violations has rows."""
    rows = reduce(DataFrame.unionByName, violations).orderBy("rule", "key").limit(5).collect()
    if rows:
        raise ContractError("; ".join(f"{r['rule']}: {r['key']}" for r in rows))


def filled(*columns: str) -> Column:
    return reduce(lambda a, b: a & b, [T.clean_value(c) != "" for c in columns])


#: Row counts of the frozen benchmark tables.
EXPECTED_ROWS = {"01": 1000, "02": 1000, "03": 1500, "04": 800, "06": 600, "07": 600}
#: Columns of the benchmark tables.
_SURFACE, _TRUTH = ("ChuoiDiaChi", *T.FIELDS, "HeQuyChieu"), tuple(f"GT_{f}" for f in T.FIELDS)
REQUIRED = {
    "01": _SURFACE,
    "02": ("ID", "ChuoiDiaChi", "ChuoiDiaChiGoc", "HeQuyChieu", "MucDoNhieu", "LoaiNhieu", *_TRUTH),
    "03": _SURFACE,
    "04": (*_SURFACE, "KieuThieu", *_TRUTH),
    "06": (*_SURFACE, "KieuLai", "Span_He_Detail"),
    "07": ("ID_Node", "DiaChi_Cu", "DiaChi_Moi", "QuanHe", "Nguon", "MaPhuongXaMoi"),
}
#: The system of each part of each hybrid kind.
SPANS = {
    "C1": {"PhuongXa": "moi", "QuanHuyen": "cu", "TinhThanh": "cu"},
    "C2": {"PhuongXa": "moi", "QuanHuyen": "cu", "TinhThanh": "moi"},
    "C3": {"PhuongXa": "cu", "QuanHuyen": "cu", "TinhThanh": "moi"},
}
#: Fields that each kind of missing-field record lacks.
DROPPED = {"drop_ward": ("PhuongXa",), "drop_district": ("QuanHuyen",), "drop_housenumber_ward": ("SoNha", "PhuongXa"), "drop_housenumber": ("SoNha",)}


def benchmark_rules(number: str) -> dict[str, Column]:
    """Row rules of a benchmark table."""
    c, blank = F.col, lambda x: T.clean_value(x) == ""
    moi, cu = c("HeQuyChieu") == "moi", c("HeQuyChieu") == "cu"
    gt = [f"GT_{f}" for f in T.FIELDS]
    four = ("SoNha", "TenDuong", "PhuongXa", "TinhThanh")
    if number == "01":
        return {"system": moi, "district_empty": blank("QuanHuyen"), "complete": filled(*four)}
    if number == "02":
        return {"system": moi | cu, "changed": c("ChuoiDiaChi") != c("ChuoiDiaChiGoc"), "truth": filled(*[g for g in gt if g != "GT_QuanHuyen"]) & F.when(cu, filled("GT_QuanHuyen")).otherwise(blank("GT_QuanHuyen"))}
    if number == "03":
        return {"system": cu, "complete": filled(*T.FIELDS)}
    if number == "04":
        lost = F.create_map(*[x for k, v in DROPPED.items() for x in (F.lit(k), F.array(*[F.lit(f) for f in v]))])[c("KieuThieu")]
        gone = lambda f: F.array_contains(lost, f) | (moi & (F.lit(f) == "QuanHuyen"))
        kept = reduce(lambda a, b: a & b, [F.when(gone(f), blank(f)).otherwise(filled(f)) for f in T.FIELDS])
        truth = filled(*[g for g in gt if g != "GT_QuanHuyen"]) & F.when(moi, blank("GT_QuanHuyen")).otherwise(filled("GT_QuanHuyen"))
        return {"system": moi | cu, "kind": c("KieuThieu").isin(*DROPPED), "fields": kept, "truth": truth, "no_district_to_drop": ~(moi & (c("KieuThieu") == "drop_district"))}
    if number == "06":
        kind = F.split_part(c("KieuLai"), F.lit("_"), F.lit(1))
        spans = F.from_json("Span_He_Detail", "PhuongXa string, QuanHuyen string, TinhThanh string")
        same = reduce(lambda a, b: a | b, [(kind == k) & reduce(lambda x, y: x & y, [spans[f] == v for f, v in parts.items()]) for k, parts in SPANS.items()])
        return {"system": c("HeQuyChieu") == "Lai", "complete": filled(*T.FIELDS), "spans": same}
    if number == "07":
        parts = lambda a: T.address_split(a)
        old, new = parts("DiaChi_Cu"), parts("DiaChi_Moi")
        head = lambda p, k: F.slice(p, F.lit(1), F.greatest(F.size(p) - k, F.lit(0)))
        return {"relation": c("QuanHe").isin("1-1", "1-N", "N-1", "M-N"), "same_place": (F.size(old) >= 4) & (F.size(new) >= 3) & (head(old, 3) == head(new, 2))}
    raise ValueError(f"no such benchmark: {number}")


def benchmark_violations(number: str, df: DataFrame, expected: int | None = None, targets: DataFrame | None = None) -> DataFrame:
    """(rule, key) of everything in a benchmark table that breaks its contract.

    ``expected``: its row count, of which table 04 has one half in either system. ``targets``: code,
    new_ward and new_province of the mapping, which must hold the target of every row of table 07.
    """
    require_columns(df, REQUIRED[number], name=f"table {number}")
    address = "DiaChi_Cu" if number == "07" else "ChuoiDiaChi"
    found = [row_rules(df, F.col(address), {"input": filled(address), **benchmark_rules(number)})]
    found += [unique(df, c, rule=f"unique_{c}") for c in {"02": ("ID", address), "07": ("ID_Node",)}.get(number, (address,))]
    if expected is not None:
        found.append(row_count(df, expected))
    if number in ("02", "04"):
        found.append(domain(df, "HeQuyChieu", ["cu", "moi"], complete=True, rule="systems"))
    if number == "04" and expected is not None:
        halves = df.groupBy("HeQuyChieu").agg(F.count("*").alias("n")).where(F.col("n") != expected // 2)
        found.append(halves.select(F.lit("halves").alias("rule"), F.concat_ws("|", "HeQuyChieu", F.col("n").cast("string")).alias("key")))
    if number == "07" and targets is not None:
        parts = T.address_split("DiaChi_Moi")
        named = df.select(F.col("MaPhuongXaMoi").alias("code"), T.part_from_end(parts, 2).alias("new_ward"), T.part_from_end(parts, 1).alias("new_province"))
        found.append(reference(named, targets, ["code", "new_ward", "new_province"], rule="target"))
    return reduce(DataFrame.unionByName, found)


def check_file(path, columns: list[str], saved: dict | None = None) -> None:
    """Raise unless a CSV file begins with a byte order mark and, against its manifest entry, has the same columns and hash."""
    from driftmark.plans import runs
    from driftmark.sources import tables

    if not tables.has_bom(path):
        raise ContractError(f"{path}: no UTF-8 byte order mark")
    if saved is not None and (list(columns) != saved["columns"] or runs.file_sha256(path) != saved["sha256"]):
        raise ContractError(f"{path}: changed since it was frozen")
