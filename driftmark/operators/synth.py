"""Generators of synthetic records: abbreviated, noisy, incomplete, mixed and paired addresses.

Draws are hashes of seed, purpose and row, so a generator gives the same rows in any partitioning.
Where a process would reject repeats, enough attempts are made at once, the first row of each
surface stays, and a quota is taken; a quota that cannot be met is an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftmark.functions import text as T
from driftmark.operators import graph, sampling

#: Default probabilities of abbreviations, level shares, kinds of missing fields.
ABBREVIATIONS = {"district_Q": 0.75, "city_TP": 0.80, "ward_P": 0.60, "ward_F": 0.10}
LEVELS = {"nhe": 0.40, "vua": 0.40, "nang": 0.20}
MISSING = {"drop_ward": ("PhuongXa",), "drop_district": ("QuanHuyen",), "drop_housenumber_ward": ("SoNha", "PhuongXa"), "drop_housenumber": ("SoNha",)}
MISSING_WEIGHTS = {"drop_ward": 0.4, "drop_district": 0.3, "drop_housenumber_ward": 0.2, "drop_housenumber": 0.1}
#: Fixed value: what noisy records give as their source.
SOURCE = "synthetic_from_verified_osm"
#: Characters that a scan confuses.
CONFUSED = {"o": "0", "O": "0", "i": "1", "I": "1", "l": "1", "s": "5", "S": "5"}


def _short(c: Column, word: str, letter: str, seed, salt: str, key: Column) -> Column:
    """The value with its leading word replaced by one of three spellings of its letter."""
    return F.concat(T.pick(seed, salt, [f"{letter}. ", f"{letter}.", f"{letter} "], key), F.regexp_replace(c, rf"(?iuU)^{word}\s+", ""))


def abbreviate(c: Column, part: str, probs: dict[str, float], seed: int | str, key: Column) -> Column:
    """A ward, district or city with its level word shortened, by draws with the given probabilities."""
    p = {**ABBREVIATIONS, **probs}
    r, starts = T.draw(seed, f"{part}_roll", key), lambda w: c.rlike(rf"(?iuU)^{w}\b")
    short = lambda w, letter: _short(c, w, letter, seed, f"{part}_spelling", key)
    if part == "ward":
        bare = F.regexp_replace(c, r"(?iuU)^phường\s+", "")
        full = F.when(r < p["ward_P"], short("phường", "P")).when(r < p["ward_P"] + p["ward_F"], short("phường", "F")).when(r < p["ward_P"] + p["ward_F"] + 0.15, bare).otherwise(c)
        return F.when(starts("phường"), full).when(starts("xã") & (r < p["ward_P"]), short("xã", "X")).when(starts("thị trấn") & (r < p["ward_P"]), short("thị trấn", "TT")).otherwise(c)
    if part == "district":
        out = F.when(r >= p["district_Q"], c)
        for word, letter in (("quận", "Q"), ("huyện", "H"), ("thị xã", "TX"), ("thành phố", "TP")):
            out = out.when(starts(word), short(word, letter))
        return out.otherwise(c)
    named = lambda choices: T.pick(seed, "city_name", choices, key)
    province = F.when(T.draw(seed, "city_bare", key) < 0.6, F.regexp_replace(c, r"(?iuU)^tỉnh\s+", "")).otherwise(short("tỉnh", "T"))
    return (
        F.when(r >= p["city_TP"], c)
        .when(c.rlike("(?iu)hồ chí minh"), named(["TP.HCM", "TPHCM", "TP. HCM", "HCM"]))
        .when(c.rlike("(?iu)hà nội"), named(["TP. Hà Nội", "TP.HN", "Hà Nội", "HN"]))
        .when(starts("thành phố"), short("thành phố", "TP"))
        .when(starts("tỉnh"), province)
        .otherwise(c)
    )


def confuse(c: Column, seed: int | str, key: Column, table: dict[str, str] | None = None) -> Column:
    """One random character that a scan confuses, replaced."""
    table = table or CONFUSED
    spots = F.filter(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.substring(c, i, F.lit(1)).isin(*table))
    at = spots[F.floor(T.draw(seed, "spot", key) * F.size(spots)).cast("int")]
    swapped = F.translate(F.substring(c, at, F.lit(1)), "".join(table), "".join(table.values()))
    return F.when(F.size(spots) > 0, F.overlay(c, swapped, at, F.lit(1))).otherwise(c)


def weighted(seed, salt: str, key: Column, options: list[tuple[str, Column]]) -> Column:
    """One of the options by weights (columns, 0 where not eligible); uniform where all eligible weigh 0, null where none is (negative)."""
    total = sum((F.greatest(w, F.lit(0.0)) for _, w in options), F.lit(0.0))
    even = total == 0
    weight = [F.when(even, (w >= 0).cast("double")).otherwise(F.greatest(w, F.lit(0.0))) for _, w in options]
    whole = sum(weight, F.lit(0.0))
    at, run, out = T.draw(seed, salt, key) * whole, F.lit(0.0), None
    for (name, _), w in zip(options, weight, strict=True):
        run = run + w
        hit = (at < run) & (w > 0)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def attempts(rows: DataFrame, key: str, n: int) -> DataFrame:
    """n tries of every row: dm_try and a key for draws."""
    return rows.withColumn("dm_try", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("dm_key", F.concat_ws("#", F.col(key).cast("string"), F.col("dm_try").cast("string")))


def _state(fields: dict[str, Column], ops: Column, **more: Column) -> Column:
    return F.struct(*[fields[f].alias(f) for f in T.FIELDS], ops.alias("ops"), *[c.alias(n) for n, c in more.items()])


def _noted(ops: Column, when: Column, *names: Column) -> Column:
    """ops with the names added where a condition holds."""
    return F.when(when, F.concat(ops, F.array(*names))).otherwise(ops)


def _on_one(state: Column, salt: str, op: str, when: Column, make, seed, k: Column) -> Column:
    """One random field with letters changed by make(), and the operation noted if it did change."""
    words = ("TenDuong", "PhuongXa", "QuanHuyen", "TinhThanh")

    def pick(s):
        able = F.filter(F.array(*[F.when(s[f].rlike(r"(?U)\p{L}"), F.lit(f)) for f in words]), lambda x: x.isNotNull())
        chosen = T.let(able, lambda a: F.when(when & (F.size(a) > 0), F.get(a, F.floor(T.draw(seed, salt, k) * F.size(a)).cast("int"))))
        return T.let(F.coalesce(chosen, F.lit("")), lambda f: change(s, f))

    def change(s, f):
        old = F.coalesce(*[F.when(f == w, s[w]) for w in words], F.lit(""))
        return T.let(make(old), lambda new: _state({w: F.when(f == w, new).otherwise(s[w]) if w in words else s[w] for w in T.FIELDS}, _noted(s["ops"], (f != "") & (new != old), F.lit(op))))

    return T.let(state, pick)


def noisy(rows: DataFrame, key: str, probs: dict[str, float], missing: dict[str, float], seed: int = 42, system: str = "HeQuyChieu") -> DataFrame:
    """Noisy surfaces of complete records: level, operations and the changed fields, a row for each row.

    Columns: the fields as they appear, GT_ fields, ChuoiDiaChiGoc, ChuoiDiaChi, MucDoNhieu, LoaiNhieu
    (joined by |), SoPhepBienDoi. Each step binds the state before it once, so the plan grows with
    the number of steps only.
    """
    k = F.col(key).cast("string")
    low, mid = LEVELS["nhe"], LEVELS["nhe"] + LEVELS["vua"]
    r = T.draw(seed, "level", k)
    level = F.when(r < low, "nhe").when(r < mid, "vua").otherwise("nang")
    out = rows.select("*", *[T.clean_value(f).alias(f"GT_{f}") for f in T.FIELDS], level.alias("MucDoNhieu"))
    heavy, some = F.col("MucDoNhieu") == "nang", F.col("MucDoNhieu") != "nhe"
    parts = {"PhuongXa": "ward", "QuanHuyen": "district", "TinhThanh": "city"}

    short = F.struct(*[(abbreviate(F.col(f"GT_{f}"), parts[f], probs, seed, k) if f in parts else F.col(f"GT_{f}")).alias(f) for f in T.FIELDS])
    changed = lambda s: reduce(lambda a, b: a | b, [s[f] != F.col(f"GT_{f}") for f in parts])
    none = F.array().cast("array<string>")
    state = T.let(short, lambda s: _state({f: s[f] for f in T.FIELDS}, _noted(none, changed(s), F.lit("viet_tat"))))
    state = _on_one(state, "accent_field", "bo_dau", some & (T.draw(seed, "accent", k) < 0.75), T.strip_accents, seed, k)

    def drop(s):
        weight = lambda f, name, ok=None: (f, F.when((s[f] != "") & (F.lit(True) if ok is None else ok), F.lit(float(missing.get(name, 0)))).otherwise(F.lit(-1.0)))
        gone = weighted(seed, "drop_field", k, [weight("SoNha", "drop_housenumber"), weight("PhuongXa", "drop_ward"), weight("QuanHuyen", "drop_district", F.col(system) == "cu")])
        lost = F.coalesce(F.when(heavy & (T.draw(seed, "drop", k) < 0.70), gone), F.lit(""))
        return T.let(lost, lambda g: _state({f: F.when(g == f, "").otherwise(s[f]) for f in T.FIELDS}, _noted(s["ops"], g != "", F.concat(F.lit("thieu_"), g))))

    state = T.let(state, drop)
    state = _on_one(state, "scan_field", "loi_ocr_ky_tu", heavy & (T.draw(seed, "scan", k) < 0.60), lambda c: confuse(c, seed, k), seed, k)

    def render(s):
        shown = F.filter(F.array(*[s[f] for f in T.FIELDS]), lambda x: x != "")

        def place(p):
            mixed = F.transform(F.array_sort(F.transform(F.slice(p, 3, 5), lambda x, i: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), k, i.cast("string"))).alias("h"), x.alias("x")))), lambda z: z["x"])
            turn = heavy & (F.size(p) >= 3) & (T.draw(seed, "order", k) < 0.45)
            text = F.array_join(F.when(turn, F.concat(F.slice(p, 1, 2), mixed)).otherwise(p), "\u0001")
            ops = F.concat(_noted(s["ops"], turn, F.lit("dao_thu_tu_hanh_chinh")), F.array(F.lit("dinh_dang_phan_cach")))
            return _state({f: s[f] for f in T.FIELDS}, ops, surface=F.replace(text, F.lit("\u0001"), T.pick(seed, "separator", [",", " - ", "; "], k)))

        return T.let(shown, place)

    out = out.withColumn("ChuoiDiaChiGoc", T.address_join(*[f"GT_{f}" for f in T.FIELDS])).withColumn("dm_s", T.let(state, render))
    surface = F.col("dm_s.surface")
    plain = F.when(surface == F.col("ChuoiDiaChiGoc"), F.regexp_replace(surface, r",\s*", ",")).otherwise(surface)
    return out.withColumns({**{f: F.col(f"dm_s.{f}") for f in T.FIELDS}, "ChuoiDiaChi": plain, "LoaiNhieu": F.array_join("dm_s.ops", "|"), "SoPhepBienDoi": F.size("dm_s.ops")}).drop("dm_s")


def check_sizes(size: int, old_share: float) -> None:
    """Sizes are at least 1 and shares within [0, 1], or it raises."""
    if size < 1 or not 0 <= old_share <= 1:
        raise ValueError(f"size must be positive and the share within [0, 1], not {size} and {old_share}")


def quotas(size: int, old_share: float) -> dict[str, int]:
    """Rows of each system."""
    check_sizes(size, old_share)
    old = round(size * old_share)
    return {"cu": old, "moi": size - old}


def take_quotas(once: DataFrame, quota: dict[str, int], order: list, system: str = "HeQuyChieu") -> DataFrame:
    """The first rows of each system up to its quota; a quota that is not met raises. Systems are taken one by one, so that none is ranked in a single task."""
    parts = [sampling.require_size(once.where(F.col(system) == name).orderBy(*order).limit(n), n, f"unique rows of system {name}") for name, n in quota.items() if n]
    return reduce(DataFrame.unionByName, parts)


def noisy_sample(rows: DataFrame, key: str, size: int, old_share: float, probs: dict, missing: dict, seed: int = 42, tries: int = 80) -> DataFrame:
    """``size`` noisy records with unique surfaces, round(size * old_share) of system cu, with ids N00001 on.

    A record may be tried up to ``tries`` times; only as many tries are made as reach the quotas,
    doubling from one.
    """
    quota, order = quotas(size, old_share), ["dm_try", sampling.hash_order(seed, "dm_key"), "dm_key"]
    at = 1
    while True:
        made = noisy(attempts(rows, key, at), "dm_key", probs, missing, seed).where("ChuoiDiaChi <> ''")
        once = made.withColumn("dm_r", F.row_number().over(W.partitionBy("ChuoiDiaChi").orderBy(*order))).where("dm_r = 1")
        try:
            taken = take_quotas(once, quota, order)
            break
        except sampling.QuotaError:
            if at >= tries:
                raise
            at = min(tries, 2 * at)
    return sampling.numbered(taken, seed, "dm_key", "N%05d").drop("dm_r", "dm_try", "dm_key").withColumns({"Seed": F.lit(str(seed)), "Nguon": F.lit(SOURCE)})


def missing_candidates(rows: DataFrame, key: str, weights: dict | None = None, seed: int = 42, system: str = "HeQuyChieu") -> DataFrame:
    """Every record with every kind of missing fields that its system allows: KieuThieu, the weighted order of a draw (dm_order) and a key of its own (dm_key).

    Ordering by a draw raised to one over the weight takes candidates one by one with chances in
    proportion to their weights; kinds of weight 0 take part only where all weigh 0.
    """
    w = {n: max(0.0, float((weights or MISSING_WEIGHTS).get(n, 0.0))) for n in MISSING}
    if not any(w.values()):
        w = dict.fromkeys(w, 1.0)
    kinds = F.array(*[F.struct(F.lit(n).alias("kind"), F.lit(x).alias("w")) for n, x in w.items() if x > 0])
    out = rows.withColumn("dm_kind", F.explode(kinds)).where((F.col(system) != "moi") | (F.col("dm_kind.kind") != "drop_district"))
    out = out.withColumn("KieuThieu", F.col("dm_kind.kind")).withColumn("dm_key", F.concat_ws("#", F.col(key).cast("string"), "KieuThieu"))
    late = -F.log(F.greatest(T.draw(seed, "candidate", F.col("dm_key")), F.lit(1e-12))) / F.col("dm_kind.w")
    return out.withColumn("dm_order", late).drop("dm_kind")


def missing_sample(rows: DataFrame, key: str, size: int, old_share: float, probs: dict, weights: dict | None = None, seed: int = 42) -> DataFrame:
    """``size`` incomplete records with surfaces unique within a system, drawn from rows x kinds by weight."""
    quota, order = quotas(size, old_share), ["dm_order", "dm_key"]
    made = blanked(missing_candidates(rows, key, weights, seed), "dm_key", probs, seed)
    once = made.withColumn("dm_r", F.row_number().over(W.partitionBy("HeQuyChieu", "ChuoiDiaChi").orderBy(*order))).where("dm_r = 1")
    return sampling.shuffled(take_quotas(once, quota, order), seed, "dm_key").drop("dm_r", "dm_order", "dm_key")


def blanked(rows: DataFrame, key: str, probs: dict, seed: int = 42, system: str = "HeQuyChieu") -> DataFrame:
    """Records with the fields of their KieuThieu blanked and the rest abbreviated; a moi record has no district."""
    k, new = F.col(key).cast("string"), F.col(system) == "moi"
    truth = {f"GT_{f}": F.when(new, "").otherwise(T.clean_value(f)) if f == "QuanHuyen" else T.clean_value(f) for f in T.FIELDS}
    parts = {"PhuongXa": "ward", "QuanHuyen": "district", "TinhThanh": "city"}
    gone = lambda f: F.col("KieuThieu").isin([n for n, fs in MISSING.items() if f in fs])
    out = rows.withColumns(truth)
    out = out.withColumns({f: F.when(gone(f) | (F.col(f"GT_{f}") == ""), "").otherwise(abbreviate(F.col(f"GT_{f}"), parts[f], probs, seed, k) if f in parts else F.col(f"GT_{f}")) for f in T.FIELDS})
    return out.withColumn("ChuoiDiaChi", T.address_join(*T.FIELDS))


def missing_fields(rows: DataFrame, key: str, probs: dict, weights: dict | None = None, seed: int = 42, system: str = "HeQuyChieu") -> DataFrame:
    """Each record once, with the fields of one kind, drawn by weight, blanked and the rest abbreviated; a moi record has no district to drop."""
    w = weights or MISSING_WEIGHTS
    options = [(n, F.when(F.col(system) == "moi", F.lit(-1.0)).otherwise(F.lit(float(w.get(n, 0)))) if n == "drop_district" else F.lit(float(w.get(n, 0)))) for n in MISSING]
    return blanked(rows.withColumn("KieuThieu", weighted(seed, "kind", F.col(key).cast("string"), options)), key, probs, seed, system)


def hybrid_candidates(records: DataFrame, edges: DataFrame) -> DataFrame:
    """C1 (new ward, old district and province), C2 (new ward and province, old district) and C3 (old ward and district, new province) surfaces of records with a single target."""
    single = graph.classified(edges, "old_key", "new_key").where("out_degree = 1").select("old_key", "new_key", "relation")
    target = edges.join(single, ["old_key", "new_key"]).select(F.col("old_key").alias("dm_o"), F.col("new_ward").alias("dm_w"), F.col("new_province").alias("dm_p"), "relation", "merger_form")
    old = F.struct(T.province_key("TinhThanh").alias("p"), T.normalise_text("QuanHuyen").alias("d"), T.normalise_text("PhuongXa").alias("w"))
    met = records.where((T.clean_value("TenDuong") != "") & (T.clean_value("QuanHuyen") != "") & (T.clean_value("PhuongXa") != "") & (T.clean_value("TinhThanh") != "")).join(target, old == F.col("dm_o"))
    moved = T.province_key("dm_p") != T.province_key("TinhThanh")
    met = met.where((T.normalise_text("dm_w") != T.normalise_text("PhuongXa")) | moved)
    kinds = F.array(*[F.struct(F.lit(n).alias("kind"), w.alias("w"), p.alias("p"), need.alias("ok"), F.lit(ws).alias("ws"), F.lit(ps).alias("ps")) for n, w, p, need, ws, ps in (("C1", F.col("dm_w"), F.col("TinhThanh"), F.lit(True), "moi", "cu"), ("C2", F.col("dm_w"), F.col("dm_p"), moved, "moi", "moi"), ("C3", F.col("PhuongXa"), F.col("dm_p"), moved, "cu", "moi"))])
    made = met.withColumn("dm_k", F.explode(kinds)).where("dm_k.ok").withColumns({"KieuLai": F.col("dm_k.kind"), "PhuongXa": F.col("dm_k.w"), "TinhThanh": F.col("dm_k.p")})
    spans = F.to_json(F.struct(F.col("dm_k.ws").alias("PhuongXa"), F.lit("cu").alias("QuanHuyen"), F.col("dm_k.ps").alias("TinhThanh")))
    return made.withColumns({"Span_He_Detail": spans, "ChuoiDiaChi": T.address_join(*[T.clean_value(f) for f in T.FIELDS]), "HeQuyChieu": F.lit("Lai"), "QuanHe": F.col("relation"), "LoaiAnhXa": graph.scenario(F.col("relation")), "HinhThucSapNhap": F.col("merger_form")}).drop("dm_k", "dm_o", "dm_w", "dm_p", "relation", "merger_form")


def hybrids(records: DataFrame, edges: DataFrame, size: int, seed: int, key: str) -> DataFrame:
    """70 / 20 / 10 per cent of C1, C2 and C3 with surfaces unique across kinds."""
    a, b = round(0.7 * size), round(0.2 * size)
    return sampling.shuffled(sampling.quota_chain(hybrid_candidates(records, edges), "KieuLai", {"C1": a, "C2": b, "C3": size - a - b}, "ChuoiDiaChi", seed, key), seed, key)


def pairs(observed: DataFrame, derived: DataFrame, node: str, old: str, new: str, order: str) -> DataFrame:
    """Observed pairs, then derived ones whose pair and node are new; each pair once. Nodes are unique in either input."""
    first = W.partitionBy(old, new).orderBy(order)
    usable = lambda d: d.where((F.col(old) != "") & (F.col(old) != F.col(new)))
    once = lambda d: d.withColumn("dm_r", F.row_number().over(first)).where("dm_r = 1").drop("dm_r")
    seen = once(usable(observed))
    rest = usable(derived).join(seen.select(node), node, "left_anti").join(seen.select(old, new), [old, new], "left_anti").select(derived.columns)
    return seen.withColumn("observed", F.lit(True)).unionByName(once(rest).withColumn("observed", F.lit(False)))
