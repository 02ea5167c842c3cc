"""The library's operators on the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.functions import literals
from driftmark.functions import text as T
from driftmark.operators import alias, audit, cases, contracts, coverage, explore, graph, history, metrics, order, parser, profile, receipts, sampling, scoring, synth
from driftmark.plans import dashboard, protocol

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- graph --------------------------------------------------------------------------------------

_EDGES = "e AS (SELECT DISTINCT l_orderkey AS old, l_partkey * 100 + CAST(l_quantity AS BIGINT) AS new FROM lineitem), g AS (SELECT old, new, count(*) OVER (PARTITION BY old) AS o, count(*) OVER (PARTITION BY new) AS i FROM e), r AS (SELECT *, CASE WHEN o = 1 AND i = 1 THEN '1-1' WHEN o > 1 AND i = 1 THEN '1-N' WHEN o = 1 AND i > 1 THEN 'N-1' ELSE 'M-N' END AS relation FROM g)"


def _edges(spark, d):
    """Orders as old units, a part in a quantity as a new one: all four relations occur."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("old"), (F.col("l_partkey") * 100 + F.col("l_quantity").cast("long")).alias("new"))


@query(f"WITH {_EDGES} SELECT old, new, o AS out_degree, i AS in_degree, relation, CASE relation WHEN '1-1' THEN 'C' WHEN '1-N' THEN 'A' WHEN 'N-1' THEN 'B' ELSE 'M' END AS scenario FROM r")
def relation_graph_edges(spark, d):
    return graph.classified(_edges(spark, d), "old", "new").withColumn("scenario", graph.scenario(F.col("relation")))


@query(f"WITH {_EDGES} SELECT (SELECT count(*) FROM lineitem) AS atomic_edges, count(DISTINCT old) AS old_units, count(DISTINCT new) AS new_units, count(*) FILTER (relation = '1-1') AS one_to_one_edges, count(*) FILTER (relation = '1-N') AS one_to_many_edges, count(*) FILTER (relation = 'N-1') AS many_to_one_edges, count(*) FILTER (relation = 'M-N') AS many_to_many_edges FROM r")
def relation_graph_summary(spark, d):
    return graph.summary(_edges(spark, d), "old", "new")


@query(f"WITH {_EDGES} SELECT o_orderkey, o_custkey, r.new FROM orders LEFT JOIN r ON r.old = o_orderkey AND r.o = 1")
def unique_target_conversion(spark, d):
    return graph.convert(table(spark, d, "orders").select("o_orderkey", "o_custkey"), _edges(spark, d), "o_orderkey", "old", "new")


@query(f"WITH {_EDGES} SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT old FROM r WHERE o > 1)")
def abstention_list(spark, d):
    return graph.abstained(table(spark, d, "orders").select("o_orderkey"), _edges(spark, d), "o_orderkey", "old", "new")


@query(f"WITH {_EDGES} SELECT 'targets' AS side, old AS unit, array_to_string(list_sort(list(new)), ',') AS others FROM e GROUP BY old UNION ALL SELECT 'origins', new, array_to_string(list_sort(list(old)), ',') FROM e GROUP BY new")
def adjacency_lists(spark, d):
    e = _edges(spark, d)
    flat = lambda df, side, unit, others: df.select(F.lit(side).alias("side"), F.col(unit).alias("unit"), F.array_join(F.col(others).cast("array<string>"), ",").alias("others"))
    return flat(graph.targets_for_old(e, "old", "new"), "targets", "old", "targets").unionByName(flat(graph.origins_for_new(e, "old", "new"), "origins", "new", "origins"))


#: Customers as rows of a mapping table: (province, district, ward) before and (province, ward) after.
_MAPPING = "e AS (SELECT DISTINCT c_nationkey AS np, c_custkey % 5 AS nd, c_custkey % 40 AS nw, c_nationkey // 3 AS q, c_custkey % 25 AS v FROM customer), g AS (SELECT *, count(*) OVER (PARTITION BY np, nd, nw) AS o, count(*) OVER (PARTITION BY q, v) AS i FROM e), r AS (SELECT *, CASE WHEN o = 1 AND i = 1 THEN '1-1' WHEN o > 1 AND i = 1 THEN '1-N' WHEN o = 1 AND i > 1 THEN 'N-1' ELSE 'M-N' END AS relation FROM g)"


def _named(prefix: str, number) -> F.Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def _mapping(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    values = (_named("Xã ", k % 40), _named("Huyện ", k % 5), _named("Tỉnh P", n), _named("Tỉnh N", F.floor(n / 3)), _named("Phường ", k % 25), _named("T", k), F.lit(""), F.lit("gop"), F.lit(""))
    return graph.mapping_edges(table(spark, d, "customer").select(*[v.alias(c) for c, v in zip(graph.COLUMNS, values, strict=True)], k.alias("ord")))


@query(f"WITH {_MAPPING}, x AS (SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN (SELECT max(q) FROM e WHERE q = o_custkey % 12) ELSE (SELECT max(q) FROM e WHERE np = o_custkey % 30) END AS p, o_orderkey % 30 AS a, o_custkey % 25 AS b FROM orders), u AS (SELECT DISTINCT q, v FROM e) SELECT o_orderkey, coalesce('Tỉnh N' || ua.q || ': Phường ' || ua.v, 'Tỉnh N' || ub.q || ': Phường ' || ub.v) AS target FROM x LEFT JOIN u ua ON ua.q = x.p AND ua.v = x.a LEFT JOIN u ub ON ub.q = x.p AND ub.v = x.b")
def target_probe_coalesce(spark, d):
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    province = F.when(c % 2 == 0, _named("tỉnh  N", c % 12)).otherwise(_named("TP. P", c % 30))
    o = table(spark, d, "orders").select("o_orderkey", province.alias("p"), _named("phường ", k % 30).alias("a"), _named(" Phường  ", c % 25).alias("b"))
    return graph.resolve_target(o, _mapping(spark, d), "p", "a", "b").select("o_orderkey", F.concat("target.new_province", F.lit(": "), "target.new_ward").alias("target"))


@query("SELECT 'unit' AS kind, 'n' || c_nationkey // 3 || '|phường ' || c_custkey % 25 AS key, arg_min('T' || c_custkey, c_custkey) AS value FROM customer GROUP BY c_nationkey // 3, c_custkey % 25 UNION ALL SELECT 'province', 'n' || c_nationkey // 3, 'Tỉnh N' || c_nationkey // 3 FROM customer GROUP BY c_nationkey // 3 UNION ALL SELECT 'province', 'p' || c_nationkey, 'Tỉnh N' || c_nationkey // 3 FROM customer GROUP BY c_nationkey")
def first_last_wins(spark, d):
    m = _mapping(spark, d)
    units = graph.new_units(m).select(F.lit("unit").alias("kind"), F.concat_ws("|", "new_key.p", "new_key.w").alias("key"), F.col("unit_type").alias("value"))
    return units.unionByName(graph.province_names(m).select(F.lit("province").alias("kind"), "key", F.col("name").alias("value")))


@query(f"WITH {_MAPPING} SELECT o_orderkey, r.relation FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN r ON r.np = c_nationkey AND r.nd = c_custkey % 5 AND r.nw = c_custkey % 40 AND r.v = o_orderkey % 25")
def edge_lookup_join(spark, d):
    k, n = F.col("o_custkey"), F.col("c_nationkey")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, F.col("c_custkey") == k)
    o = o.select("o_orderkey", _named("N", F.floor(n / 3)).alias("np"), _named("phường ", F.col("o_orderkey") % 25).alias("nw"), _named("TP P", n).alias("op"), _named("huyện ", k % 5).alias("od"), _named("XÃ ", k % 40).alias("ow"))
    m = _mapping(spark, d)
    return graph.edge_of(graph.resolve_target(o, m, "np", "nw"), m, "op", "od", "ow").select("o_orderkey", F.col("edge.relation").alias("relation"))


@query("WITH m AS (SELECT 'p' || c_nationkey AS op, CASE WHEN c_custkey % 211 = 0 THEN '' ELSE 'd' || c_custkey % 5 END AS od, 'w' || c_custkey % 40 AS ow, 'n' || (c_nationkey // 3 + CASE WHEN c_custkey % 97 = 0 THEN 1 ELSE 0 END) AS np, CASE WHEN c_custkey % 307 = 0 THEN '' ELSE 'v' || c_custkey % 25 END AS nw, CASE WHEN c_custkey % 3 > 0 THEN 'T' || c_custkey % 700 ELSE '' END AS code FROM customer) SELECT 'missing_identity' AS rule, op || '|' || od || '|' || ow AS key FROM m WHERE od = '' OR nw = '' UNION ALL SELECT 'code_conflict', code FROM m WHERE code <> '' GROUP BY code HAVING count(DISTINCT np) > 1 OR count(DISTINCT nw) > 1 UNION ALL SELECT 'province_conflict', op FROM m GROUP BY op HAVING count(DISTINCT np) > 1")
def mapping_violations(spark, d):
    """Customers as rows of a mapping table, each twice, with gaps and conflicts."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    gone = lambda m, v: F.when(k % m == 0, F.lit("")).otherwise(v)
    code = F.when(k % 3 > 0, _named("T", k % 700)).otherwise("")
    values = (_named("w", k % 40), gone(211, _named("d", k % 5)), _named("p", n), _named("n", F.floor(n / 3) + (k % 97 == 0).cast("int")), gone(307, _named("v", k % 25)), _named("", k), code, F.lit("gop"), F.lit(""))
    rows = table(spark, d, "customer").select(*[v.alias(c) for c, v in zip(graph.COLUMNS, values, strict=True)], k.alias("ord"))
    return graph.mapping_violations(graph.mapping_edges(rows.union(rows)))


# --- text ---------------------------------------------------------------------------------------

_ADDRESS = "a AS (SELECT c_custkey, '  ' || c_name || '   Street, ' AS street, 'Phường  ' || c_mktsegment AS ward, 'TP. ' || n_name || ' ,' AS city, CASE WHEN c_acctbal > 0 THEN 'Quận ' || r_name ELSE '' END AS district, c_custkey % 97 || '/' || c_custkey % 7 AS house, c_acctbal, c_nationkey FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"


def _address(spark, d):
    c, n, r = (table(spark, d, x) for x in ("customer", "nation", "region"))
    met = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    house = F.concat((F.col("c_custkey") % 97).cast("string"), F.lit("/"), (F.col("c_custkey") % 7).cast("string"))
    return met.select("c_custkey", F.concat(F.lit("  "), "c_name", F.lit("   Street, ")).alias("street"), F.concat(F.lit("Phường  "), "c_mktsegment").alias("ward"), F.concat(F.lit("TP. "), "n_name", F.lit(" ,")).alias("city"), F.when(F.col("c_acctbal") > 0, F.concat(F.lit("Quận "), "r_name")).otherwise("").alias("district"), house.alias("house"), "c_acctbal", "c_nationkey")


_CLEAN = "regexp_replace(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'), '[, ]+$', '')"
_NORMAL = "trim(regexp_replace(replace(lower(" + _CLEAN + "), 'ß', 'ss'), '\\s+', ' ', 'g'))"


@query(f"WITH {_ADDRESS} SELECT c_custkey, {_CLEAN.format('street')} AS street_clean, {_NORMAL.format('street')} AS street_key, {_NORMAL.format('ward')} AS ward_key, trim(regexp_replace({_NORMAL.format('city')}, '^(?:tỉnh|thành phố|tp\\.?)\\s+', '')) AS province_key FROM a")
def key_normalise(spark, d):
    return _address(spark, d).select("c_custkey", T.clean_value("street").alias("street_clean"), T.normalise_text("street").alias("street_key"), T.normalise_text("ward").alias("ward_key"), T.province_key("city").alias("province_key"))


_LEVEL_SQL = "^(?:" + "|".join(T.LEVELS) + ")\\s+"


@query(f"WITH {_ADDRESS} SELECT c_custkey, trim(regexp_replace({_NORMAL.format('ward')}, '{_LEVEL_SQL}', '')) AS ward, trim(regexp_replace({_NORMAL.format('district')}, '{_LEVEL_SQL}', '')) AS district, trim(regexp_replace({_NORMAL.format('city')}, '{_LEVEL_SQL}', '')) AS city FROM a")
def scorer_norm(spark, d):
    return _address(spark, d).select("c_custkey", *[T.comparable(c).alias(c) for c in ("ward", "district", "city")])


@query(f"WITH {_ADDRESS} SELECT c_custkey, array_to_string(list_filter([house, {_CLEAN.format('street')}, ward, district, {_CLEAN.format('city')}], lambda x: x <> ''), ', ') AS address FROM a")
def address_join(spark, d):
    return _address(spark, d).select("c_custkey", T.address_join("house", T.clean_value("street"), "ward", "district", T.clean_value("city")).alias("address"))


@query(f"WITH {_ADDRESS}, s AS (SELECT c_custkey, list_filter(list_transform(string_split(house || ', ' || district || ',, ' || ward || ' , ' || city, ','), lambda x: trim(x)), lambda x: x <> '') AS p FROM a) SELECT c_custkey, p[-1] AS province, p[-2] AS ward, coalesce(p[-4], '') AS house, len(p) AS n_parts FROM s")
def address_split_tail(spark, d):
    whole = F.concat("house", F.lit(", "), "district", F.lit(",, "), "ward", F.lit(" , "), "city")
    parts = _address(spark, d).select("c_custkey", T.address_split(whole).alias("p"))
    return parts.select("c_custkey", T.part_from_end(F.col("p"), 1).alias("province"), T.part_from_end(F.col("p"), 2).alias("ward"), T.part_from_end(F.col("p"), 4).alias("house"), F.size("p").cast("long").alias("n_parts"))


_ACCENT_SQL = "replace(replace(strip_accents({0}), 'đ', 'd'), 'Đ', 'D')"


@query(f"SELECT doc_id, md5({_ACCENT_SQL.format('text')}) AS plain FROM documents")
def strip_diacritics(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.strip_accents("text")).alias("plain"))


@query("SELECT doc_id, md5(trim(regexp_replace(" + _ACCENT_SQL.format("regexp_replace(lower(text), '[^\\p{L}\\p{N}\\p{M}_\\s]', ' ', 'g')") + ", '\\s+', ' ', 'g'))) AS fuzzy_key FROM documents")
def fuzzy_key(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.fuzzy_key("text")).alias("fuzzy_key"))


@query("WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents) SELECT doc_id, md5(array_to_string(list_transform(list_filter(list_zip(l, generate_series(1, len(l))), lambda z: list_position(l, z[1]) = z[2]), lambda z: z[1]), ', ')) AS lines, len(list_distinct(l)) AS n_lines FROM s")
def clean_multiline_text(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.md5(T.clean_lines("text")).alias("lines"), F.size(F.array_distinct(T.address_split("text", "\n"))).cast("long").alias("n_lines"))


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(text) >= 12 AND NOT ends_with(text, '...') AND NOT ends_with(text, '..') AND NOT ends_with(text, ' -') AND NOT contains(text, 'CS1:') AND NOT contains(text, 'CS2:') AND (contains(lower(text), 'licens') OR contains(lower(text), 'token') OR contains(lower(text), 'mail'))")
def text_validity_filter(spark, d):
    return table(spark, d, "documents").where(T.valid_text(F.col("text"), ["licens", "token", "mail"])).select("doc_id", F.length("text").cast("long").alias("n"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(v, '^[\\p{Latin}\\p{M}0-9 /.,\\-()_\\t]+$') AND NOT contains(v, ',,') THEN v ELSE '' END AS tag FROM (SELECT p_partkey, regexp_replace(CASE p_partkey % 3 WHEN 0 THEN ' ' || p_name || ' ,' WHEN 1 THEN p_name || ',, ' || p_brand ELSE p_brand || '#' END, '^[ ,]+|[ ,]+$', '', 'g') AS v FROM part)")
def clean_tags(spark, d):
    k = F.col("p_partkey") % 3
    v = F.when(k == 0, F.concat(F.lit(" "), "p_name", F.lit(" ,"))).when(k == 1, F.concat("p_name", F.lit(",, "), "p_brand")).otherwise(F.concat("p_brand", F.lit("#")))
    return table(spark, d, "part").select("p_partkey", T.clean_tag(v).alias("tag"))


@query(f"WITH {_ADDRESS}, s AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN house || ' ' ELSE '' END || trim(street) AS line FROM a), c AS (SELECT c_custkey, {_CLEAN.format('line')} AS line FROM s) SELECT c_custkey, regexp_extract(line, '^(\\d+[\\w/\\-]*)(?:[,\\s]+)(.*)$', 1) AS house, CASE WHEN regexp_matches(line, '^(\\d+[\\w/\\-]*)(?:[,\\s]+)(.*)$') THEN trim(regexp_extract(line, '^(\\d+[\\w/\\-]*)(?:[,\\s]+)(.*)$', 2)) ELSE line END AS street FROM c")
def house_split(spark, d):
    line = F.concat(F.when(F.col("c_custkey") % 2 == 0, F.concat("house", F.lit(" "))).otherwise(""), F.trim("street"))
    a = _address(spark, d).select("c_custkey", line.alias("line"))
    house, street = T.split_house("line")
    return a.select("c_custkey", house.alias("house"), street.alias("street"))


@query(f"WITH {_ADDRESS}, f AS (SELECT c_custkey, trim(regexp_replace(" + _ACCENT_SQL.format("regexp_replace(lower(CASE WHEN c_custkey % 3 > 0 THEN c_custkey || CASE WHEN c_custkey % 2 = 0 THEN 'B' ELSE '' END || ', ' ELSE '' END || street), '[^\\p{L}\\p{N}\\p{M}_\\s]', ' ', 'g')") + ", '\\s+', ' ', 'g')) AS k FROM a) SELECT c_custkey, nullif(regexp_extract(k, '^[0-9]+[a-z]?(?:[/-][0-9]+[a-z]?)*\\b'), '') AS house, split_part(CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'way:' || c_custkey END, ':', 1) AS part, CASE WHEN c_custkey % 4 = 0 THEN 'unknown' ELSE 'way' END AS kind FROM f")
def house_keys(spark, d):
    """Leading house numbers of fuzzy keys, and the kinds of fingerprints."""
    k = F.col("c_custkey")
    line = F.concat(F.when(k % 3 > 0, F.concat(k.cast("string"), F.when(k % 2 == 0, "B").otherwise(""), F.lit(", "))).otherwise(""), "street")
    mark = F.when(k % 4 == 0, "").otherwise(_named("way:", k))
    return _address(spark, d).select("c_custkey", T.house_key(T.fuzzy_key(line)).alias("house"), F.split_part(mark, F.lit(":"), F.lit(1)).alias("part"), T.kind_before_colon(mark).alias("kind"))


_SCAN = "CASE c_custkey % 5 WHEN 0 THEN 'VM+ QNH 12 ' || c_name || chr(10) || c_mktsegment || chr(10) || c_mktsegment WHEN 1 THEN c_name || ', 0912.345.678 ,, ' || c_mktsegment WHEN 2 THEN '\"' || c_name || '\" ' || chr(10) || ' - ' || c_mktsegment || ' -.' WHEN 3 THEN 'CS1: ' || c_name || ' +84 91 2345 67890' ELSE '  ' || c_name || '  ' || chr(10) || chr(10) || c_name END"
_SCANNED = "array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ', ')"
for _pattern in (T.PHONE, *T.TILLS, "[\"']", r"(?U)^[,\-+.\s]+|[,\-+.\s]+$"):
    _SCANNED = f"regexp_replace({_SCANNED}, '{_pattern.replace('(?iuU)', '(?i)').replace('(?U)', '').replace(chr(39), chr(39) * 2)}', '', 'g')"
_SCANNED = f"trim(regexp_replace(regexp_replace({_SCANNED}, '\\s*,\\s*', ', ', 'g'), '\\s+', ' ', 'g'))"


@query(f"WITH s AS (SELECT c_custkey, list_filter(list_transform(string_split({_SCAN}, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM customer) SELECT c_custkey, {_SCANNED} AS address FROM s")
def receipt_cleaner(spark, d):
    """Names of customers as they might stand on receipts."""
    n, m, k = F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey") % 5
    parts = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    text = F.when(k == 0, parts("VM+ QNH 12 ", n, "\n", m, "\n", m)).when(k == 1, parts(n, ", 0912.345.678 ,, ", m)).when(k == 2, parts('"', n, '" \n - ', m, " -.")).when(k == 3, parts("CS1: ", n, " +84 91 2345 67890")).otherwise(parts("  ", n, "  \n\n", n))
    return table(spark, d, "customer").select("c_custkey", T.clean_receipt(text).alias("address"))


_MARKERS = {"mail": "@", "phone": r"\+1", "digits": "[0-9]{4}", "shout": "[A-Z]{6}", "licence": "(?i)licen[sc]e"}
_NONE = {"no_contact": ("mail", "phone"), "no_number": ("digits",)}
_M = ", ".join(f"count(*) FILTER (regexp_matches(t, '{p}')) AS {n}" for n, p in _MARKERS.items())


@query("WITH d AS (SELECT trim(text) AS t FROM documents WHERE trim(text) <> ''), c AS (SELECT count(*) AS total, " + _M + ", count(*) FILTER (NOT regexp_matches(t, '@') AND NOT regexp_matches(t, '\\+1')) AS no_contact, count(*) FILTER (NOT regexp_matches(t, '[0-9]{4}')) AS no_number FROM d) " + " UNION ALL ".join(f"SELECT '{'missing' if n in _NONE else 'marker'}' AS kind, '{n}' AS name, {n} AS n, total, round({n} / total, 6) AS rate FROM c" for n in (*_MARKERS, *_NONE)))
def noise_profile(spark, d):
    return profile.profile(table(spark, d, "documents"), "text", _MARKERS, _NONE)


_REGIONS = {"Bac": ["nation_1", "nation_2"], "Trung": ["building", "nation_3"], "Nam": ["nation_4", "machinery"]}


@query("SELECT c_custkey, CASE WHEN contains(t, 'nation_1') OR contains(t, 'nation_2') THEN 'Bac' WHEN contains(t, 'building') OR contains(t, 'nation_3') THEN 'Trung' WHEN contains(t, 'nation_4') OR contains(t, 'machinery') THEN 'Nam' ELSE 'Khac' END AS region FROM (SELECT c_custkey, lower(n_name || ' ' || c_mktsegment) AS t FROM customer JOIN nation ON n_nationkey = c_nationkey)")
def macro_region_case(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", T.region_of(F.concat_ws(" ", "n_name", "c_mktsegment"), _REGIONS, "Khac").alias("region"))


@query("SELECT o_orderkey, CASE WHEN v IN ('true', '1', 'yes') THEN true WHEN v IN ('false', '0', 'no') THEN false END AS flag, CASE WHEN v NOT IN ('true', '1', 'yes') THEN 'not_captured' WHEN w IN ('true', '1', 'yes') THEN 'changed' WHEN w IN ('false', '0', 'no') THEN 'unchanged' ELSE 'not_captured' END AS geometry FROM (SELECT o_orderkey, ['true', 'no', '1', '', 'YES'][o_orderkey % 5 + 1] AS v0, lower(v0) AS v, ['1', 'False', 'x'][o_orderkey % 3 + 1] AS w0, lower(w0) AS w FROM orders)")
def lenient_flags(spark, d):
    v = F.array(*[F.lit(x) for x in ("true", "no", "1", "", "YES")])[(F.col("o_orderkey") % 5).cast("int")]
    w = F.array(*[F.lit(x) for x in ("1", "False", "x")])[(F.col("o_orderkey") % 3).cast("int")]
    return table(spark, d, "orders").select("o_orderkey", T.lenient_bool(v).alias("flag"), audit.geometry_status(v, w).alias("geometry"))


# --- aliases ------------------------------------------------------------------------------------

_ALIASES = [("brand#11", "Brand One"), ("brand#12", "Brand One"), ("brand#21", "Brand Two"), ("brand#31", "brand#31")]
_ALIAS_SQL = "t(alias, name) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _ALIASES) + ")"


def _aliases(spark):
    return spark.createDataFrame(_ALIASES, "alias string, name string")


@query(f"WITH {_ALIAS_SQL} SELECT p_partkey, coalesce(name, {_CLEAN.format('p_brand')}) AS brand FROM part LEFT JOIN t ON alias = {_NORMAL.format('p_brand')}")
def alias_resolve(spark, d):
    out = alias.resolve(table(spark, d, "part").select("p_partkey", "p_brand"), {"p_brand": _aliases(spark)})
    return out.select("p_partkey", F.col("p_brand_Chuan").alias("brand"))


@query(f"WITH {_ALIAS_SQL}, r AS (SELECT p_partkey, {_CLEAN.format('p_brand')} AS a, coalesce(x.name, {_CLEAN.format('p_brand')}) AS b, {_CLEAN.format('p_type')} AS c, coalesce(y.name, {_CLEAN.format('p_type')}) AS e FROM part LEFT JOIN t x ON x.alias = {_NORMAL.format('p_brand')} LEFT JOIN t y ON y.alias = {_NORMAL.format('p_type')}) SELECT p_partkey, array_to_string(list_filter([CASE WHEN a <> b THEN 'p_brand: ' || a || ' → ' || b END, CASE WHEN c <> e THEN 'p_type: ' || c || ' → ' || e END], lambda x: x IS NOT NULL), ' | ') AS trace FROM r")
def alias_change_trace(spark, d):
    t = _aliases(spark)
    out = alias.resolve(table(spark, d, "part").select("p_partkey", "p_brand", "p_type"), {"p_brand": t, "p_type": t})
    return out.select("p_partkey", F.array_join(alias.trace(["p_brand", "p_type"]), " | ").alias("trace"))


# --- history ------------------------------------------------------------------------------------

_HISTORY = "h AS (SELECT user_id, arg_max_null(CASE WHEN value > 10 THEN event_type END, event_id) FILTER (ts <= TIMESTAMP '2024-01-15') AS old, arg_max_null(CASE WHEN value > 10 THEN event_type END, event_id) FILTER (ts > TIMESTAMP '2024-01-15') AS new FROM events GROUP BY user_id)"


def _states(spark, d):
    state = F.when(F.col("value") > 10, F.struct(F.col("event_type").alias("kind")))
    return history.before_after(table(spark, d, "events"), ["user_id"], "event_id", "ts", state, F.expr("TIMESTAMP_NTZ '2024-01-15'"))


@query(f"WITH {_HISTORY} SELECT user_id, old AS kind FROM h WHERE old IS NOT NULL")
def history_snapshot(spark, d):
    return _states(spark, d).where("old is not null").select("user_id", F.col("old.kind").alias("kind"))


@query(f"WITH {_HISTORY} SELECT user_id, old AS old_kind, new AS new_kind FROM h WHERE old <> new")
def history_diff(spark, d):
    return history.changed(_states(spark, d), ["kind"]).select("user_id", F.col("old.kind").alias("old_kind"), F.col("new.kind").alias("new_kind"))


#: Events as address states of users: fields by event, some without a state.
_STATES = """h AS (SELECT user_id, arg_max_null(s, event_id) FILTER (ts <= TIMESTAMP '2024-01-15') AS o, arg_max_null(s, event_id) FILTER (ts > TIMESTAMP '2024-01-15') AS n FROM (SELECT *, CASE WHEN value > 10 THEN {'house': CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(event_id % 50 AS VARCHAR) END, 'street': 'S ' || event_type, 'ward': 'W' || event_id % 3, 'district': 'D' || event_id % 2, 'city': 'nation_' || event_id % 6, 'full_address': 'A' || event_id, 'geometry': CASE WHEN event_id % 7 = 0 THEN '' ELSE 'g' || event_id % 5 END} END AS s FROM events) GROUP BY user_id)"""
_REGION_SQL = "CASE WHEN contains({0}, 'nation_1') OR contains({0}, 'nation_2') THEN 'Bac' WHEN contains({0}, 'building') OR contains({0}, 'nation_3') THEN 'Trung' WHEN contains({0}, 'nation_4') OR contains({0}, 'machinery') THEN 'Nam' ELSE 'Khac' END"


def _user_pairs(spark, d):
    e = F.col("event_id")
    fields = {"house": F.when(e % 3 == 0, "").otherwise((e % 50).cast("string")), "street": F.concat(F.lit("S "), "event_type"), "ward": _named("W", e % 3), "district": _named("D", e % 2), "city": _named("nation_", e % 6), "full_address": _named("A", e), "geometry": F.when(e % 7 == 0, "").otherwise(_named("g", e % 5))}
    state = F.when(F.col("value") > 10, F.struct(*[v.alias(k) for k, v in fields.items()]))
    pairs = history.before_after(table(spark, d, "events"), ["user_id"], "event_id", "ts", state, F.expr("TIMESTAMP_NTZ '2024-01-15'"))
    return pairs.select(F.lit("node").alias("osm_type"), F.col("user_id").alias("osm_id"), "old", "new")


@query(f"WITH {_STATES} SELECT 'node' AS \"OSM_Type\", CAST(user_id AS VARCHAR) AS \"OSM_ID\", o.house AS \"SoNha\", o.street AS \"TenDuong\", o.ward AS \"PhuongXa\", o.district AS \"QuanHuyen\", o.city AS \"TinhThanh\", o.full_address AS \"ChuoiDiaChi\", o.geometry AS \"HinhHoc\", {_REGION_SQL.format("(o.city || ' ' || lower(o.full_address))")} AS \"VungMien\" FROM h WHERE o IS NOT NULL")
def snapshot_columns(spark, d):
    return history.snapshot(_user_pairs(spark, d), _REGIONS)


_KNOWN = "(o.geometry <> '' AND n.geometry <> '')"


@query(f"WITH {_STATES}, c AS (SELECT *, CASE WHEN n.house <> '' THEN n.house ELSE o.house END AS house, CASE WHEN n.street <> '' THEN n.street ELSE o.street END AS street, CASE WHEN n.city <> '' THEN n.city ELSE o.city END AS city FROM h WHERE o IS NOT NULL AND n IS NOT NULL AND (o.ward <> n.ward OR o.district <> n.district OR o.city <> n.city)) SELECT 'node' AS \"OSM_Type\", CAST(user_id AS VARCHAR) AS \"OSM_ID\", house AS \"SoNha\", street AS \"TenDuong\", " + ", ".join(f'{s}.{a} AS "{b}_{t}"' for s, t in (("o", "Cu"), ("n", "Moi")) for a, b in (("ward", "PhuongXa"), ("district", "QuanHuyen"), ("city", "TinhThanh"), ("full_address", "DiaChi"))) + f", o.geometry AS \"HinhHoc_Cu\", n.geometry AS \"HinhHoc_Moi\", CASE WHEN {_KNOWN} THEN 'True' ELSE 'False' END AS \"HinhHocCoDuLieu\", CASE WHEN {_KNOWN} AND o.geometry <> n.geometry THEN 'True' ELSE 'False' END AS \"HinhHocThayDoi\", {_REGION_SQL.format('city')} AS \"VungMien\", 'events' AS \"Nguon\" FROM c")
def difference_columns(spark, d):
    return history.difference(_user_pairs(spark, d), _REGIONS, "events")


@query("SELECT l_orderkey, 'way:' || sha256(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey)) AS fingerprint FROM lineitem GROUP BY l_orderkey")
def geometry_fingerprint(spark, d):
    refs = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"])
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(refs.alias("refs")).select("l_orderkey", T.way_fingerprint(F.col("refs")).alias("fingerprint"))


@query(f"WITH {_HISTORY}, e AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events), w AS (SELECT event_id, CASE WHEN h.old IS NULL THEN 'not_in_old_snapshot' WHEN h.old <> e.event_type THEN 'type_changed' WHEN e.value < 20 THEN 'too_small' WHEN h.new IS NULL THEN 'no_new_state' ELSE 'accepted' END AS reason, e.user_id, e.event_type FROM e LEFT JOIN h ON h.user_id = e.user_id) SELECT event_id, CASE WHEN reason = 'accepted' AND row_number() OVER (PARTITION BY reason, user_id, event_type ORDER BY event_id) > 1 THEN 'duplicate' ELSE reason END AS reason FROM w")
def diff_audit_waterfall(spark, d):
    h = _states(spark, d).select(F.col("user_id").alias("k"), F.col("old.kind").alias("old"), F.col("new.kind").alias("new"))
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    rules = [("not_in_old_snapshot", F.col("old").isNull()), ("type_changed", F.col("old") != F.col("event_type")), ("too_small", F.col("value") < 20), ("no_new_state", F.col("new").isNull())]
    met = e.join(h, F.col("user_id") == F.col("k"), "left").withColumn("reason", audit.waterfall(rules, "accepted"))
    from pyspark.sql import Window as W

    again = F.row_number().over(W.partitionBy("reason", "user_id", "event_type").orderBy("event_id"))
    return met.withColumn("reason", F.when((F.col("reason") == "accepted") & (again > 1), "duplicate").otherwise(F.col("reason"))).select("event_id", "reason")


@query(f"WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY {_NORMAL.format('text')} ORDER BY doc_id) AS r FROM documents) SELECT doc_id, source FROM d WHERE r = 1")
def first_per_key_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2(T.normalise_text("text"), 256).alias("k"))
    return audit.first_per_key(docs, ["k"], ["doc_id"]).select("doc_id", "source")


# --- samples ------------------------------------------------------------------------------------

_H = "md5('42|' || doc_id)"


@query(f"WITH c AS (SELECT greatest(min(n), 100) AS cap FROM (SELECT count(*) AS n FROM documents GROUP BY lang)), r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_H}, doc_id) AS k FROM documents) SELECT doc_id, lang FROM r, c WHERE k <= cap")
def balanced_cap(spark, d):
    return history.capped(table(spark, d, "documents").select("doc_id", "lang"), "lang", F.col("doc_id"), 42)


@query(f"SELECT doc_id FROM documents ORDER BY {_H}, doc_id LIMIT 100")
def uniform_sample(spark, d):
    return sampling.uniform(table(spark, d, "documents").select("doc_id"), 100, 42, "doc_id")


@query(f"WITH r AS (SELECT doc_id, lang, {_H} AS h, row_number() OVER (PARTITION BY lang ORDER BY {_H}, doc_id) <> 1 AS later FROM documents) SELECT doc_id, lang FROM r ORDER BY later, h, doc_id LIMIT 50")
def stratified_reserve_sample(spark, d):
    return sampling.stratified(table(spark, d, "documents").select("doc_id", "lang"), 50, ["lang"], 42, "doc_id")


@query(f"WITH r AS (SELECT doc_id, lang, source, {_H} AS h, row_number() OVER (PARTITION BY lang, source ORDER BY {_H}, doc_id) <> 1 AS later FROM documents) SELECT doc_id, lang, source FROM r ORDER BY later, h, doc_id LIMIT (SELECT greatest(20, count(*)) FROM (SELECT DISTINCT lang, source FROM documents))")
def pilot_sample(spark, d):
    return sampling.stratified(table(spark, d, "documents").select("doc_id", "lang", "source"), 20, ["lang", "source"], 42, "doc_id", at_least_strata=True)


@query(f"WITH d AS (SELECT doc_id, lang, source, {_H} AS h FROM documents), en AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS r FROM d WHERE lang = 'en') WHERE r = 1 ORDER BY h, doc_id LIMIT 7), de AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS r FROM d WHERE lang = 'de' ) WHERE r = 1 AND source NOT IN (SELECT source FROM en) ORDER BY h, doc_id LIMIT 4), fr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS r FROM d WHERE lang = 'fr') WHERE r = 1 AND source NOT IN (SELECT source FROM en) AND source NOT IN (SELECT source FROM de) ORDER BY h, doc_id LIMIT 2) SELECT doc_id, lang, source FROM en UNION ALL SELECT doc_id, lang, source FROM de UNION ALL SELECT doc_id, lang, source FROM fr")
def quota_sample_chain(spark, d):
    return sampling.quota_chain(table(spark, d, "documents").select("doc_id", "lang", "source"), "lang", {"en": 7, "de": 4, "fr": 2}, "source", 42, "doc_id")


@query("SELECT c_custkey, format('N{:05d}', row_number() OVER (ORDER BY md5('7|' || c_custkey), c_custkey)) AS id FROM customer")
def numbered_ids(spark, d):
    return sampling.numbered(table(spark, d, "customer").select("c_custkey"), 7, "c_custkey", "N%05d", "id")


@query("SELECT c_custkey, CAST(('0x' || substr(md5('42|u|' || c_custkey), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u, ['a', 'b', 'c'][CAST(floor(CAST(('0x' || substr(md5('42|p|' || c_custkey), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE * 3) AS INTEGER) + 1] AS choice FROM customer")
def seeded_draws(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", T.draw(42, "u", k).alias("u"), T.pick(42, "p", ["a", "b", "c"], k).alias("choice"))


@query(f"WITH s AS (SELECT doc_id FROM documents ORDER BY {_H}, doc_id LIMIT 100) SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s)")
def sample_exclusion(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return sampling.excluding(docs, sampling.uniform(docs, 100, 42, "doc_id"), "doc_id")


# --- synthetic records --------------------------------------------------------------------------


def _records(spark, d):
    a = _address(spark, d)
    system = F.when(F.col("c_custkey") % 2 == 0, "moi").otherwise("cu")
    return a.select("c_custkey", F.col("house").alias("SoNha"), F.trim(F.regexp_replace("street", ",", "")).alias("TenDuong"), F.col("ward").alias("PhuongXa"), F.concat(F.lit("Quận "), F.col("c_nationkey").cast("string")).alias("QuanHuyen"), F.regexp_replace(F.regexp_replace("city", r" ,$", ""), "^TP\\.", "Tỉnh").alias("TinhThanh"), system.alias("HeQuyChieu"))


_U = "(CAST(('0x' || substr(md5('42|{0}|' || c_custkey), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"
_PICK = "[{1}][CAST(floor(" + _U + " * 3) AS INTEGER) + 1]"


@query(f"SELECT c_custkey, CASE WHEN {_U.format('ward_roll')} < 0.6 THEN {_PICK.format('ward_spelling', chr(39) + 'P. ' + chr(39) + ',' + chr(39) + 'P.' + chr(39) + ',' + chr(39) + 'P ' + chr(39))} || c_mktsegment WHEN {_U.format('ward_roll')} < 0.7 THEN {_PICK.format('ward_spelling', chr(39) + 'F. ' + chr(39) + ',' + chr(39) + 'F.' + chr(39) + ',' + chr(39) + 'F ' + chr(39))} || c_mktsegment WHEN {_U.format('ward_roll')} < 0.85 THEN c_mktsegment ELSE 'Phường  ' || c_mktsegment END AS ward FROM customer")
def abbreviate_prefix(spark, d):
    probs = {"ward_P": 0.6, "ward_F": 0.1}
    return _address(spark, d).select("c_custkey", synth.abbreviate(F.col("ward"), "ward", probs, 42, F.col("c_custkey").cast("string")).alias("ward"))


@query()
def noisy_text(spark, d):
    rates = {"drop_housenumber": 0.5, "drop_ward": 0.4, "drop_district": 0.3}
    return synth.noisy(_records(spark, d), "c_custkey", {}, rates).select("c_custkey", "ChuoiDiaChi", "ChuoiDiaChiGoc", "MucDoNhieu", "LoaiNhieu", "SoPhepBienDoi")


def _spelling(salt: str, letter: str) -> str:
    return _PICK.format(f"{salt}_spelling", f"'{letter}. ', '{letter}.', '{letter} '")


_LOST = f"""WITH {_ADDRESS}, r AS (SELECT c_custkey, house, {_CLEAN.format("trim(replace(street, ',', ''))")} AS street, {_CLEAN.format('ward')} AS ward, 'Quận ' || c_nationkey AS district, {_CLEAN.format("regexp_replace(regexp_replace(city, ' ,$', ''), '^TP\\.', 'Tỉnh')")} AS city, CASE WHEN c_custkey % 2 = 0 THEN 'moi' ELSE 'cu' END AS system FROM a),
w AS (SELECT *, 0.4::DOUBLE AS a, CASE WHEN system = 'cu' THEN 0.3::DOUBLE ELSE 0 END AS b, 0.2::DOUBLE AS c, 0.1::DOUBLE AS e FROM r),
k AS (SELECT *, {_U.format('kind')} * (a + b + c + e) AS spot FROM w),
m AS (SELECT *, CASE WHEN spot < a THEN 'drop_ward' WHEN spot < a + b AND b > 0 THEN 'drop_district' WHEN spot < a + b + c THEN 'drop_housenumber_ward' WHEN spot < a + b + c + e THEN 'drop_housenumber' END AS kind FROM k),
f AS (SELECT c_custkey, kind, system,
  CASE WHEN kind LIKE 'drop_housenumber%' THEN '' ELSE house END AS "SoNha", street AS "TenDuong",
  CASE WHEN kind IN ('drop_ward', 'drop_housenumber_ward') THEN '' WHEN {_U.format('ward_roll')} < 0.6 THEN {_spelling('ward', 'P')} || regexp_replace(ward, '(?i)^phường\\s+', '') WHEN {_U.format('ward_roll')} < 0.6::DOUBLE + 0.1::DOUBLE THEN {_spelling('ward', 'F')} || regexp_replace(ward, '(?i)^phường\\s+', '') WHEN {_U.format('ward_roll')} < 0.6::DOUBLE + 0.1::DOUBLE + 0.15::DOUBLE THEN regexp_replace(ward, '(?i)^phường\\s+', '') ELSE ward END AS "PhuongXa",
  CASE WHEN system = 'moi' OR kind = 'drop_district' THEN '' WHEN {_U.format('district_roll')} >= 0.75 THEN district ELSE {_spelling('district', 'Q')} || regexp_replace(district, '(?i)^quận\\s+', '') END AS "QuanHuyen",
  CASE WHEN {_U.format('city_roll')} >= 0.8 THEN city WHEN {_U.format('city_bare')} < 0.6 THEN regexp_replace(city, '(?i)^tỉnh\\s+', '') ELSE {_spelling('city', 'T')} || regexp_replace(city, '(?i)^tỉnh\\s+', '') END AS "TinhThanh" FROM m)
SELECT c_custkey, array_to_string(list_filter(["SoNha", "TenDuong", "PhuongXa", "QuanHuyen", "TinhThanh"], lambda x: x <> ''), ', ') AS "ChuoiDiaChi", kind AS "KieuThieu", system AS "HeQuyChieu", "SoNha", "TenDuong", "PhuongXa", "QuanHuyen", "TinhThanh" FROM f"""


@query(_LOST)
def missing_fields(spark, d):
    return synth.missing_fields(_records(spark, d), "c_custkey", {}).select("c_custkey", "ChuoiDiaChi", "KieuThieu", "HeQuyChieu", *T.FIELDS)


@query()
def hybrid_compose(spark, d):
    r = _records(spark, d)
    new = r.select(*[F.col(c) for c in ("PhuongXa", "QuanHuyen", "TinhThanh")]).distinct()
    wide = new.select(F.col("PhuongXa").alias(graph.COLUMNS[0]), F.col("QuanHuyen").alias(graph.COLUMNS[1]), F.col("TinhThanh").alias(graph.COLUMNS[2]), F.concat(F.col("TinhThanh"), F.lit(" mới")).alias(graph.COLUMNS[3]), F.concat(F.col("PhuongXa"), F.lit(" mới")).alias(graph.COLUMNS[4]), F.lit("Phường").alias(graph.COLUMNS[5]), F.lit("").alias(graph.COLUMNS[6]), F.lit("gop").alias(graph.COLUMNS[7]), F.lit("").alias(graph.COLUMNS[8]), F.xxhash64("PhuongXa", "QuanHuyen").alias("ord"))
    out = synth.hybrid_candidates(r.drop("HeQuyChieu"), graph.mapping_edges(wide))
    return out.select("c_custkey", "KieuLai", "ChuoiDiaChi", "Span_He_Detail", "QuanHe")


@query("WITH p AS (SELECT user_id AS node, min(event_type) AS old, max(event_type) AS new, min(event_id) AS o FROM events GROUP BY user_id), ob AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY old, new, node % 50 ORDER BY o) AS r FROM p WHERE node % 3 = 0 AND old <> new) WHERE r = 1), de AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY old, new, node % 50 ORDER BY o) AS r FROM p q WHERE old <> new AND node NOT IN (SELECT node FROM ob) AND NOT EXISTS (SELECT 1 FROM ob WHERE ob.old = q.old AND ob.new = q.new AND ob.node % 50 = q.node % 50)) WHERE r = 1) SELECT node, old || (node % 50) AS old, new || (node % 50) AS new, true AS observed FROM ob UNION ALL SELECT node, old || (node % 50), new || (node % 50), false FROM de")
def pair_builder(spark, d):
    tag = lambda c: F.concat(c, (F.col("user_id") % 50).cast("string"))
    p = table(spark, d, "events").groupBy("user_id").agg(F.min("event_type").alias("a"), F.max("event_type").alias("b"), F.min("event_id").alias("o"))
    p = p.where("a <> b").select(F.col("user_id").alias("node"), tag(F.col("a")).alias("old"), tag(F.col("b")).alias("new"), "o")
    return synth.pairs(p.where("node % 3 = 0"), p, "node", "old", "new", "o").select("node", "old", "new", "observed")


# --- scoring ------------------------------------------------------------------------------------

_FIELDS5 = ("SoNha", "TenDuong", "PhuongXa", "QuanHuyen", "TinhThanh")
_TRUTH = {"SoNha": "CASE WHEN l_quantity > 5 THEN CAST(l_linenumber AS VARCHAR(20)) ELSE '' END", "TenDuong": "l_returnflag", "PhuongXa": "CASE WHEN l_discount > 0.02 THEN l_linestatus ELSE '' END", "QuanHuyen": "CASE WHEN l_linenumber % 2 = 0 THEN 'x' ELSE '' END", "TinhThanh": "CAST(l_suppkey % 5 AS VARCHAR(20))"}
_PRED = {"SoNha": "CASE WHEN l_tax > 0.01 THEN CAST(l_linenumber AS VARCHAR(20)) ELSE '' END", "TenDuong": "CASE WHEN l_tax > 0.07 THEN 'Z' ELSE l_returnflag END", "PhuongXa": "CASE WHEN l_tax > 0.06 THEN 'Q' WHEN l_tax < 0.02 THEN '' ELSE l_linestatus END", "QuanHuyen": "CASE WHEN l_linenumber % 4 = 0 THEN 'x' WHEN l_linenumber = 3 THEN 'y' ELSE '' END", "TinhThanh": "CAST(CASE WHEN l_quantity > 45 THEN l_partkey ELSE l_suppkey END % 5 AS VARCHAR(20))"}


def _o(f: str) -> str:
    return f"CASE WHEN t_{f} = '' AND p_{f} = '' THEN 'TN' WHEN t_{f} = p_{f} THEN 'TP' WHEN t_{f} = '' THEN 'FP' WHEN p_{f} = '' THEN 'FN' ELSE 'MISMATCH' END"


def _n(*kinds: str) -> str:
    return "(" + " + ".join(f"CASE WHEN o_{f} IN ({', '.join(repr(k) for k in kinds)}) THEN 1 ELSE 0 END" for f in _FIELDS5) + ")"


_SCORED = (
    "v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_shipmode AS tool, l_quantity, "
    + ", ".join(f"lower({_TRUTH[f]}) AS t_{f}, lower({_PRED[f]}) AS p_{f}" for f in _FIELDS5)
    + " FROM (SELECT *, CASE WHEN l_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS l_shipmode FROM lineitem)), "
    + "c AS (SELECT *, " + ", ".join(f"{_o(f)} AS o_{f}" for f in _FIELDS5) + " FROM v), "
    + f"k AS (SELECT *, {_n('TP')} AS tp, {_n('FP', 'MISMATCH')} AS fp, {_n('FN', 'MISMATCH')} AS fn, {_n('FP')} AS pure, " + " + ".join(f"CASE WHEN t_{f} <> '' THEN 1 ELSE 0 END" for f in _FIELDS5) + " AS truths FROM c), "
    + "s AS (SELECT *, CASE WHEN truths = 0 THEN CASE WHEN fp = 0 THEN 'CORRECT' ELSE 'ERROR' END WHEN tp = truths AND fp = 0 THEN 'CORRECT' WHEN tp >= 2 THEN 'PARTIAL' ELSE 'ERROR' END AS status FROM k), "
    + "z AS (SELECT *, CASE WHEN status = 'CORRECT' THEN 'none' WHEN pure > 0 THEN 'hallucination_over_imputation' WHEN l_linenumber % 3 = 0 AND o_PhuongXa = 'MISMATCH' THEN 'wrong_target' WHEN fn > 0 AND tp > 0 THEN 'missing_field' WHEN tool = 'even' THEN 'abbreviation_misunderstood' ELSE 'parse_boundary_error' END AS error FROM s), "
    + "f AS (" + " UNION ALL ".join(f"SELECT tool, '{f}' AS field, o_{f} AS result FROM z" for f in _FIELDS5) + "), "
    + "m AS (SELECT tool, field, count(*) FILTER (result = 'TP') AS tp, count(*) FILTER (result = 'TN') AS tn, count(*) FILTER (result IN ('FP', 'MISMATCH')) AS fp, count(*) FILTER (result IN ('FN', 'MISMATCH')) AS fn, count(*) AS n FROM f GROUP BY tool, field)"
)


def _scored(spark, d):
    li = table(spark, d, "lineitem").withColumn("tool", F.when(F.col("l_orderkey") % 2 == 0, "even").otherwise("odd"))
    side = lambda m: F.struct(*[F.expr(m[f]).cast("string").alias(f) for f in _FIELDS5])
    scenario = F.when(F.col("l_linenumber") % 3 == 0, "A").otherwise("NONE")
    raw = F.when(F.col("tool") == "even", "P. x").otherwise("x")
    built = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), "tool", "l_quantity", side(_TRUTH).alias("truth"), side(_PRED).alias("pred"), scenario.alias("scenario"), raw.alias("raw"))
    return scoring.score(built)


def _outcomes(spark, d):
    return scoring.long_outcomes(_scored(spark, d), ["tool"])


@query(f"WITH {_SCORED} SELECT l_orderkey, l_linenumber, status, error FROM z")
def record_status(spark, d):
    return _scored(spark, d).select("l_orderkey", "l_linenumber", "status", "error")


@query(f"WITH {_SCORED} SELECT l_orderkey, l_linenumber, " + " || ".join(f"CASE o_{f} WHEN 'TN' THEN 't' WHEN 'TP' THEN 'm' WHEN 'FN' THEN 'o' ELSE 'x' END" for f in _FIELDS5) + " AS field_code FROM z")
def field_status_code(spark, d):
    return _scored(spark, d).select("l_orderkey", "l_linenumber", "field_code")


@query(f"WITH {_SCORED} SELECT tool, field, tp, tn, fp, fn, n, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END::DOUBLE AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END::DOUBLE AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END::DOUBLE AS f1, (tp + tn) / n AS accuracy FROM m")
def confusion_by_field(spark, d):
    return scoring.field_metrics(scoring.confusion(_outcomes(spark, d), ["tool", "field"]))


@query(f"WITH {_SCORED} SELECT tool, CAST(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS DOUBLE) AS micro_f1 FROM m GROUP BY tool")
def micro_f1(spark, d):
    return scoring.micro_f1(_outcomes(spark, d), ["tool"])


@query(f"WITH {_SCORED} SELECT tool, round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END), 9) AS macro_f1 FROM m GROUP BY tool")
def macro_f1(spark, d):
    return scoring.macro_f1(_outcomes(spark, d), ["tool"]).select("tool", F.round("macro_f1", 9).alias("macro_f1"))


@query(f"WITH {_SCORED} SELECT tool, count(*) AS total, count(*) FILTER (status = 'CORRECT') AS correct, count(*) FILTER (status = 'PARTIAL') AS partial, count(*) FILTER (status = 'ERROR') AS error, 0::BIGINT AS unsupported, count(*) FILTER (status = 'CORRECT') / count(*) AS correct_rate, count(*) FILTER (status = 'PARTIAL') / count(*) AS partial_rate, count(*) FILTER (status = 'ERROR') / count(*) AS error_rate, 0::DOUBLE AS unsupported_rate FROM z GROUP BY tool")
def status_rates(spark, d):
    return scoring.status_rates(_scored(spark, d), ["tool"])


@query(f"WITH {_SCORED} SELECT tool, error, count(*) AS n, count(*) / CAST(sum(count(*)) OVER (PARTITION BY tool) AS BIGINT) AS share FROM z GROUP BY tool, error")
def error_class_histogram(spark, d):
    return scoring.error_histogram(_scored(spark, d), ["tool"])


@query(f"WITH {_SCORED}, q AS (SELECT tool, count(*) AS n, count(*) FILTER (status = 'CORRECT') / count(*) AS p FROM z GROUP BY tool) SELECT tool, n, round(greatest(0, p - 1.959963984540054 * sqrt(p * (1 - p) / n)), 9) AS wald_low, round(least(1, p + 1.959963984540054 * sqrt(p * (1 - p) / n)), 9) AS wald_high, round(((p + 1.959963984540054 ^ 2 / (2 * n)) - 1.959963984540054 * sqrt(p * (1 - p) / n + 1.959963984540054 ^ 2 / (4 * n * n))) / (1 + 1.959963984540054 ^ 2 / n), 9) AS wilson_low FROM q")
def exact_rate_interval(spark, d):
    r = scoring.status_rates(_scored(spark, d), ["tool"])
    p, n = F.col("correct_rate"), F.col("total").cast("double")
    a, b = scoring.wald_interval(p, n)
    w, _ = scoring.wilson_interval(p, n)
    return r.select("tool", F.col("total").alias("n"), F.round(a, 9).alias("wald_low"), F.round(b, 9).alias("wald_high"), F.round(w, 9).alias("wilson_low"))


@query(f"WITH {_SCORED} SELECT tool, count(*) FILTER (error = 'missing_field') / count(*) AS missing_rate, count(*) FILTER (error = 'hallucination_over_imputation') / count(*) AS hallucination_rate FROM z GROUP BY tool")
def missing_hallucination_rates(spark, d):
    return scoring.missing_and_hallucination(_scored(spark, d), ["tool"])


@query(f"WITH {_SCORED}, x AS (SELECT l_linenumber AS kind, tool, CASE WHEN p_PhuongXa = '' THEN 'empty' WHEN p_PhuongXa = t_PhuongXa THEN 'correct' ELSE 'wrong' END AS w FROM z) SELECT tool, kind, count(*) FILTER (w = 'correct') AS correct, count(*) FILTER (w = 'wrong') AS wrong, count(*) FILTER (w = 'empty') AS empty, count(*) AS n FROM x GROUP BY GROUPING SETS ((tool, kind), (tool))")
def recovery_rollup(spark, d):
    s = _scored(spark, d).withColumn("kind", F.col("l_linenumber"))
    return scoring.recovery(s, ["tool"], "kind", F.lower("pred.PhuongXa"), F.lower("truth.PhuongXa"))


_CONDITION = "CASE l_linenumber WHEN 1 THEN 'Data 01|all' WHEN 2 THEN 'Data 02|clean' WHEN 3 THEN 'Data 02|noisy' WHEN 4 THEN 'Data 03|all' WHEN 5 THEN 'Data 04|surface_parse' WHEN 6 THEN CASE tool WHEN 'odd' THEN 'Data 06|libpostal' ELSE 'Data 06|vn_legacy' END ELSE 'Data 07|old_to_new' END"


def _run(spark, d):
    """Line numbers as data sets: IDs as a run writes them."""
    n, key = F.col("l_linenumber"), F.concat_ws("x", "l_orderkey", "l_partkey", "l_suppkey", "cents")
    name = F.when(n == 1, "D01_").when(n <= 3, "D02_").when(n == 4, "D03_").when(n == 5, "D04_").when(n == 6, "D06_").otherwise("D07_")
    tail = F.when(n == 2, "_clean").when(n == 3, "_noisy").when((n == 6) & (F.col("tool") == "even"), "_mleg").otherwise("")
    return _scored(spark, d).withColumn("ID", F.concat(name, key, tail))


_F1_SQL = "CASE WHEN sum(2 * {0} + {1} + {2}) > 0 THEN sum(2 * {0}) / sum(2 * {0} + {1} + {2}) END"


@query(f"WITH {_SCORED}, x AS (SELECT *, {_CONDITION} AS c FROM z), y AS (" + " UNION ALL ".join(f"SELECT c, tool, '{f}' AS field, o_{f} AS result FROM x" + ("" if f in metrics.PAIR_FIELDS else " WHERE l_linenumber < 7") for f in _FIELDS5) + f"), w AS (SELECT c, tool, field, count(*) FILTER (result = 'TP') AS tp, count(*) FILTER (result IN ('FP', 'MISMATCH')) AS fp, count(*) FILTER (result IN ('FN', 'MISMATCH')) AS fn FROM y GROUP BY ALL), v1 AS (SELECT c, tool, sum(2 * tp) / sum(2 * tp + fp + fn) AS micro, avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END) AS macro FROM w GROUP BY ALL) SELECT x.c AS dataset_condition, x.tool, count(*) AS n, count(*) FILTER (status = 'CORRECT') AS exact_correct, round(any_value(micro), 9) AS micro_f1_scored_fields, round(any_value(macro), 9) AS macro_mean_field_f1, count(*) FILTER (status = 'CORRECT') / count(*) AS exact_match_rate, CASE WHEN starts_with(x.c, 'Data 07') THEN 'PhuongXa,TinhThanh' ELSE '{','.join(_FIELDS5)}' END AS scored_fields FROM x JOIN v1 USING (c, tool) GROUP BY x.c, x.tool")
def exact_by_condition(spark, d):
    out = metrics.exact_by_condition(_run(spark, d), "odd")
    return out.withColumns({c: F.round(c, 9) for c in ("micro_f1_scored_fields", "macro_mean_field_f1")})


_PAIRED = "p AS (SELECT l_orderkey AS base, tool, bool_or(status = 'CORRECT') FILTER (l_linenumber = 1) AS clean, bool_or(status = 'CORRECT') FILTER (l_linenumber = 2) AS noisy, max(tp * 100 + fp * 10 + fn) FILTER (l_linenumber = 1) AS c0, max(tp * 100 + fp * 10 + fn) FILTER (l_linenumber = 2) AS n0, c0 // 100 AS ct, c0 // 10 % 10 AS cp, c0 % 10 AS cn, n0 // 100 AS nt, n0 // 10 % 10 AS np, n0 % 10 AS nn FROM (SELECT l_orderkey * 10 + (l_linenumber - 1) // 2 AS l_orderkey, 2 - l_linenumber % 2 AS l_linenumber, tool, status, tp, fp, fn FROM z) GROUP BY 1, 2), q AS (SELECT * FROM p WHERE clean IS NOT NULL AND noisy IS NOT NULL)"


def _pairs(spark, d):
    """Lines 1 and 2, 3 and 4, ... of an order as clean and noisy forms."""
    n = F.col("l_linenumber")
    base = F.col("l_orderkey") * 10 + F.floor((n - 1) / 2)
    s = _scored(spark, d).withColumn("ID", F.concat(F.lit("D02_"), base.cast("string"), F.when(n % 2 == 1, "_clean").otherwise("_noisy")))
    return metrics.paired(s)


@query(f"WITH {_SCORED}, {_PAIRED} SELECT tool, base % 3 AS level, count(*) AS n, count(*) FILTER (clean) AS clean_exact, count(*) FILTER (noisy) AS noisy_exact, round({_F1_SQL.format('ct', 'cp', 'cn')}, 9) AS clean_f1, round({_F1_SQL.format('nt', 'np', 'nn')}, 9) AS noisy_f1, count(*) FILTER (clean AND NOT noisy) AS flips, count(*) FILTER (NOT clean AND noisy) AS reverse_flips, round(100 * (1 - {_F1_SQL.format('nt', 'np', 'nn')} / {_F1_SQL.format('ct', 'cp', 'cn')}), 9) AS f1_drop_percent FROM q GROUP BY GROUPING SETS ((tool, base % 3), (tool))")
def robustness_flips(spark, d):
    p = _pairs(spark, d).where("clean is not null and noisy is not null").withColumn("level", F.col("base").cast("long") % 3)
    return metrics.robustness(p, "level").withColumns({c: F.round(c, 9) for c in ("clean_f1", "noisy_f1", "f1_drop_percent")})


@query(f"WITH {_SCORED}, {_PAIRED} SELECT 'unpaired' AS rule, base || '|' || tool AS key FROM p WHERE clean IS NULL OR noisy IS NULL")
def unpaired_forms(spark, d):
    return metrics.unpaired(_pairs(spark, d))


@query(f"WITH {_SCORED}, {_PAIRED}, y AS (SELECT *, unnest(CASE base % 3 WHEN 0 THEN ['viet_tat'] WHEN 1 THEN ['viet_tat', 'thieu_'] ELSE ['thieu_', 'bo_dau'] END) AS operation FROM q) SELECT tool, operation, count(*) AS n, count(*) FILTER (clean) AS clean_exact, count(*) FILTER (noisy) AS noisy_exact, round({_F1_SQL.format('ct', 'cp', 'cn')}, 9) AS clean_f1, round({_F1_SQL.format('nt', 'np', 'nn')}, 9) AS noisy_f1 FROM y GROUP BY tool, operation")
def robustness_by_operation(spark, d):
    k = F.col("base").cast("long") % 3
    ops = F.when(k == 0, "viet_tat").when(k == 1, "viet_tat|thieu_PhuongXa").otherwise("thieu_SoNha|bo_dau")
    p = _pairs(spark, d).where("clean is not null and noisy is not null")
    return metrics.by_operation(p, ops, ["viet_tat", "thieu_", "bo_dau"]).withColumns({c: F.round(c, 9) for c in ("clean_f1", "noisy_f1")})


@query(f"WITH {_SCORED} SELECT CASE WHEN l_linenumber > 4 THEN 'M-N' ELSE 'N-1' END AS relation, count(*) AS n, count(*) FILTER (status = 'CORRECT') AS correct, count(*) - count(*) FILTER (status = 'CORRECT') - count(*) FILTER (p_PhuongXa = '') AS wrong_target, count(*) FILTER (p_PhuongXa = '') AS empty FROM z GROUP BY 1")
def conversion_outcomes(spark, d):
    s = _scored(spark, d).withColumn("relation", F.when(F.col("l_linenumber") > 4, "M-N").otherwise("N-1"))
    return metrics.conversion_outcomes(s, "relation", "status", F.col("pred.PhuongXa"))


@query("SELECT l_returnflag AS tool, CASE WHEN l_tax > 0.05 THEN 'error' ELSE 'success' END AS status, count(*) AS n FROM lineitem GROUP BY 1, 2")
def call_status_counts(spark, d):
    return metrics.call_status(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("tool"), F.when(F.col("l_tax") > 0.05, "error").otherwise("success").alias("status")))


@query(f"WITH {_SCORED} SELECT tool, CASE l_linenumber % 3 WHEN 0 THEN 'FROM_2025' WHEN 1 THEN 'LEGACY' ELSE 'single parse' END AS mode, 'C' || (l_suppkey % 3 + 1) AS kind, count(*) AS n, count(*) FILTER (status = 'CORRECT') AS exact FROM z GROUP BY ALL")
def hybrid_exact(spark, d):
    k = F.col("l_linenumber") % 3
    s = _scored(spark, d).withColumn("ID", F.concat(F.lit("D06_"), F.col("l_orderkey").cast("string"), F.when(k == 0, "_m25").when(k == 1, "_mleg").otherwise("")))
    return metrics.hybrid_exact(s, F.concat(F.lit("C"), (F.col("l_suppkey") % 3 + 1).cast("string"), F.lit("_kind")))


def _hybrid_rows(spark, d):
    k = F.col("p_partkey")
    spans = F.when(k % 7 == 0, '{"PhuongXa":"cu","QuanHuyen":"cu","TinhThanh":"cu"}').when(k % 2 == 0, '{"PhuongXa":"moi","QuanHuyen":"cu","TinhThanh":"cu"}').otherwise('{"PhuongXa":"cu","QuanHuyen":"cu","TinhThanh":"moi"}')
    return table(spark, d, "part").select(F.when(k % 2 == 0, "C1_x").otherwise("C3_y").alias("KieuLai"), spans.alias("Span_He_Detail"), F.when(k % 11 == 0, " ").otherwise("Q").alias("QuanHuyen"))


@query("WITH x AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'C1' ELSE 'C3' END AS k, p_partkey % 7 = 0 AS bad, p_partkey % 11 = 0 AS blank FROM part), e(k, a, b, c) AS (VALUES ('C1', 'moi', 'cu', 'cu'), ('C2', 'moi', 'cu', 'moi'), ('C3', 'cu', 'cu', 'moi')) SELECT k AS \"KieuLai\", a AS \"PhuongXa_he\", b AS \"QuanHuyen_he\", c AS \"TinhThanh_he\", count(x.bad) AS n, count(*) FILTER (bad) AS other_spans, count(*) FILTER (blank) AS no_district FROM e LEFT JOIN x USING (k) GROUP BY ALL")
def hybrid_contract(spark, d):
    return metrics.hybrid_contract(_hybrid_rows(spark, d))


@query("SELECT o_orderpriority AS \"QuanHe\", count(*) AS n, 'old_to_new' AS direction_evaluated, 'PhuongXa,TinhThanh' AS scored_fields FROM orders GROUP BY 1")
def scope_table(spark, d):
    return metrics.scope(table(spark, d, "orders").select(F.col("o_orderpriority").alias("QuanHe")))


@query("SELECT o_orderstatus AS system, o_orderpriority AS kind, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus))")
def system_kind_counts(spark, d):
    return metrics.system_kinds(table(spark, d, "orders").select(F.col("o_orderstatus").alias("system"), F.col("o_orderpriority").alias("kind")), "system", "kind")


@query(f"WITH {_SCORED} SELECT l_partkey AS part, status, p_brand AS brand FROM z JOIN part ON p_partkey = l_partkey")
def prediction_metadata(spark, d):
    s = _scored(spark, d).withColumn("ID", F.concat_ws("_", F.lit("D04"), "l_partkey", "l_orderkey"))
    return metrics.with_metadata(s, table(spark, d, "part"), "D04_", "p_partkey", "p_brand").select(F.col("l_partkey").alias("part"), "status", F.col("p_brand").alias("brand"))


@query(f"WITH {_SCORED} SELECT l_orderkey, l_linenumber, CASE error WHEN 'none' THEN '' WHEN 'hallucination_over_imputation' THEN '|{scoring.NOTES['hallucination_over_imputation']}' || array_to_string(list_filter([" + ", ".join(f"CASE WHEN o_{f} = 'FP' THEN '{f}' END" for f in _FIELDS5) + "], lambda x: x IS NOT NULL), ', ')" + "".join(f" WHEN '{k}' THEN '|{v}'" for k, v in scoring.NOTES.items() if k != "hallucination_over_imputation") + " END AS note FROM z")
def record_notes(spark, d):
    return _scored(spark, d).select("l_orderkey", "l_linenumber", "note")


@query(f"WITH {_SCORED}, x AS (SELECT unnest(string_split(CASE l_linenumber % 3 WHEN 0 THEN 'a|b' WHEN 1 THEN 'b' ELSE 'a|b|c' END, '|')) AS label, status = 'CORRECT' AS ok FROM z) SELECT label, count(*) AS n, count(*) FILTER (ok) AS exact FROM x GROUP BY label")
def overlapping_labels(spark, d):
    k = F.col("l_linenumber") % 3
    s = _scored(spark, d).withColumn("ok", F.col("status") == "CORRECT").withColumn("ops", F.when(k == 0, "a|b").when(k == 1, "b").otherwise("a|b|c"))
    return scoring.by_label(s, F.split("ops", r"\|"), "ok")


@query("WITH p AS (SELECT l.doc_id, quality = CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS a, quality = CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS b FROM labels l JOIN documents d ON d.doc_id = l.doc_id), t AS (SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (NOT a AND b) AS only_b, count(*) FILTER (NOT a AND NOT b) AS neither FROM p) SELECT *, CASE WHEN only_a + only_b > 0 THEN CAST(abs(only_a - only_b) - 1 AS DOUBLE) ^ 2 / (only_a + only_b) ELSE 0 END AS statistic FROM t")
def mcnemar_paired(spark, d):
    met = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    p = met.select((F.col("quality") == (F.col("n_chars") > 1000).cast("int")).alias("a"), (F.col("quality") == (F.col("lang") == "en").cast("int")).alias("b"))
    return scoring.mcnemar(p, "a", "b")


_TAIL = "CASE WHEN z < 2 THEN 1 - exp(-z * z) * list_sum(list_transform(generate_series(0, 79), lambda n: z ^ (2 * n + 1) / gamma(n + 1.5))) ELSE exp(-z * z) / sqrt(pi()) / list_reduce(list_prepend(z, generate_series(80, 1, -1)::DOUBLE[]), lambda a, n: z + n / 2 / a) END"


@query(f"WITH p AS (SELECT source, quality = CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS a, quality = CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS b FROM labels l JOIN documents d ON d.doc_id = l.doc_id), t AS (SELECT source, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (NOT a AND b) AS only_b FROM p GROUP BY source), s AS (SELECT *, CASE WHEN only_a + only_b > 0 THEN CAST(abs(only_a - only_b) - 1 AS DOUBLE) ^ 2 / (only_a + only_b) ELSE 0 END AS statistic FROM t), z AS (SELECT *, sqrt(statistic / 2) AS z FROM s) SELECT source, only_a, only_b, round(log10({_TAIL}), 8) + 0.0 AS log_p FROM z")
def mcnemar_p_values(spark, d):
    met = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "n_chars", "lang"), "doc_id")
    p = met.select("source", (F.col("quality") == (F.col("n_chars") > 1000).cast("int")).alias("a"), (F.col("quality") == (F.col("lang") == "en").cast("int")).alias("b"))
    return scoring.with_p_value(scoring.mcnemar(p, "a", "b", ("source",))).select("source", "only_a", "only_b", (F.round(F.log10("p_value"), 8) + 0.0).alias("log_p"))


# --- coverage and contracts ---------------------------------------------------------------------

_STATUS, _PRIORITY = ["F", "O", "P", "X"], ["1-URGENT", "2-HIGH", "9-NONE"]


@query("WITH s AS (SELECT 'status' AS axis, o_orderstatus AS category FROM orders UNION ALL SELECT 'priority', o_orderpriority FROM orders), c AS (SELECT axis, category, count(*) AS n FROM s GROUP BY ALL), e(axis, category) AS (VALUES ('status', 'F'), ('status', 'O'), ('status', 'P'), ('status', 'X'), ('priority', '1-URGENT'), ('priority', '2-HIGH'), ('priority', '9-NONE')) SELECT coalesce(c.axis, e.axis) AS axis, coalesce(c.category, e.category) AS category, coalesce(n, 0) AS n FROM c FULL JOIN e ON c.axis = e.axis AND c.category = e.category")
def coverage_zero_fill(spark, d):
    return coverage.axis_counts(table(spark, d, "orders"), {"status": (F.col("o_orderstatus"), _STATUS), "priority": (F.col("o_orderpriority"), _PRIORITY)})


@query("SELECT p_brand AS value, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, value LIMIT 10")
def coverage_top_values(spark, d):
    return coverage.top_values(table(spark, d, "part"), F.col("p_brand"))


@query("WITH e(s) AS (VALUES ('F'), ('O'), ('P'), ('X')), g AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1) SELECT coalesce(e.s, g.s) AS subject, coalesce(n, 0) AS n FROM e FULL JOIN g ON e.s = g.s")
def direct_counts(spark, d):
    return coverage.direct_counts(table(spark, d, "orders"), F.col("o_totalprice") > 100000, "o_orderstatus", _STATUS)


@query("WITH t AS (SELECT count(*) AS total, count(*) FILTER (o_totalprice <= 100000) AS derived, count(*) FILTER (o_orderpriority = '1-URGENT') AS low FROM orders), g AS (SELECT s AS subject, count(*) FILTER (o_totalprice > 100000) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) v(s) LEFT JOIN orders ON o_orderstatus = s GROUP BY s) SELECT 'no_direct_sample' AS rule, subject, 0::BIGINT AS n, total FROM g, t WHERE n = 0 UNION ALL SELECT 'derived_rows', '', derived, total FROM t WHERE derived > 0 UNION ALL SELECT 'low_share', '', low, total FROM t WHERE low < 0.5 * total")
def coverage_warnings(spark, d):
    return coverage.warnings(table(spark, d, "orders"), F.col("o_totalprice") > 100000, "o_orderstatus", _STATUS, (F.col("o_orderpriority") == "1-URGENT", 0.5))


@query("SELECT 'quantity' AS rule, l_orderkey || '-' || l_linenumber AS key FROM lineitem WHERE NOT l_quantity < 50 UNION ALL SELECT 'discount', l_orderkey || '-' || l_linenumber FROM lineitem WHERE NOT (l_discount <= 0.09) UNION ALL SELECT 'flag', l_orderkey || '-' || l_linenumber FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') AND l_tax > 0.07")
def contract_violations(spark, d):
    c = F.col
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    return contracts.row_rules(table(spark, d, "lineitem"), key, {"quantity": c("l_quantity") < 50, "discount": c("l_discount") <= 0.09, "flag": c("l_returnflag").isin("A", "N") | (c("l_tax") <= 0.07)})


@query("SELECT 'conflict' AS rule, p_brand AS key FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) > 1 OR count(DISTINCT p_size) > 1")
def code_conflicts(spark, d):
    return contracts.conflicts(table(spark, d, "part"), "p_brand", "p_type", "p_size")


@query("SELECT 'unique' AS rule, text AS key FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def uniqueness(spark, d):
    return contracts.unique(table(spark, d, "documents").where("text is not null"), "text")


_TABLE4 = "a4 AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'cu' ELSE 'moi' END AS s, ['drop_ward', 'drop_district', 'drop_housenumber', 'other'][c_custkey % 4 + 1] AS k, 'a' || c_custkey // 2 AS address, c_custkey % 5 <> 0 AS ward, c_custkey % 3 <> 0 AS district FROM customer)"


@query(f"WITH {_TABLE4}, v AS (SELECT address AS key, unnest(list_filter([CASE WHEN k = 'other' THEN 'kind' END, CASE WHEN (CASE k WHEN 'drop_ward' THEN ward ELSE NOT ward END) OR (CASE WHEN k = 'drop_district' OR s = 'moi' THEN district ELSE NOT district END) OR k = 'drop_housenumber' THEN 'fields' END, CASE WHEN s = 'moi' THEN 'truth' END, CASE WHEN s = 'moi' AND k = 'drop_district' THEN 'no_district_to_drop' END], lambda x: x IS NOT NULL)) AS rule FROM a4) SELECT rule, key FROM v UNION ALL SELECT 'unique_ChuoiDiaChi', address FROM a4 GROUP BY address HAVING count(*) > 1 UNION ALL SELECT 'row_count', CAST(count(*) AS VARCHAR) FROM a4 HAVING count(*) <> 800 UNION ALL SELECT 'halves', s || '|' || count(*) FROM a4 GROUP BY s HAVING count(*) <> 400")
def benchmark_contract(spark, d):
    """Table 04's contract on rows that break most of its rules."""
    k = F.col("c_custkey")
    kind = F.array(*[F.lit(x) for x in ("drop_ward", "drop_district", "drop_housenumber", "other")])[(k % 4).cast("int")]
    full = {f: F.lit("x") for f in T.FIELDS}
    surface = {**full, "PhuongXa": F.when(k % 5 != 0, "x").otherwise(""), "QuanHuyen": F.when(k % 3 != 0, "x").otherwise(" ")}
    rows = table(spark, d, "customer").select(_named("a", F.floor(k / 2)).alias("ChuoiDiaChi"), *[v.alias(f) for f, v in surface.items()], *[v.alias(f"GT_{f}") for f, v in full.items()], kind.alias("KieuThieu"), F.when(k % 2 == 0, "cu").otherwise("moi").alias("HeQuyChieu"))
    return contracts.benchmark_violations("04", rows, 800)


@query("SELECT DISTINCT 'domain' AS rule, o_orderpriority AS key FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '9-NONE') UNION ALL SELECT 'domain', s FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('9-NONE')) v(s) WHERE s NOT IN (SELECT o_orderpriority FROM orders)")
def label_domain(spark, d):
    return contracts.domain(table(spark, d, "orders"), "o_orderpriority", _PRIORITY, complete=True)


@query("SELECT DISTINCT 'reference' AS rule, CAST(o_custkey AS VARCHAR) AS key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def reference_check(spark, d):
    good = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("k"))
    return contracts.reference(table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("k")), good, ["k"])


@query("SELECT 'same_keys' AS rule, CAST(coalesce(a.k, b.k) AS VARCHAR) AS key FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def same_key_sets(spark, d):
    return contracts.same_keys(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), ["k"])


# --- cases, parser, explorer --------------------------------------------------------------------


def _predictions(spark, d):
    s = _scored(spark, d)
    rid = F.concat_ws("_", F.format_string("D%02d", F.col("l_linenumber")), F.format_string("%08d", F.col("l_orderkey")), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("cents").cast("string"))
    return s.select(rid.alias("ID"), F.col("tool").alias("CongCu"), F.col("raw").alias("DiaChiGoc"), F.to_json("pred").alias("TruongDuDoan"), F.to_json("truth").alias("TruongDung"), F.col("status").alias("DungSai"), F.col("error").alias("LoaiLoi"), F.col("scenario").alias("TinhHuongMoHo"), F.lit("").alias("GhiChu"))


def _raw_of(p):
    return p.select(F.col("ID").alias("id"), F.col("CongCu").alias("tool"), F.col("DiaChiGoc").alias("input"), F.lit("success").alias("status"))


@query(f"WITH {_SCORED}, i AS (SELECT format('D{{:02d}}_{{:08d}}_{{}}_{{}}_{{}}', l_linenumber, l_orderkey, l_partkey, l_suppkey, cents) AS ID, tool AS CongCu, format('D{{:02d}}', l_linenumber) AS Dataset, error AS LoaiLoi, status AS DungSai FROM z WHERE error <> 'none') SELECT ID, CongCu, Dataset, LoaiLoi, DungSai, 'success' AS RawStatus FROM i QUALIFY row_number() OVER (PARTITION BY Dataset, CongCu, LoaiLoi ORDER BY ID) <= 3")
def case_selection_topk(spark, d):
    p = _predictions(spark, d)
    return cases.select(p, _raw_of(p), 3).select("ID", "CongCu", "Dataset", "LoaiLoi", "DungSai", "RawStatus")


@query(f"WITH {_SCORED}, i AS (SELECT format('D{{:02d}}_{{:08d}}_{{}}_{{}}_{{}}', l_linenumber, l_orderkey, l_partkey, l_suppkey, cents) AS ID, tool AS CongCu, format('D{{:02d}}', l_linenumber) AS Dataset, error AS LoaiLoi FROM z WHERE error <> 'none'), y AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY Dataset, CongCu, LoaiLoi ORDER BY ID) <= 3) SELECT 'not_a_projection' AS rule, ID || '|' || CongCu AS key FROM y WHERE CongCu = 'even' AND Dataset = 'D01'")
def case_projection_proof(spark, d):
    p = _predictions(spark, d)
    r = _raw_of(p)
    picked = cases.select(p, r, 3)
    edited = picked.withColumn("GhiChu", F.when((F.col("CongCu") == "even") & (F.col("Dataset") == "D01"), "edited").otherwise(F.col("GhiChu")))
    return cases.proof(edited, p, r, checked=True)  # by select, on the same tables


_RAW_SQL = "q AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN house || ', ' || trim(street) || ward || ', ' || 'Q. ' || c_nationkey || ', ' || city WHEN 1 THEN house || ' ' || trim(street) || city WHEN 2 THEN trim(street) || ward || ';' || city WHEN 3 THEN trim(street) || ward || ', ' || district || chr(10) || city WHEN 4 THEN ' , ' ELSE c_custkey || ', Road, ' || ward || ', Quan 1, ' || city END AS raw FROM a)"


def _raws(spark, d):
    k = F.col("c_custkey") % 6
    s = F.trim("street")
    j = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) and v not in ("house", "ward", "city", "district") else v for v in x])
    raw = F.when(k == 0, j("house", ", ", s, "ward", ", ", "Q. ", F.col("c_nationkey").cast("string"), ", ", "city")).when(k == 1, j("house", " ", s, "city")).when(k == 2, j(s, "ward", ";", "city")).when(k == 3, j(s, "ward", ", ", "district", "\n", "city")).when(k == 4, F.lit(" , ")).otherwise(j(F.col("c_custkey").cast("string"), ", Road, ", "ward", ", Quan 1, ", "city"))
    return _address(spark, d).select("c_custkey", raw.alias("raw"))


@query(
    f"WITH {_ADDRESS}, {_RAW_SQL}, p AS (SELECT c_custkey, trim(raw, ' ' || chr(10)) AS raw, list_filter(list_transform(regexp_split_to_array(trim(raw, ' ' || chr(10)), '[,;\\n]+'), lambda x: trim(x)), lambda x: x <> '') AS t FROM q), "
    "b AS (SELECT *, len(t) AS n, CASE WHEN len(t) >= 5 THEN t[2] WHEN len(t) >= 2 THEN t[1] ELSE '' END AS road0, CASE WHEN len(t) >= 5 AND regexp_matches(t[1], '^\\d+[\\w/\\-]*$') THEN t[1] ELSE '' END AS house0, CASE WHEN len(t) >= 5 THEN t[-4] WHEN len(t) = 4 THEN t[-3] WHEN len(t) = 3 THEN t[2] ELSE '' END AS ward0, CASE WHEN len(t) >= 5 THEN t[-3] ELSE '' END AS cd0, CASE WHEN len(t) >= 4 THEN t[-2] ELSE '' END AS city0 FROM p), "
    "h AS (SELECT *, house0 = '' AND regexp_matches(road0, '^(\\d+[\\w/\\-]*)\\s+(.+)$') AS sp, regexp_matches(raw, '(?i)\\b(?:[PQ]|TP|TX|TT)\\.?\\s*\\d+') OR regexp_matches(raw, '\\b(?:P\\.|Q\\.|TP\\.|TX\\.|TT\\.)\\s*[A-ZÀ-ỹ]') AS short, regexp_matches(raw, '^\\s*\\d+[\\w]*[/-]\\d+') OR regexp_matches(raw, '(?i)(^|[^\\p{L}\\p{N}_])(?:ngõ|ngách|hẻm)([^\\p{L}\\p{N}_]|$)') AS hard FROM b), "
    "r AS (SELECT *, CASE WHEN sp THEN regexp_extract(road0, '^(\\d+[\\w/\\-]*)\\s+(.+)$', 1) ELSE house0 END AS house1, CASE WHEN sp THEN trim(regexp_extract(road0, '^(\\d+[\\w/\\-]*)\\s+(.+)$', 2)) ELSE road0 END AS road1 FROM h), "
    "w AS (SELECT *, CASE WHEN short AND (contains(cd0, 'Q.') OR contains(city0, 'Q.')) THEN '' ELSE cd0 END AS cd1 FROM r) "
    "SELECT c_custkey, CASE WHEN hard THEN '' ELSE house1 END AS \"SoNha\", road1 AS \"TenDuong\", CASE WHEN short AND (contains(ward0, 'P.') OR contains(road1, 'P.')) THEN '' ELSE ward0 END AS \"PhuongXa\", CASE WHEN cd1 <> '' THEN cd1 ELSE city0 END AS \"QuanHuyen\", CASE WHEN n >= 1 THEN t[-1] ELSE '' END AS \"TinhThanh\" FROM w"
)
def heuristic_parse(spark, d):
    return parser.heuristic(_raws(spark, d), "raw").select("c_custkey", "pred.*")


@query("WITH f AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND contains(lower(o_orderpriority || chr(10) || o_orderkey), 'u')) SELECT * FROM f ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def explorer_filter_page(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return explore.page(explore.search(o, "U", ["o_orderpriority", "o_orderkey"]), [F.desc("o_totalprice"), "o_orderkey"], 3, 25)


@query("WITH f AS (SELECT * FROM orders WHERE o_orderstatus = 'O' AND contains(lower(o_orderpriority || chr(10) || o_orderkey), 'u')) SELECT 'o_orderpriority' AS facet, o_orderpriority AS option, count(*) AS n FROM f GROUP BY ALL UNION ALL SELECT 'o_custkey', o_custkey::VARCHAR, count(*) FROM f GROUP BY ALL UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM f GROUP BY ALL")
def facet_counts(spark, d):
    """The option lists under a filter."""
    o = table(spark, d, "orders").where("o_orderstatus = 'O'")
    return explore.facets(explore.search(o, "U", ["o_orderpriority", "o_orderkey"]), ["o_orderpriority", "o_custkey", "o_orderstatus"])


@query("SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders WHERE (o_orderpriority, o_orderkey) > ('2-HIGH', 1000) ORDER BY o_orderpriority, o_orderkey LIMIT 50")
def seek_page(spark, d):
    """The page after a given row."""
    return explore.seek(table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice"), ["o_orderpriority", "o_orderkey"], ("2-HIGH", 1000), 50)


@query("SELECT format('D01_{:04d}', o_orderkey) AS id, 'D01' AS dataset, format('{:04d}', o_orderkey) AS base FROM orders")
def id_format(spark, d):
    rid = table(spark, d, "orders").select(protocol.record_id("D01", F.col("o_orderkey")).alias("id"))
    return rid.select("id", cases.dataset_of(F.col("id")).alias("dataset"), F.regexp_extract("id", r"D01_([^_]+)", 1).alias("base"))


@query("SELECT o_custkey AS k, 'order' AS side FROM (SELECT DISTINCT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'idle' FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def set_ops_union_except(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    idle = sampling.excluding(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), o, "k")
    return o.withColumn("side", F.lit("order")).unionByName(idle.withColumn("side", F.lit("idle")))


@query()
def fuzzy_dedup(spark, d):
    """The composed addresses of all customers, as receipts hold them; a house number is a block."""
    whole = T.address_join("house", T.clean_value("street"), "ward", "district", T.clean_value("city"))
    return receipts.fuzzy_dedup(_address(spark, d).select("c_custkey", whole.alias("line")), "line", "c_custkey")


@query("SELECT a.p_partkey AS a, b.p_partkey AS b, levenshtein(a.p_name, b.p_name) AS distance FROM part a JOIN part b ON a.p_size = b.p_size AND a.p_partkey < b.p_partkey WHERE levenshtein(a.p_name, b.p_name) <= 1")
def close_pairs(spark, d):
    return receipts.close_pairs(table(spark, d, "part"), "p_size", "p_partkey", "p_name", 1).select("a", "b", F.col("distance").cast("long").alias("distance"))


@query("WITH p AS (SELECT l_orderkey || '-' || ((l_linenumber + 1) // 2) AS id, CASE WHEN l_linenumber % 2 = 1 THEN 'a' ELSE 'b' END AS tool, CASE WHEN l_tax > 0.03 THEN 'CORRECT' ELSE 'ERROR' END AS st FROM lineitem) SELECT i.id AS \"ID\", coalesce(a.st, 'NONE') AS first, coalesce(b.st, 'NONE') AS second, CASE WHEN a.st = 'CORRECT' AND b.st = 'CORRECT' THEN 'both' WHEN a.st = 'CORRECT' THEN 'first_only' WHEN b.st = 'CORRECT' THEN 'second_only' ELSE 'neither' END AS comparison FROM (SELECT DISTINCT id FROM p) i LEFT JOIN p a ON a.id = i.id AND a.tool = 'a' LEFT JOIN p b ON b.id = i.id AND b.tool = 'b'")
def tool_pairing(spark, d):
    """Lines 1 and 2, 3 and 4, ... of an order stand for the two tools, so that every line takes part."""
    rid = F.concat_ws("-", "l_orderkey", F.floor((F.col("l_linenumber") + 1) / 2))
    p = table(spark, d, "lineitem").select(rid.alias("ID"), F.when(F.col("l_linenumber") % 2 == 1, "a").otherwise("b").alias("CongCu"), F.when(F.col("l_tax") > 0.03, "CORRECT").otherwise("ERROR").alias("DungSai"), F.lit("").alias("DiaChiGoc"), F.lit("").alias("TruongDung"))
    return explore.tool_pairs(p, "a", "b").select("ID", "first", "second", "comparison")


_REVIEWED = "p AS (SELECT 'D0' || (1 + l_orderkey % 3) || '_' || l_orderkey || '-' || ((l_linenumber + 1) // 2) AS id, 'D0' || (1 + l_orderkey % 3) AS dataset, l_linenumber % 2 AS a, CASE WHEN l_tax > 0.03 THEN 'CORRECT' ELSE 'ERROR' END AS st, CASE WHEN l_tax > 0.03 THEN 'none' WHEN l_discount > 0.05 THEN 'missing_field' ELSE 'wrong_target' END AS err, l_shipdate::DATE::VARCHAR AS note FROM lineitem), t AS (SELECT id, any_value(dataset) AS dataset, list(err) AS errs, string_agg(note, ' ') AS notes FROM p GROUP BY id), r AS (SELECT t.*, coalesce(x.st, 'NONE') AS first, coalesce(y.st, 'NONE') AS second FROM t LEFT JOIN p x ON x.id = t.id AND x.a = 1 LEFT JOIN p y ON y.id = t.id AND y.a = 0)"


@query(f"WITH {_REVIEWED} SELECT id, first, second FROM r WHERE dataset = 'D02' AND second = 'ERROR' AND first = 'CORRECT' AND list_contains(errs, 'missing_field') AND contains(notes, '-02-')")
def record_filters(spark, d):
    """All filters of the review page at once: data set, comparison, a tool's status, an error class and a search in notes."""
    rid = F.concat(F.lit("D0"), 1 + F.col("l_orderkey") % 3, F.lit("_"), F.concat_ws("-", "l_orderkey", F.floor((F.col("l_linenumber") + 1) / 2)))
    right = F.col("l_tax") > 0.03
    error = F.when(right, "none").when(F.col("l_discount") > 0.05, "missing_field").otherwise("wrong_target")
    p = table(spark, d, "lineitem").select(rid.alias("ID"), F.when(F.col("l_linenumber") % 2 == 1, "a").otherwise("b").alias("CongCu"), F.when(right, "CORRECT").otherwise("ERROR").alias("DungSai"), error.alias("LoaiLoi"), F.col("l_shipdate").cast("date").cast("string").alias("GhiChu"), F.lit("").alias("DiaChiGoc"), F.lit("").alias("TruongDung"), F.lit("").alias("TruongDuDoan"))
    found = dashboard.filtered(dashboard.records(p, "a", "b"), dataset="D02", comparison="first_only", second="ERROR", error="missing_field", term="-02-")
    return found.select("id", "first", "second")


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 THEN c_name || ' ''x'' \"y\" é' || chr(10) END AS name, CASE WHEN c_custkey % 7 > 0 THEN '[' || c_nationkey || ', null, [\"a\"]]' END AS list FROM customer")
def python_literals(spark, d):
    """Dictionaries written as Python literals, every seventh cut off."""
    text = F.concat(F.lit("{'tên': '"), "c_name", F.lit(" \\'x\\' \"y\" \\xe9\\n', \"list\": ["), F.col("c_nationkey").cast("string"), F.lit(", None, ('a',),],}"))
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 > 0, text).otherwise(F.left(text, F.length(text) - 2)).alias("t"))
    return c.select("c_custkey", literals.value_of("t", "tên").alias("name"), F.regexp_replace(literals.value_of("t", "list"), ",(?! )", ", ").alias("list"))


@query("SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey)")
def record_navigation(spark, d):
    return order.neighbours(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")
