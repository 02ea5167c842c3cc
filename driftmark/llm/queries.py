"""The registered queries of this package and the SQL that they are held against."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitslice, decontaminate, divergence, licences, nearjoin, packing, personal, pseudolm, quality, repair, shared, substring, trie, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """A vocabulary file; DRIFTMARK_TOKENIZERS names another folder than that of public_tokenizers."""
    folder = os.environ.get("DRIFTMARK_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bitslice(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bitslice.search(table(spark, sf_dir, "embeddings"))
    return found.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["licence"]))), ",")
    best = F.array_max(F.transform("matches", lambda m: m["dice"]))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), names.alias("licences"), F.coalesce(best, F.lit(0.0)).alias("best_dice"))


def op3_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    of = lambda k: F.filter(base, lambda s: s["kind"] == k)
    n = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in personal.KINDS]
    return found.select("doc_id", *n, F.sha2(personal.joined(base), 256).alias("base_sha256"), personal.joined(F.col("spans")).alias("spans"))


def op4_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared.scratch(spark, "repair")
    manifest = repair.write(table(spark, sf_dir, "documents"), out, vocabulary("word_bpe_49k.json"))
    return repair.read(manifest, out)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_pseudolm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudolm.pseudo_likelihood(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.round("log_prob", 2).alias("log_prob"), F.round("mean_log_prob", 4).alias("mean_log_prob"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared.scratch(spark, "warc")
    manifest = warc.write(table(spark, sf_dir, "pages"), out)
    return warc.read(manifest, out)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: log odds of low quality and toxicity, posterior log odds of being bad, keep."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scope = shared.fresh("quality")
    lean = quality.scored(docs.select("doc_id", "source", "lang", "text"), quality.fit(docs, labels, scope=scope)).drop("text")
    scores = shared.stored(lean, scope)
    out = quality.judged(scores, quality.posteriors(scores, "source", "lang", scope), "source", "lang")
    return out.select("doc_id", F.round("dm_quality", 4).alias("quality_odds"), F.round("dm_toxic", 4).alias("toxic_odds"), F.round("dm_bad", 4).alias("bad_odds"), (F.col("dm_bad") < quality.KEEP_BELOW).alias("keep"))


def op10_nearjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.near_duplicates(table(spark, sf_dir, "documents"))


def op11_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.repeats(table(spark, sf_dir, "documents"), 35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = shared.fresh("trie")
    turns = shared.stored(trie.positions(table(spark, sf_dir, "conversations")), scope)
    return trie.trie(*trie.rebuilt(turns), scope=scope)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_bitslice": op1_bitslice,
    "op2_licences": op2_licences,
    "op3_personal": op3_personal,
    "op4_repair": op4_repair,
    "op5_decontaminate": op5_decontaminate,
    "op6_pseudolm": op6_pseudolm,
    "op7_packing": op7_packing,
    "op8_warc": op8_warc,
    "op9_quality": op9_quality,
    "op10_nearjoin": op10_nearjoin,
    "op11_substring": op11_substring,
    "op12_trie": op12_trie,
    "op13_divergence": op13_divergence,
}

def _values(rows) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return ", ".join(f"({', '.join(map(quote, r))})" for r in rows)


_KNOWN = sorted(licences.TEMPLATES.items())
_LICENCE_SQL = f"""
WITH t(t, licence, words) AS (VALUES {_values((i, k.split("/")[0], len(licences.words_of(x))) for i, (k, x) in enumerate(_KNOWN))}),
tg(t, gram) AS (VALUES {_values((i, g) for i, (_, x) in enumerate(_KNOWN) for g in licences.bigrams(x))}),
ts AS (SELECT t, count(*) AS n FROM tg GROUP BY t),
a(t, gram, place) AS (VALUES {_values((i, g, at) for i, (_, x) in enumerate(_KNOWN) for g, at in licences.anchors(x, 0.8))}),
d AS (SELECT row_number() OVER () AS r, doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents),
p AS (SELECT r, len(w) AS n, w, unnest(generate_series(0, len(w) - 2)) AS i FROM d WHERE len(w) > 1),
g AS (SELECT r, n, i, w[i + 1] || ' ' || w[i + 2] AS gram FROM p),
c AS (SELECT DISTINCT g.r, t.t, t.words, greatest(0, least(g.i - a.place, g.n - t.words)) AS s FROM g JOIN a USING (gram) JOIN t USING (t)),
x AS (SELECT DISTINCT c.r, c.t, c.s, g.gram FROM c JOIN g ON g.r = c.r AND g.i >= c.s AND g.i < c.s + c.words - 1),
k AS (SELECT x.r, x.t, x.s, count(*) AS n, count(tg.gram) AS k FROM x LEFT JOIN tg ON tg.t = x.t AND tg.gram = x.gram GROUP BY x.r, x.t, x.s),
m AS (SELECT r, t, max(CAST(2.0 AS DOUBLE) * k / (k.n + ts.n)) AS dice FROM k JOIN ts USING (t) GROUP BY r, t),
b AS (SELECT m.r, t.licence, m.dice FROM m JOIN t USING (t) WHERE m.dice >= 0.8 - 1e-12)
SELECT any_value(d.doc_id) AS doc_id, count(b.r) AS n_matches, coalesce(array_to_string(list_sort(list_distinct(list(b.licence) FILTER (WHERE b.licence IS NOT NULL))), ','), '') AS licences, coalesce(max(b.dice), 0.0) AS best_dice
FROM d LEFT JOIN b ON d.r = b.r GROUP BY d.r
"""

ORACLE_SQL: dict[str, str] = {
    "op2_licences": _LICENCE_SQL,
    "op1_bitslice": """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, c.row AS row,
         max(CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT)) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id GROUP BY q.vec_id, c.vec_id, c.row
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op11_substring": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35),
k AS (SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS k FROM p),
s AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM k) WHERE n > 1),
x AS (SELECT d.r, d.w, unnest(generate_series(1, len(d.w))) AS i FROM d),
m AS (SELECT x.r, x.i, x.w[x.i] AS word, count(s.i) OVER (PARTITION BY x.r ORDER BY x.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) > 0 AS gone FROM x LEFT JOIN s ON s.r = x.r AND s.i = x.i),
g AS (SELECT r, count(*) FILTER (WHERE gone) AS n, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256 FROM d LEFT JOIN g ON g.r = d.r
""",
    "op12_trie": """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), m AS (
  SELECT conv_id, conv_id - conv_id % 5 AS of, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b:
    list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295::BIGINT) % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT t.conv_id, t.pos, t.role, t.text FROM t JOIN m USING (conv_id) WHERE t.pos > m.h
  UNION ALL SELECT m.conv_id, t.pos, t.role, t.text FROM m JOIN t ON t.conv_id = m.of WHERE t.pos <= m.h
), l AS (
  SELECT m.conv_id, coalesce(list({'role': r.role, 'text': r.text} ORDER BY r.pos) FILTER (WHERE r.pos IS NOT NULL), []) AS turns FROM m LEFT JOIN r USING (conv_id) GROUP BY m.conv_id
), p AS (
  SELECT conv_id, depth, len(turns) AS n, CASE WHEN depth = 0 THEN '' ELSE sha256(to_json(turns[1:depth])::VARCHAR) END AS k, CASE WHEN depth = 1 THEN '' WHEN depth > 1 THEN sha256(to_json(turns[1:depth - 1])::VARCHAR) END AS up, coalesce(strlen(turns[depth].text), 0) AS bytes
  FROM (SELECT conv_id, turns, unnest(generate_series(0, len(turns))) AS depth FROM l)
), n AS (
  SELECT depth, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '') AS ends FROM p GROUP BY depth, k
), c AS (SELECT depth - 1 AS depth, up AS k, count(*) AS n FROM n WHERE depth > 0 GROUP BY depth - 1, up),
f AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM n LEFT JOIN c USING (depth, k)),
s AS (SELECT p.depth, p.k, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves, sum(f.saved) AS saved FROM f JOIN p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY p.depth, p.k)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN s USING (depth, k) LEFT JOIN n u ON u.depth = f.depth - 1 AND u.k = f.up
""",
    "op13_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*)::HUGEINT AS n FROM t JOIN k USING (lang, term) GROUP BY t.lang, t.source, t.term),
o AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (coalesce(o.n, 0) + l.v) AS p, 1 + 1000000000 * (k.n + 1) // (l.n + l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN o USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM y) WHERE part = 'pair' OR rank <= 200
""",
}
