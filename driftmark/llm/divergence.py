"""Source divergence audit over an inverted index with corrected baselines.

Terms are runs of ASCII letters and non-ASCII characters, of which only A-Z are lower-cased. Each
language keeps the V terms that stand in ``least`` of its documents or more. A group (a source in a
language) and the language as a whole give a kept term p = 1 + floor(scale * (count + 1) / (N + V)),
N being their count of all kept terms; f = floor((p - q)^2 / q) compares two of them, in whole numbers.

A pair of sources starts at V times the f of two zero counts. The postings of a term then emit what
differs from that. Postings of one side depend on a count alone, so they go by the distinct counts
of a group; only a term that both sources hold emits a correction of its own for the pair, summed
within a task before anything is shuffled. The terms that a group has more of than its language are
ranked in a window, which keeps the best of each task first.

Null text, language and source count as empty; groups without terms take part with a count of 0
everywhere; a language without kept terms has pairs of value 0; repeated rows count again; ties go
to the lesser item by UTF-8; texts of any length are read whole; an empty table gives no rows.
Columns beside the named ones are not read. A term's postings have a row for each source of its
language, and the result has a row for each pair of them, as the audit asks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import shared

#: A-Z to a-z; a-z and all bytes of non-ASCII characters as they are; the rest to spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str, held: int = 300_000) -> DataFrame:
    """(lang, source, term, n, docs); a null term stands for a group as such. A task holds about ``held`` counts at a time."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        groups: dict[tuple, tuple] = {}
        size = 0

        def out():
            for (lang, source), (n, docs_) in groups.items():
                terms = list(n)
                columns = [pa.array([lang] * (len(terms) + 1), pa.string()), pa.array([source] * (len(terms) + 1), pa.string()), pa.array([*terms, None], pa.binary()).cast(pa.string()), pa.array([*n.values(), 0], pa.int64()), pa.array([*map(docs_.__getitem__, terms), 0], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            langs, sources = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for lang, source, text in zip(langs, sources, batch.column(0), strict=True):
                n, docs_ = groups.setdefault((lang, source), (Counter(), Counter()))
                text = text.as_py()
                if text:
                    words = text.encode().translate(_FOLD).split()
                    size -= len(n)
                    n.update(words)
                    docs_.update(set(words))
                    size += len(n)
                    if size > held:
                        yield from out()
                        groups, size = {}, 0
        yield from out()

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.col(text_col), blank(lang_col), blank(source_col)).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column | str, total: str, terms: str, scale: int) -> Column:
    """p of a count."""
    n = F.col(n) if isinstance(n, str) else n
    up = (n + 1).cast("decimal(19,0)") * F.lit(scale).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", up, (F.col(total) + F.col(terms)).cast("decimal(20,0)"))


def _apart(p: Column | str, q: Column | str) -> Column:
    """f of two shares."""
    p, q = (F.col(c) if isinstance(c, str) else c for c in (p, q))
    return F.call_function("div", (p - q) * (p - q), q)


def _exact(c: Column) -> Column:
    return F.sum(c.cast("decimal(20,0)"))


def audit(docs: DataFrame, least: int = 3, top: int = 200, scale: int = 1_000_000_000, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", scope: str = "divergence") -> DataFrame:
    """(lang, source, part, item, value, rank): part "pair" for every other source of the language, part "term" for a group's ``top`` terms above its language."""
    if not 0 < scale <= 1_000_000_000:
        raise ValueError("scale is at most 10^9, so that squares fit 64 bits")
    counts = shared.stored(term_counts(docs, text_col, lang_col, source_col), scope)
    terms = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("postings"))
    kept = shared.stored(terms.where(F.col("docs") >= least).drop("docs"), scope)
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_n"))
    flat = kept.select("lang", "term", "total", F.explode("postings").alias("x")).select("lang", "term", "total", "x.source", "x.n")
    # How many terms a group has at each count.
    often = shared.stored(flat.groupBy("lang", "source", "n").agg(F.count("*").alias("m")), scope)
    own = often.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("m")).alias("own_n"))
    groups = counts.where("term is null").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["own_n", "terms", "lang_n"])
    zero = F.when(F.col("terms") > 0, _share(F.lit(0).cast("long"), "own_n", "terms", scale)).otherwise(1)
    groups = shared.stored(groups.withColumn("p0", zero), scope)

    side = lambda p: groups.select("lang", "terms", *[F.col(c).alias(f"{p}_{c}") for c in ("source", "own_n", "p0")])
    pairs = side("a").join(side("b").drop("terms"), "lang").where("a_source <> b_source")
    base = pairs.select("lang", "a_source", "b_source", (F.col("terms").cast("decimal(20,0)") * _apart("a_p0", "b_p0").cast("decimal(18,0)")).cast("decimal(38,0)").alias("v"))
    none = _apart("a_p0", "b_p0")
    met = often.withColumnRenamed("source", "held").join(pairs, "lang")
    weigh = lambda v: (v.cast("decimal(19,0)") * F.col("m").cast("decimal(18,0)")).cast("decimal(38,0)").alias("v")
    first = met.where("held = a_source").select("lang", "a_source", "b_source", weigh(_apart(_share("n", "a_own_n", "terms", scale), "b_p0") - none))
    second = met.where("held = b_source").select("lang", "a_source", "b_source", weigh(_apart("a_p0", _share("n", "b_own_n", "terms", scale)) - none))
    shares = flat.join(groups, ["lang", "source"]).select("lang", "term", "total", "source", "n", "terms", "lang_n", "p0", _share("n", "own_n", "terms", scale).alias("p"))
    posting = F.struct("source", "p", "p0")
    several = shares.groupBy("lang", "term").agg(F.collect_list(posting).alias("xs")).where(F.size("xs") > 1)
    crossed = several.select("lang", F.explode("xs").alias("a"), "xs").select("lang", "a", F.explode("xs").alias("b")).where("a.source <> b.source")
    both = _apart("a.p", "b.p") - _apart("a.p", "b.p0") - _apart("a.p0", "b.p") + _apart("a.p0", "b.p0")
    third = crossed.select("lang", F.col("a.source").alias("a_source"), F.col("b.source").alias("b_source"), both.alias("v")).groupBy("lang", "a_source", "b_source").agg(_exact(F.col("v")).alias("v"))
    total = base.union(first).union(second).union(third).groupBy("lang", "a_source", "b_source").agg(F.sum("v").cast("decimal(38,0)").alias("v"))
    pair = total.select("lang", F.col("a_source").alias("source"), F.lit("pair").alias("part"), F.col("b_source").alias("item"), F.col("v").cast("long").alias("value"))
    by = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = pair.withColumn("rank", F.row_number().over(by))

    above = shares.withColumn("q", _share("total", "lang_n", "terms", scale)).where("p > q")
    term = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart("p", "q").alias("value"))
    return pair.union(term.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top))
