"""From raw documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's documents. All but the last keep the columns of documents, and further ones
of any name; only doc_id, text, source and lang are read. A stage stores what it needs under a scope
of its own, so that several runs, of one application or of many, do not meet. The scope's name goes
along in the metadata of doc_id, and the stage that reads the written result frees it; what is left
goes when the application ends.

Null and empty texts are clean texts without words: they pass all filters and are packed as one end
id. Repeated rows are copies, of which the second stage keeps one; texts of any length are read
whole; of equal documents the least id stays; an empty table gives no rows at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.llm import decontaminate, nearjoin, packing, personal, quality, shared
from driftmark.llm.queries import table, vocabulary


def _scope(stage: str, docs: DataFrame) -> str:
    """A new scope for a stage; that of the stage which wrote docs is freed."""
    shared.release_source(docs, "doc_id")
    return shared.fresh(f"pipeline/{stage}")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: drop documents whose posterior says low quality or toxic. Each text is scored once.

    Null sources and languages are groups of their own; without labels every document stays.
    """
    scope = _scope("quality", docs)
    rows, at = shared.numbered(docs)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), scope=scope)
    scores = shared.stored(quality.scored(rows, model, at["text"]), scope)
    shifts = quality.posteriors(scores, at["source"], at["lang"], scope)
    kept = quality.judged(scores, shifts, at["source"], at["lang"]).where(F.col("dm_bad") < quality.KEEP_BELOW)
    return shared.owning(kept.select(rows.columns).toDF(*docs.columns), scope, "doc_id")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each class of linked documents the one with the least id stays; texts without words stay."""
    scope = _scope("near", docs)
    return shared.owning(nearjoin.deduplicated(docs, scope=scope), scope, "doc_id")


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: drop documents in which a window of an item occurs."""
    scope = _scope("benchmark", docs)
    return shared.owning(decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), scope=scope), scope, "doc_id")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: replace personal data by its kind; n_chars, where there is one, follows the new text. Each text is searched once."""
    scope = _scope("personal", docs)
    rows, at = shared.numbered(docs)
    text = F.col(at["text"])
    found = shared.stored(rows.withColumn("spans", personal.candidates(F.coalesce(text, F.lit("")))), scope)
    done = found.withColumn("spans", personal.final_spans(F.col("spans"), personal.learn(found.select("spans"))))
    done = done.withColumn(at["text"], personal.redacted(text, F.col("spans")))
    if "n_chars" in at:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn(at["n_chars"], F.when(F.size("spans") > 0, F.length(text).cast(kind)).otherwise(F.col(at["n_chars"])))
    return shared.owning(done.select(rows.columns).toDF(*docs.columns), scope, "doc_id")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of all that is left."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), scope=_scope("packing", docs))


STAGES = [("quality classifier", classify), ("n-gram Jaccard join", deduplicate), ("benchmark decontamination", remove_benchmark), ("PII", redact), ("best-fit packing", pack)]

#: The stages learn and search; SQL cannot express them. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            own = shared.fresh("pipeline/docs")
            docs = shared.stored(out, own)
            if before:
                shared.release(spark, before)
            before = own
    return out
