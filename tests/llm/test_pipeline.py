"""The pipeline stage by stage against brute force on a small corpus, and run() against its stages."""

import collections
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_llm_operators import BYTE, base_spans, contaminated, crc, encoded, jaccard_classes, prose

from driftmark.llm import queries, shared


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    rows, labels = [], []
    items = [(k, prose(rng, 30)) for k in range(5)]
    for i in range(400):
        words = prose(rng, rng.randint(20, 90)).split()
        good, toxic = 1, 0
        if i % 8 == 0:
            words, good = [w.upper() + "!!" for w in words], 0
        elif i % 7 == 0:
            words.insert(3, rng.choice(["vilest", "rotten"]))
            toxic = 1
        elif i % 11 == 0:
            words[5:5] = items[i % 5][1].split()[4:20]
        elif i % 13 == 0:
            words[4:4] = ["mail", f"a{i}@b.example.org", "or", "+1", "(555)", "010-9999", "from", "10.0.0.1"]
        rows.append((i, " ".join(words), "en", f"src{i % 4}", 0))
        if i % 2 == 0 or toxic or not good:
            labels.append((i, good, toxic))
    clean = [r for r in rows if r[0] % 8 and r[0] % 7]
    rows += [(500 + k, r[1], *r[2:]) for k, r in enumerate(clean[:20])]
    rows += [(600 + k, r[1] + " end", *r[2:]) for k, r in enumerate(clean[20:40])]
    rows += [(700, None, "en", "src1", 0), (701, "", None, None, None), rows[1]]
    rows = [(*r[:4], len(r[1]) if r[1] else 0) for r in rows]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), items


def test_stages(spark, corpus):
    folder, items = corpus
    docs = queries.table(spark, folder, "documents")
    columns, steps = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "PII", "best-fit packing"]
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    step = lambda name, df: shared.stored(steps[name](spark, df, folder), "test")

    first = step("quality classifier", docs)
    assert first.columns == columns
    kept = {r["doc_id"] for r in first.collect()}
    bad = {i for i in range(400) if i % 8 == 0 or i % 7 == 0}
    assert not kept & bad and len(set(range(400)) - bad - kept) <= 3 and {700, 701} <= kept

    given = [(r["doc_id"], r["text"]) for r in first.collect()]
    second = step("n-gram Jaccard join", first)
    classes = jaccard_classes(given)
    want = {d for d, c, _ in classes if d == c}
    assert sorted(r["doc_id"] for r in second.collect()) == sorted(want)

    third = step("benchmark decontamination", second)
    assert rows(third) == rows(second.where(F.col("doc_id").isin([r["doc_id"] for r in second.collect() if not contaminated(r["text"], items, 10)[1]])))

    fourth = step("PII", third)
    before = {r["doc_id"]: r for r in third.collect()}
    for r in fourth.collect():
        text = before[r["doc_id"]]["text"]
        spans, out, at = base_spans(text), "", 0
        for a, k, b in spans:
            if a >= at:
                out += text[at:a] + "<" + ("EMAIL", "IP", "CARD", "PHONE")[k] + ">"
            at = max(at, b)
        assert r["text"] == (out + text[at:] if spans else text)
        assert r["n_chars"] == (len(r["text"]) if spans else before[r["doc_id"]]["n_chars"])
    assert any("<EMAIL>" in (r["text"] or "") for r in fourth.collect()) and fourth.columns == columns

    last = step("best-fit packing", fourth).collect()
    bins = collections.defaultdict(list)
    for r in last:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    want = sorted((r["doc_id"], crc([*encoded(BYTE, r["text"]), 0])) for r in fourth.collect())
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in last) == want

    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in whole) == want


def test_runs_do_not_meet(spark, corpus):
    """Results stay readable when other runs begin and end; a stage frees what the written result before it read."""
    folder = corpus[0]
    first = corpus_pipeline.run(spark, folder)
    docs = queries.table(spark, folder, "documents")
    a, b = (corpus_pipeline.classify(spark, docs, folder) for _ in "ab")
    written = shared.stored(a, "test")
    direct = corpus_pipeline.remove_benchmark(spark, b, folder)  # reads b itself, which stays
    assert corpus_pipeline.remove_benchmark(spark, written, folder).count() == direct.count() > 0
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        a.count()
    second = corpus_pipeline.run(spark, folder)
    assert second.count() == first.count() > 0


def test_further_columns_repeats_and_long_texts(spark, corpus, tmp_path):
    """Columns with the names that stages use inside, repeated ids and labels, and a very long text."""
    folder, _ = corpus
    names = ["dm_bad", "dm_quality", "dm_row", "quality", "spans", "c0", "node", "text2"]
    rng = random.Random(8)
    docs = queries.table(spark, folder, "documents").where("doc_id < 60")
    long = prose(rng, 60_000)
    more = spark.createDataFrame([(1000, long, "en", None, len(long)), (1000, long + " end", "en", "src1", len(long) + 4), (1001, prose(rng, 30), "en", "src1", 0), (1001, prose(rng, 30), "en", "src2", 0), (None, prose(rng, 30), None, None, None)], docs.schema)
    wide = docs.union(more).select("*", *[F.lit(k).alias(k) for k in names])
    wide.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        t = queries.table(spark, folder, name)
        t.union(t.limit(5)).write.parquet(f"{tmp_path}/{name}.parquet")
    given, columns = queries.table(spark, str(tmp_path), "documents"), wide.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = shared.stored(stage(spark, given, str(tmp_path)), "test")
        assert out.columns == columns, name
        assert all(r[k] == k for r in out.select(names).collect() for k in names)
        given = given if name == "quality classifier" else out  # so few labels teach nothing about long texts
    ids = collections.Counter(r["doc_id"] for r in given.collect())
    assert ids[1000] == 1 and ids[1001] == 2 and ids[None] == 1
    assert corpus_pipeline.pack(spark, given, str(tmp_path)).select("doc_id").distinct().count() == len(ids)
    no_size = given.drop("n_chars")
    assert corpus_pipeline.redact(spark, no_size, str(tmp_path)).columns == no_size.columns


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
