"""Work that must grow no faster than the input: each test fails where it does not."""

import random
import timeit
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest

from pyspark.sql import functions as F

from driftmark.llm import pseudolm
from driftmark.operators import cases, graph, receipts


def test_beginnings_name_the_first_match():
    """The bound over many texts at once against the matcher alone."""
    rng = random.Random(4)
    make = lambda: "".join(rng.choice("abcd é😀") for _ in range(rng.choice([0, 1, 7, 8, 9, 20, 64])))
    edited = lambda t: "".join(rng.choice("xyz") if rng.random() < 0.1 else c for c in t)
    begun = [make() for _ in range(60)]
    asked = [edited(rng.choice(begun)) for _ in range(200)] + [make() for _ in range(50)] + [""]
    held = receipts.Beginnings(0.82, bits=128, held=100)
    for t in begun:
        held.add(t)
    want = [next((i for i, b in enumerate(begun) if SequenceMatcher(None, a, b).ratio() >= 0.82), None) for a in asked]
    assert [held.first(a) for a in asked] == want and len(held.blocks) > 3 and 20 < sum(w is not None for w in want) < len(want)


@pytest.mark.parametrize("first", [2, 64])
def test_fuzzy_clusters_of_one_large_house(spark, tmp_path, first):
    """One house number in many slices: as the greedy loop, without shuffling candidate pairs."""
    rng = random.Random(6)
    streets = ["".join(rng.choice("abcdefghijklmnop") for _ in range(30)) for _ in range(12)]
    texts = []
    for i in range(900):
        t = list(f"12 {rng.choice(streets)}")
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(3, len(t))] = rng.choice("xyz")
        texts.append("".join(t))
    begun, members = [], {}
    for t in dict.fromkeys(texts):
        b = next((b for b in begun if SequenceMatcher(None, t, b).ratio() >= 0.82), None)
        if b is None:
            begun.append(b := t)
        members.setdefault(b, []).append(t)
    want = sorted(x for c in members.values() for x in sorted(c, key=lambda v: (-len(v), v))[:2])
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    last, _ = _read(spark)
    got = sorted(r["t"] for r in receipts.fuzzy_dedup(df, "t", "i", first=first).collect())
    assert got == want and len(begun) < 100
    read = _read(spark, last)[1]
    assert 0 < read < 40 * len(texts)


def _read(spark, after: int = -1) -> tuple[int, int]:
    """(last stage, shuffled rows read) of the stages of the session after a stage."""
    store, new = spark.sparkContext._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList
    stages = store.stageList(new(), False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), new())
    found = [(s.stageId(), s.shuffleReadRecords()) for s in map(stages.apply, range(stages.size())) if s.stageId() > after]
    return max((s for s, _ in found), default=after), sum(n for _, n in found)


def test_proof_makes_only_the_cases_predictions(spark):
    """Of 2,000 predictions only those with the ID of a case are joined and compared; what is no projection is found."""
    rows = [(f"D0{i % 3}_{i:05d}", "ab"[i % 2], f"x{i}", "{}", "{}", "ERROR" if i % 5 else "CORRECT", "parse_boundary_error" if i % 5 else "none", "NONE", "") for i in range(2000)]
    p = spark.createDataFrame(rows, "ID string, CongCu string, DiaChiGoc string, TruongDuDoan string, TruongDung string, DungSai string, LoaiLoi string, TinhHuongMoHo string, GhiChu string")
    raw = p.select(F.col("ID").alias("id"), F.col("CongCu").alias("tool"), F.col("DiaChiGoc").alias("input"), F.lit("success").alias("status"))
    last, _ = _read(spark)
    picked = cases.select(p, raw, 3)
    want = sorted({(r[0][:3], r[1]): [] for r in rows})
    assert [r[0] for r in picked.select("ID").collect()] == [x for d, t in want for x in sorted(r[0] for r in rows if r[0][:3] == d and r[1] == t and r[6] != "none")[:3]]
    edited = picked.withColumn("GhiChu", F.when(F.col("CongCu") == "a", "edited").otherwise(F.col("GhiChu")))
    odd = cases.proof(edited, p, raw, checked=True).collect()
    assert sorted(r["key"] for r in odd) == sorted(f"{r['ID']}|a" for r in picked.collect() if r["CongCu"] == "a") and len(odd) == 9
    assert _read(spark, last)[1] < 3 * len(rows) + 2000


def test_traceability_of_null_and_equal_inputs(spark):
    p = spark.createDataFrame([("1", "t", "x"), ("2", "t", None), ("3", "t", None), ("4", "t", "x"), ("5", "t", "x"), ("5", "t", "x"), ("6", "t", "x")], "ID string, CongCu string, DiaChiGoc string")
    raw = spark.createDataFrame([("1", "t", "x"), ("2", "t", None), ("3", "t", "y"), ("4", "t", "y"), ("5", "t", "x"), ("7", "t", "x")], "id string, tool string, input string")
    assert sorted(map(tuple, cases.untraceable(p, raw).collect())) == [("raw_response", "4|t"), ("raw_response", "6|t"), ("raw_response", "7|t"), ("unique", "5|t")]


def test_graph_summary_counts_units_without_copies_of_edges(spark):
    """Units are counted with no row made more than once for an edge, repeated edges and hubs included; an empty table gives zeros."""
    pairs = [(i % 40, i % 7 + 100) for i in range(300)] + [(1, i) for i in range(500, 900)] + [(i, 7) for i in range(2000, 2300)] + [(5000, 5001)]
    df = spark.createDataFrame(pairs, "old long, new long")
    out = graph.summary(df, "old", "new")
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
    once, o, i = set(pairs), Counter(p for p, _ in set(pairs)), Counter(q for _, q in set(pairs))
    kind = Counter((o[p] > 1, i[q] > 1) for p, q in once)
    assert tuple(out.first()) == (len(pairs), len(o), len(i), kind[False, False], kind[True, False], kind[False, True], kind[True, True])
    assert tuple(graph.summary(df.where("false"), "old", "new").first()) == (0,) * 7


def test_softmax_of_any_logits_and_its_time():
    """Equal to the plain softmax, far logits included, and in less time than one that looks for the greatest of every row."""
    rng = np.random.default_rng(2)

    def plain(z):
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        return z

    for shift in (0, 500, -500):
        z = (rng.normal(0, 2, (300, 40)) + shift * rng.random((300, 1))).astype("f4")
        assert np.allclose(pseudolm._soft(z.copy()), plain(z.copy()), atol=1e-6)
    z = rng.normal(0, 2, (8192, 40)).astype("f4")
    least = lambda f: min(timeit.repeat(lambda: f(z.copy()), number=3, repeat=15))
    assert least(pseudolm._soft) < 0.9 * least(plain)
