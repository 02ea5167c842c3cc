"""Long texts with very many matches take time in proportion, and personal data is learned as plain loops over rows learn it."""

import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmark.llm import licences, personal


def one(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1)


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 129, 256, 5000, 40_000])
def test_running_totals(spark, n):
    values = [random.Random(n).randint(-9, 9) for _ in range(n)]
    df = spark.createDataFrame([(values,)], "v array<long>")
    got = df.select(personal.running(F.col("v"), lambda a, b: a + b).alias("s"), personal.running(F.col("v"), F.greatest).alias("m")).first()
    assert got["s"] == np.cumsum(values).tolist() and got["m"] == (np.maximum.accumulate(values).tolist() if n else [])


@pytest.mark.parametrize("name,part,kind", [("numbers", "12 ", None), ("addresses", "ab@cd.ef ", "email"), ("hosts", "10.0.0.1, ", "ip")])
def test_personal_data_in_five_megabytes(spark, name, part, kind):
    text = part * (5_000_000 // len(part))
    began = time.time()
    spans = one(spark, text).select(personal.candidates(F.col("text")).alias("s")).select(F.transform("s", lambda s: s["start"]).alias("s")).first()["s"]
    assert time.time() - began < 60
    assert spans == ([m.start() for m in re.finditer(re.escape(part.strip(", ")), text)] if kind else [])
    if kind:
        began = time.time()
        flat = F.transform(personal.candidates(F.col("text")), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit(kind).alias("kind")))
        got = one(spark, text).select("text", flat.alias("s")).select(personal.redacted(F.col("text"), F.col("s"))).first()[0]
        assert time.time() - began < 60 and got == text.replace(part.strip(", "), f"<{kind.upper()}>")


def test_licences_in_five_megabytes(spark):
    text = (licences.TEMPLATES["mit/text"] + "\n") * 5000
    began = time.time()
    got = licences.scan(one(spark, text)).first()["matches"]
    assert time.time() - began < 60
    assert {(m["licence"], m["kind"]) for m in got} == {("mit", "grant"), ("mit", "text")} and all(m["dice"] == 1.0 for m in got)


def plain_redaction(text, spans):
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out.append(text[at:a] + f"<{kind.upper()}>")
        at = max(at, b)
    return "".join(out) + text[at:] if spans else text


def test_redaction_equals_a_loop(spark):
    rng = random.Random(8)
    rows = []
    for i in range(200):
        text = "".join(rng.choice("ab é漢\U0001f600") for _ in range(rng.randint(0, 60)))
        spans = sorted((a, rng.randint(a + 1, len(text)), rng.choice(personal.KINDS)) for a in (rng.randrange(len(text)) for _ in range(rng.randint(0, 6) if text else 0)))
        rows.append((i, text, spans))
    df = spark.createDataFrame(rows, "i int, text string, s array<struct<start:long,stop:long,kind:string>>").repartition(3)
    for wide in (1, 7, 4096):
        got = dict(df.select("i", personal.redacted(F.col("text"), F.col("s"), wide)).collect())
        assert got == {i: plain_redaction(t, [tuple(s) for s in spans]) for i, t, spans in rows}


def test_loose_candidates_overlap_no_base_span(spark):
    rng = random.Random(2)
    bits = ["+1 202-555-0147", "202-555-0147", "4111 1111 1111 1111", "4111.1111.1111.1111", "a@b.cd", "a (at) b.cd", "10.0.0.1", "999.1.1.1", "1:2:3:4:5:6:7:8", " ", ",", "x", "é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    seen = 0
    for r in df.select("i", personal.candidates(F.col("text")).alias("s")).collect():
        base = [(s["start"], s["stop"]) for s in r["s"] if s["base"]]
        loose = {(s["start"], s["stop"], s["kind"]) for s in r["s"] if not s["base"]}
        every = {(m.start(), m.end(), k) for k, kind in enumerate(personal.KINDS) for m in re.finditer(personal.LOOSE[kind], texts[r["i"]])}
        assert loose == {x for x in every if not any(a < x[1] and x[0] < b for a, b in base)}
        seen += len(loose)
    assert seen > 50


def learned_from_rows(rows, turns=25):
    """Expectation-maximisation and the span classifier over single candidates, in numpy."""
    accepted = {}
    for kind in {k for k, _, _ in rows}:
        v = np.array([v for k, v, _ in rows if k == kind])
        f = np.array([f for k, _, f in rows if k == kind])
        n, labelers = v.shape
        belief = np.where(v.sum(1) > 0, 0.9, 0.1)
        for _ in range(turns):
            prior = (1 + belief.sum()) / (2 + n)
            odds = np.full(n, math.log(prior / (1 - prior)))
            for j in range(labelers):
                for x in (-1, 0, 1):
                    hit = v[:, j] == x
                    yes = (belief[hit].sum() + (2.0 if x > 0 else 1.0)) / (n * prior + 4.0)
                    no = ((1 - belief[hit]).sum() + (2.0 if x < 0 else 1.0)) / (n * (1 - prior) + 4.0)
                    odds[hit] += math.log(yes / no)
            belief = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        x = np.column_stack([np.ones(n), v, f & 1, f >> 1])
        w = np.zeros(x.shape[1])
        for _ in range(400):
            w -= 1e-3 * w + x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - belief) / n
        for row, a, b in zip(x, v.tolist(), f.tolist(), strict=True):
            if abs(row @ w) > 1e-6:
                accepted[kind, tuple(a), b] = bool(row @ w >= 0)
    return accepted


def test_learning_equals_loops_over_rows(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(1500):
        kind, truth = rng.randrange(4), rng.random() < 0.6
        vote = lambda right: rng.choice([0, 1, -1]) if rng.random() > right else (1 if truth else -1)  # noqa: E731, B023
        rows.append((kind, [vote(0.9), vote(0.7), vote(0.4), vote(0.8)], rng.choice([0, 0, 0, 1, 2, 3]) if not truth else 0))
    spans = spark.createDataFrame([([(0, 1, k, False, v, f)],) for k, v, f in rows], "spans array<struct<start:long,stop:long,kind:int,base:boolean,v:array<int>,f:int>>")
    got, want = personal.learn(spans), learned_from_rows(rows)
    assert want and {k: got[k] for k in want} == want and len(set(want.values())) == 2
