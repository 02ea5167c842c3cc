"""The llm operators look at the whole of their input: each test fails where parts are left out."""

import math
import zlib

import numpy as np
import pytest

from driftmark.llm import pseudolm


@pytest.mark.parametrize("before", [0, 1])
def test_every_position_is_a_target(spark, before):
    """One word at one position trains the network, whatever residue that position has."""
    df = spark.createDataFrame([(i, "pad " * before + "solo") for i in range(40)], "doc_id long, text string").repartition(1)
    words = {"words": [b"pad", b"solo"], "own": 2, "logs": []}
    texts = pseudolm.symbolised(df, words)
    for turn in range(2):
        raw = [r["ids"] for r in texts.collect()]
        every = pseudolm.windows(raw, 1024)[1]
        assert sorted([*pseudolm.windows(raw, 1024, 5, 2, 0)[1], *pseudolm.windows(raw, 1024, 5, 2, 1)[1]]) == sorted(every) and len(every) == 40 * (1 + before)
    raw, fitted = (pseudolm.Network(m, words).scores(["pad " * before + "solo"])[0][1] for m in (pseudolm.start(), pseudolm.fit(texts, words)))
    assert fitted > raw


def test_scores_equal_a_loop_over_positions(spark):
    """Every position's log-probability by plain loops in double precision."""
    rng = np.random.default_rng(3)
    model = {k: (v + rng.normal(0, 0.3, v.shape)).astype("f4") for k, v in pseudolm.start().items()}
    words = {"total": {pseudolm.SYMBOLS - 3: 17}}
    net = pseudolm.Network(model, words)
    docs = [rng.choice([*range(0, 60), pseudolm.SYMBOLS - 3], n).astype("<u4") for n in (1, 0, 2, 9, 300, 0)]

    def softmax(z):
        z = np.exp(z - z.max())
        return z / z.sum()

    def loop(ids):
        out, width = 0.0, net.width
        m = {k: v.astype("f8") for k, v in model.items()}
        for i, t in enumerate(ids.tolist()):
            x = np.concatenate([m["e"][int(ids[i + p]) if 0 <= i + p < len(ids) else width * width] for p in pseudolm.PLACES])
            h = np.tanh(x @ m["w"] + m["b"])
            k, r = divmod(t, width)
            out += math.log(softmax(h @ m["c"] + m["cb"])[k] * softmax(h @ m["u"][k] + m["ub"][k])[r])
            out -= math.log(words["total"].get(t, 1))
        return out

    for most in (1 << 16, 50):
        got = net.sums([d.tobytes() for d in docs], most)
        assert got == pytest.approx([loop(d) for d in docs], abs=2e-3)


def test_gradients_equal_differences():
    """A step's gradients against differences of the loss, weight by weight."""
    rng = np.random.default_rng(5)
    model = {k: (v + rng.normal(0, 0.3, v.shape)).astype("f8") for k, v in pseudolm.start().items()}
    flat, places = pseudolm.windows([rng.integers(0, 40, 12).astype("<u4").tobytes()], 1024)
    loss = lambda m: -pseudolm.Network(m, {"words": {}}).log_probs(flat, places).mean()
    trainer = pseudolm.Trainer(model)
    trainer.learn(flat, places)
    for key in model:
        size = np.sqrt(trainer.past[key] - 1e-3).reshape(-1)
        for at in np.argsort(-size)[:3].tolist():
            moved = {k: v.copy() for k, v in model.items()}
            moved[key].reshape(-1)[at] += 1e-5
            assert abs(abs(loss(moved) - loss(model)) / 1e-5 - size[at]) < 1e-3 + 0.01 * size[at]


def test_counts_decide_inside_a_bucket(spark):
    """Of two words in one bucket the more frequent one scores higher, by the log of the ratio of their counts."""
    top = pseudolm.SYMBOLS - pseudolm.BUCKETS
    common = [f"top{i}" for i in range(top)]
    by = {}
    for i in range(2000):
        by.setdefault(zlib.crc32(f"rare{i}".encode()) % pseudolm.BUCKETS, []).append(f"rare{i}")
    a, b = next(v for v in by.values() if len(v) > 1)[:2]
    rows = [(i, " ".join(common)) for i in range(12)] + [(100 + i, f"top1 {a} top2") for i in range(8)] + [(200, f"top1 {b} top2"), (201, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for known in (1 << 17, 3, 0):  # counts that every task knows, and those that are joined
        got = {r["doc_id"]: r for r in pseudolm.pseudo_likelihood(df, known=known).collect()}
        assert abs(got[100]["log_prob"] - got[200]["log_prob"] - math.log(8)) < 1e-5
    assert len(got) == len(rows) and got[201]["log_prob"] == 0
    assert pseudolm.vocabulary(pseudolm.word_counts(df, "text"))["total"][top + zlib.crc32(a.encode()) % pseudolm.BUCKETS] == 9
    assert pseudolm.width_of(1000) == pseudolm.WIDTH < pseudolm.width_of(286_327) < pseudolm.width_of(10**8)
