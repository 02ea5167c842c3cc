"""Re-Pair goes on until no pair pays for its rule."""

import collections

import numpy as np
import pytest

from driftmark.llm import repair


def places(s, ends):
    """How often each pair stands in the documents without overlapping itself."""
    out, first = collections.Counter(), 0
    for end in ends.tolist():
        at: dict = {}
        for i in range(first, end - 1):
            pair = (int(s[i]), int(s[i + 1]))
            if at.get(pair, -2) < i - 1:
                out[pair] += 1
                at[pair] = i
        first = end
    return out


def some(kind, rng):
    if kind == "runs":
        return np.repeat(rng.integers(0, 3, 300), rng.integers(1, 40, 300))
    if kind == "periodic":
        return np.tile([1, 2, 1, 1, 2, 2, 1], 700)
    if kind == "words":
        vocabulary = [rng.integers(0, 60, rng.integers(2, 9)) for _ in range(40)]
        return np.concatenate([vocabulary[int(i)] for i in rng.zipf(1.3, 2500) % 40])
    return rng.integers(0, 1000, 3000)


@pytest.mark.parametrize("base", [1000, 70_000, 65_530])
@pytest.mark.parametrize("kind", ["runs", "periodic", "words", "random"])
def test_no_pair_that_pays_is_left(base, kind):
    rng = np.random.default_rng(len(kind))
    ids = some(kind, rng).astype("u4")
    ends = np.unique(np.append(rng.integers(0, len(ids), 20), len(ids)))
    for per_round in (1, 6144):
        s, new_ends, rules, sizes = repair.compress(ids, ends, base, per_round)
        assert np.array_equal(repair.expand_all(s.astype("u4"), base, rules, sizes), ids) and len(new_ends) == len(ends)
        left = {p: n for p, n in places(s, new_ends).items() if n >= 5}
        full = s.dtype == np.uint16 and base + len(rules) == 1 << 16
        assert not left or (full and 4 * sum(left.values()) <= 2 * (len(s) + 2 * len(rules)) + 4 * len(left))
        assert (s.dtype == np.uint32) == (base + len(rules) > 1 << 16 or base >= 1 << 16)
    if kind != "random":
        assert len(s) < len(ids) / 3


def test_symbols_become_wider_where_that_pays():
    ids = np.tile(np.arange(40, dtype="u4"), 400)
    data = repair.to_bytes([1], ids, np.array([len(ids)]), 65_530)
    seg = repair.Segment(data)
    assert seg.symbols.dtype == np.uint32 and len(seg.rules) > 6 and np.array_equal(seg.document(0), ids) and np.array_equal(seg.stretch(0, 777, 4321), ids[777:4321])
