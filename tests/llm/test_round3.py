"""Substring dedup, conversation trie and source audit against brute force, with odd rows."""

import collections
import hashlib
import os
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from driftmark.llm import divergence, substring, trie
from driftmark.llm import queries as q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ["op11_substring", "op12_trie", "op13_divergence"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = q.QUERIES[name](spark, SF), con.sql(q.ORACLE_SQL[name])
    names = sorted(df.columns)
    assert sorted(want.columns) == names
    assert sorted(map(repr, map(tuple, df.select(names).collect()))) == sorted(map(repr, want.project(", ".join(names)).fetchall()))


# Substring dedup


def without_repeats(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def repeated_texts():
    rng = random.Random(11)
    some = lambda n: [rng.choice(["a", "b", "an", "é", "of", "漢"]) + str(rng.randint(0, 40)) for _ in range(n)]
    passage, long = some(40), some(9000)
    out = [None, "", " \t\n\x0b\x0c\r", "one", " ".join(passage), "x " + " ".join(passage) + "\ty", " ".join(passage[:35]), " ".join(passage[1:35]), "tic tac " * 60, "z " * 34, "z " * 35, "z " * 36, "u v w " * 40]
    out += [" ".join(long), "\n".join(long[:4000] + ["edit"] + long[4001:]), " ".join(some(300)), " ".join(some(300))]
    return out + [out[15], " ".join(some(20) + passage[5:] + some(20))]


@pytest.mark.parametrize("window", [1, 2, 6, 7, 13, 35])
@pytest.mark.parametrize("block_bytes", [64, 1 << 20])
def test_repeated_windows(spark, window, block_bytes):
    texts = repeated_texts()
    rows = [(i if i != 3 else None, t, "clash", 1) for i, t in enumerate(texts)] + [(4, texts[4], "clash", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, block int").repartition(3)
    got = substring.repeats(df, window, block_bytes=block_bytes, bucket_bytes=20_000).collect()
    want = without_repeats([r[1] for r in rows], window)
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == collections.Counter((a[0], *b) for a, b in zip(rows, want, strict=True))
    for r in got:
        assert sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"] and all(a["stop"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:], strict=False))


def test_no_candidates_end_early(spark, monkeypatch):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(200))), (2, "short"), (3, None)], "doc_id long, text string")
    calls, real = [], substring.verdicts
    monkeypatch.setattr(substring, "verdicts", lambda *a: calls.append(1) or real(*a))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring.repeats(df).collect()} == {1: (200, 0), 2: (1, 0), 3: (0, 0)}
    assert len(calls) == 1
    assert substring.levels(35) == [9, 18, 35] and substring.levels(5) == [5] and substring.doublings(35)[:3] == [1, 2, 3]
    assert substring.repeats(df.where("false")).collect() == []


def test_a_passage_in_a_third_of_all_texts(spark):
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(i, f"{' '.join(f'w{rng.randint(0, 10**9)}' for _ in range(30))} {passage if i % 3 == 0 else ''} tail{i}") for i in range(900)]
    got = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in substring.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), block_bytes=5000).collect()}
    assert got == {i: (50 if i % 3 == 0 else 0, " ".join(t.replace(passage, "").split())) for i, t in rows}


# Conversation trie


def nodes_of(paths):
    """Brute force over {conv: [(role, text), ...]}."""
    members = collections.defaultdict(list)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    out = []
    for p, own in members.items():
        below = [x for x in members if x[: len(p)] == p]
        ends = sorted(c for c in own if len(paths[c]) == len(p))
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        out.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), kids[p], sum(not kids[x] for x in below), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def rebuilt_paths(rows, every=5, heads=9):
    own = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    h = lambda c: zlib.crc32(str(c).encode()) % heads
    return {c: own.get(c - c % every, [])[: h(c)] + v[h(c) :] for c, v in own.items()}


def conversations():
    rng = random.Random(4)
    rows = []
    for c in [*range(120), 700, 701, 704, 1003]:
        for t in range(rng.choice([1, 2, 3, 9, 12])):
            rows.append((c, rng.choice([t, t, None, 2]), rng.choice(["user", "assistant", None, ""]), rng.choice(["hi", "hello there", "", None, "é漢", "x" * 5000]), 0, "clash"))
    rows += [(c, t, "user", "same") + (0, "clash") for c in range(2000, 2600, 5) for t in range(3)]  # a large group of copies
    return rows + [(None, 1, "user", "lost", 0, "clash"), rows[0], (5000, 0, "user", "\x00quote\"'", 0, "clash")]


def collected(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


def test_trie_of_rebuilt_conversations(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int, digest string").repartition(3)
    turns = trie.positions(df)
    assert collected(trie.trie(*trie.rebuilt(turns))) == nodes_of(rebuilt_paths(rows))
    plain = rebuilt_paths(rows, every=1)  # each is its own head
    assert collected(trie.trie(turns)) == nodes_of(plain)
    assert trie.trie(trie.positions(df.where("false"))).collect() == []


def test_trie_members_and_odd_turns(spark):
    turns = spark.createDataFrame([(1, 1, None, None), (1, 2, "a", "b"), (2, 1, "", ""), (3, 1, "ab", ""), (4, 1, "a", "b"), (4, None, "lost", "lost")], "conv_id long, pos int, role string, text string")
    members = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, 6)], "conv_id long")
    want = nodes_of({1: [("", ""), ("a", "b")], 2: [("", "")], 3: [("ab", "")], 4: [("a", "b")], 5: [], 6: []})
    assert collected(trie.trie(turns, members)) == want


def test_deep_and_hot_nodes(spark):
    """Two long conversations that part late, and one node at which thousands end."""
    long = [("user", str(i)) for i in range(600)]
    paths = {1: long, 2: [*long[:590], ("user", "other")]} | {c: [("user", "bye")] for c in range(10, 3010)}
    df = spark.createDataFrame([(c, i, r, t) for c, p in paths.items() for i, (r, t) in enumerate(p)], "conv_id long, pos long, role string, text string")
    got = {(r["conv_id"], r["depth"]): r for r in trie.trie(df).collect()}
    assert len(got) == 1 + 600 + 1 + 1
    root, bye = got[1, 0], got[10, 1]
    assert (root["n_convs"], root["n_children"], root["n_leaves"]) == (3002, 2, 3)
    assert root["saved_tokens"] == sum(len(t) for _, t in long[:590]) + 2999 * 3
    assert bye["ends_sha256"] == hashlib.sha256(",".join(map(str, range(10, 3010))).encode()).hexdigest()
    assert got[1, 590]["n_children"] == 2 and got[1, 590]["n_leaves"] == 2 and got[2, 591]["parent_conv_id"] == 1


# Source audit


def audited(rows, least=3, top=200, scale=10**9):
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", fold(text))) for text, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = collections.Counter(t for *_, w in own for t in set(w))
        kept = sorted(t for t, n in seen.items() if n >= least)
        count = lambda ws: collections.Counter(t for w in ws for t in w if seen[t] >= least)  # noqa: E731, B023
        shares = lambda n: {t: 1 + scale * (n[t] + 1) // (sum(n.values()) + len(kept)) for t in kept}  # noqa: E731, B023
        counts = {s: count([w for _, x, w in own if x == s]) for _, s, _ in own}
        p, q = {s: shares(n) for s, n in counts.items()}, shares(count([w for *_, w in own]))
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            order = lambda x: (-x[0], x[1].encode())
            out += [(lang, s, "pair", i, v, k + 1) for k, (v, i) in enumerate(sorted(pairs, key=order))]
            out += [(lang, s, "term", i, v, k + 1) for k, (v, i) in enumerate(sorted(terms, key=order)[:top])]
    return sorted(out)


def mixed_texts():
    rng = random.Random(9)
    words = ["Alpha", "beta", "É", "ÀB", "漢字", "don't", "x1y", "Gamma_delta", "rare" + "é" * 3]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", "é", "", None, "ſ"]), "clash") for _ in range(150)]
    rows += [(None, "en", "empty", ""), ("", "zz", "a", ""), ("12 34", "zz", "b", ""), ("once only", "yy", "a", ""), ("A" * 50_000 + " b", "en", "s1", ""), ("퟿\U0001f600 a", "en", "s1", "")]
    return rows + rows[:5]


@pytest.mark.parametrize("top", [200, 2])
def test_audit(spark, top):
    rows = mixed_texts()
    df = spark.createDataFrame(rows, "text string, lang string, source string, term string").repartition(3)
    for held in (300_000, 3):
        real = divergence.term_counts
        try:
            divergence.term_counts = lambda *a, held=held, real=real: real(*a, held=held)
            got = sorted(tuple(r) for r in divergence.audit(df, top=top).select("lang", "source", "part", "item", "value", "rank").collect())
        finally:
            divergence.term_counts = real
        assert got == audited(rows, top=top)
    assert divergence.audit(df.where("false")).collect() == []


def test_audit_of_large_counts(spark):
    """Counts beyond what 64 bits hold times the scale."""
    df = spark.createDataFrame([(30_000_000_000, 40_000_000_000, 9)], "n long, total long, v long")
    assert df.select(divergence._share("n", "total", "v", 10**9)).first()[0] == 1 + 10**9 * (30_000_000_000 + 1) // (40_000_000_000 + 9)
    assert df.select(divergence._apart(F.lit(10**9 + 1).cast("long"), F.lit(1).cast("long"))).first()[0] == 10**18
