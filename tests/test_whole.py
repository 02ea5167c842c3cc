"""Queries look at the whole of their tables: each test fails where rows or parts of texts are left out."""

import random
import re
from difflib import SequenceMatcher

from driftmark import queries as q
from driftmark.functions import text as T
from driftmark.operators import receipts


def put(df, folder, name):
    df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_fuzzy_dedup_reads_whole_texts(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    body = " ".join(word() for _ in range(25))
    texts = [f"aa\n{body}", f"bb\n{body}", f"aa\n{' '.join(word() for _ in range(25))}"]  # other first lines, the same; the same first line, another text
    texts += [body + body, body + body[:-1] + "z", " ".join(word() for _ in range(60))]  # first lines of 200 characters and more
    texts += ["", "  ", "ab", "abc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clusters = []
    for t in texts:
        k = " ".join(t.split())
        for c in clusters:
            if SequenceMatcher(None, k, " ".join(c[0].split())).ratio() >= 0.82:
                c.append(t)
                break
        else:
            clusters.append([t])
    assert any(len(c) > 1 and len(c[0]) > 200 for c in clusters) and any({texts[0], texts[1]} <= set(c) for c in clusters)
    want = sorted(x for c in clusters for x in sorted(c, key=lambda v: (-len(v), v))[:2])
    assert sorted(r[0] for r in receipts.fuzzy_dedup(docs, "text", "doc_id").collect()) == want


def test_fuzzy_dedup_reads_every_address(spark, tmp_path):
    """The query against the greedy rule over the addresses of all customers."""
    rng = random.Random(9)
    put(spark.createDataFrame([(i, rng.choice(["Anna", "Anne", "Bert", "Berta"]) + rng.choice(["", "x"]), rng.choice(["AUTO", "AUTOS", "FOOD"]), rng.random() - 0.5, i % 4) for i in range(0, 400, 3)], "c_custkey long, c_name string, c_mktsegment string, c_acctbal double, c_nationkey long"), tmp_path, "customer")
    put(spark.createDataFrame([(i, f"N{i}", i % 2) for i in range(4)], "n_nationkey long, n_name string, n_regionkey long"), tmp_path, "nation")
    d = put(spark.createDataFrame([(0, "ASIA"), (1, "EUROPE")], "r_regionkey long, r_name string"), tmp_path, "region")
    whole = T.address_join("house", T.clean_value("street"), "ward", "district", T.clean_value("city"))
    rows = q._address(spark, d).select("c_custkey", whole.alias("t"), T.fuzzy_key(whole).alias("n")).orderBy("c_custkey").collect()
    number = lambda n: re.match(r"\d+[a-z]?", n)[0]
    clusters, seen = [], set()
    for _, t, n in rows:
        if t in seen:
            continue
        seen.add(t)
        for c in clusters:
            if number(c[0][1]) == number(n) and SequenceMatcher(None, n, c[0][1]).ratio() >= 0.82:
                c.append((t, n))
                break
        else:
            clusters.append([(t, n)])
    want = sorted(x for c in clusters for x in sorted((t for t, _ in c), key=lambda v: (-len(v), v))[:2])
    assert len(clusters) < len(seen)
    assert sorted(r[0] for r in q.QUERIES["fuzzy_dedup"](spark, d).collect()) == want


def test_uniqueness_reads_long_texts(spark, tmp_path):
    long = "word " * 100
    rows = list(enumerate([long + "a", long + "a", long + "b", "short", "short", "once", None, None]))
    d = put(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path, "documents")
    assert sorted(map(tuple, q.QUERIES["uniqueness"](spark, d).collect())) == [("unique", "short"), ("unique", long + "a")]


def test_close_pairs_reads_every_size(spark, tmp_path):
    rng = random.Random(5)
    parts = [(i, "".join(rng.choice("ab") for _ in range(6)), rng.choice([1, 5, 6, 50])) for i in range(60)]
    d = put(spark.createDataFrame(parts, "p_partkey long, p_name string, p_size int"), tmp_path, "part")

    def near(x, y):
        return int(x != y) if sum(a != b for a, b in zip(x, y, strict=True)) <= 1 else 2

    want = sorted((i, j, near(x, y)) for i, x, s in parts for j, y, z in parts if s == z and i < j and near(x, y) <= 1)
    assert any(parts[i][2] > 5 for i, _, _ in want)
    assert sorted(map(tuple, q.QUERIES["close_pairs"](spark, d).collect())) == want


def test_tool_pairing_and_navigation_read_every_row(spark, tmp_path):
    lines = [(1, n, 0.05 if n % 3 else 0.0) for n in range(1, 6)]
    d = put(spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_tax double"), tmp_path, "lineitem")
    want = [("1-1", "CORRECT", "CORRECT", "both"), ("1-2", "ERROR", "CORRECT", "second_only"), ("1-3", "CORRECT", "NONE", "first_only")]
    assert sorted(map(tuple, q.QUERIES["tool_pairing"](spark, d).collect())) == want
    put(spark.createDataFrame([(1, "F", 3), (2, "O", 1), (3, "P", 2)], "o_orderkey long, o_orderstatus string, o_orderdate int"), tmp_path, "orders")
    assert sorted(map(tuple, q.QUERIES["record_navigation"](spark, d).collect())) == [(1, 3, None), (2, None, 3), (3, 2, 1)]
