"""Global orders, hubs, fuzzy clusters, close pairs, Unicode, literals, special functions, sinks and facets against plain loops."""

import ast
import json
import math
import random
import time
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from driftmark.functions import literals, special, unicode
from driftmark.functions import text as T
from driftmark.operators import explore, graph, order, receipts, scoring
from driftmark.sources import tables


def strings(spark, values, column="x"):
    return spark.createDataFrame(list(enumerate(values)), f"i int, {column} string").repartition(3)


# Global orders


@pytest.mark.parametrize("n", [0, 1, 7, 2000])
def test_numbers_and_neighbours(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.choice([None, "a", "b", str(rng.random())])) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, v string").repartition(5)
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]))
    got = sorted(order.numbered(df, ["v", "k"], "n").collect(), key=lambda r: r["n"])
    assert [r["n"] for r in got] == list(range(1, n + 1)) and [(r["k"], r["v"]) for r in got] == want
    near = {r["k"]: (r["previous"], r["next"]) for r in order.neighbours(df, "k", ["v", "k"]).collect()}
    keys = [None, *[k for k, _ in want], None]
    assert near == {k: (keys[i], keys[i + 2]) for i, (k, _) in enumerate(want)}
    read = df.coalesce(2)
    assert [r["n"] for r in order.in_read_order(read, "n").collect()] == list(range(n))
    assert "Window" not in order.numbered(df, ["v", "k"], "n")._jdf.queryExecution().executedPlan().toString()


def test_null_keys_have_neighbours(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "o int, k string")
    assert {r["o"]: (r["previous"], r["next"]) for r in order.neighbours(df, "k", ["o"]).collect()} == {1: (None, None), 2: ("a", "c"), 3: (None, None)}


# Graph


def test_a_hub_of_a_third_of_the_edges(spark):
    edges = [(0, i) for i in range(3000)] + [(i, i % 700) for i in range(1, 6001)] + [(0, 0), (1, 1)]
    df = spark.createDataFrame(edges, "old int, new int").repartition(6)
    once = set(edges)
    out, into = ({k: sum(1 for e in once if e[s] == k) for k in {e[s] for e in once}} for s in (0, 1))
    name = lambda o, i: ("1" if o == 1 else "M") + "-" + ("1" if i == 1 else "N")
    want = {(o, n): (out[o], into[n], {"1-1": "1-1", "M-1": "1-N", "1-N": "N-1", "M-N": "M-N"}[name(out[o], into[n])]) for o, n in once}
    found = graph.classified(df, "old", "new")
    assert {(r["old"], r["new"]): (r["out_degree"], r["in_degree"], r["relation"]) for r in found.collect()} == want and found.count() == len(once)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    hubs = df.distinct().groupBy("old").count().where(F.col("count") * graph.HUB_SHARE > len(once)).count()
    assert 0 < hubs <= graph.HUB_SHARE


# Fuzzy clusters and close pairs


def clustered(texts, threshold=0.82, keep=2):
    """The greedy rule as a loop."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    once = list(dict.fromkeys(t for t in texts if t is not None))
    keyed = spark.createDataFrame(list(enumerate(once)), "i int, t string").select("i", T.fuzzy_key("t").alias("n")).withColumn("h", T.house_key("n"))
    norm = {r["i"]: (r["n"], r["h"]) for r in keyed.collect()}
    clusters = []
    for i, t in enumerate(once):
        n, h = norm[i]
        for c in clusters:
            if c[0][1] == h and SequenceMatcher(None, n, c[0][0]).ratio() >= threshold:
                c[1].append(t)
                break
        else:
            clusters.append(((n, h), [t]))
    return sorted(t for _, ts in clusters for t in sorted(ts, key=lambda x: (-len(x), x))[:keep])


def receipts_texts(n):
    rng = random.Random(21)
    streets = ["Lê Lợi", "Nguyễn Huệ", "Trần Hưng Đạo", "Hai Bà Trưng", "Lý Thường Kiệt", "Võ Văn Tần"]
    out = []
    for _ in range(n):
        house = rng.choice(["12", "12a", "7/3", "", "", "45-47"])
        t = f"{house} {rng.choice(streets)}, P. {rng.randint(1, 4)}, Q. {rng.randint(1, 3)}, {rng.choice(['TP.HCM', 'Hà Nội', 'Đà Nẵng'])}"
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(t))
            t = t[:at] + rng.choice(["", "x", "o", " ", "1"]) + t[at + rng.randint(0, 1) :]
        out.append(t)
    return out + ["", "  ", "!!", None, "x", "xx", "a" * 300, "a" * 299 + "b"] + out[:10]


@pytest.mark.parametrize("first", [1, 64])
def test_fuzzy_clusters_equal_the_greedy_loop(spark, first):
    texts = receipts_texts(250)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    got = sorted(r["t"] for r in receipts.fuzzy_dedup(df, "t", "i", first=first).collect())
    assert got == clustered(texts) and 20 < len(got) < len(set(texts))
    if first == 64:
        assert receipts.fuzzy_dedup(df.where("false"), "t", "i").collect() == []


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("most", [0, 1, 2])
def test_close_pairs(spark, most):
    rng = random.Random(most)
    rows = [(rng.choice(["k", "l", None]), i if i % 40 else None, rng.choice([None, "", "same"]) if i % 5 == 0 else "".join(rng.choice("abé") for _ in range(rng.randint(0, 5)))) for i in range(160)]
    df = spark.createDataFrame(rows, "k string, i int, t string").repartition(3)
    want = {(a[1], b[1]): d for a in rows for b in rows if None not in a and None not in b and a[0] == b[0] and a[1] < b[1] and (d := distance(a[2], b[2])) <= most}
    got = receipts.close_pairs(df, "k", "i", "t", most).collect()
    assert {(r["a"], r["b"]): r["distance"] for r in got} == want and len(got) == len(want) > 10


# Unicode


def test_composition_and_folding_equal_the_unicode_data(spark):
    rng = random.Random(1)
    t = unicode._tables()
    odd = sorted({*t["apart"], *t["marks"], *t["changed"], *t["seconds"], *t["pairs"]})
    latin = list("aeouAEOUdDsß ,") + [chr(c) for c in (0x300, 0x301, 0x302, 0x303, 0x306, 0x309, 0x31B, 0x323)]
    jamo = [chr(c) for c in (*range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A7, 0x11C3), 0xAC00, 0xAC01, 0xD7A3)]
    indic = [c for c in odd if c in t["seconds"] or set(t["pairs"].get(c, "")) & t["seconds"]] + ["්", "ೕ"]
    texts = [*odd, *("".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(400) for pool in (odd, latin, jamo, indic, odd + latin))]
    texts += [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).casefold() != chr(c)]
    df = strings(spark, texts)
    got = {r[0]: r[1:] for r in df.select("i", unicode.composed(F.col("x")), unicode.casefolded(F.col("x")), T.normalise_text("x")).collect()}
    fold = lambda x: " ".join(unicodedata.normalize("NFC", x.strip().rstrip(", ")).casefold().split())
    for i, x in enumerate(texts):
        assert got[i][0] == unicodedata.normalize("NFC", x), ascii(x)
        assert got[i][1] == x.casefold() or "Σ" in x, ascii(x)
    # The small form for keys does as much wherever no mark is left over.
    plain = [i for i, x in enumerate(texts) if not set(x) - set(latin) and not any(unicodedata.combining(c) for c in unicodedata.normalize("NFC", x))]
    assert len(plain) > 100 and all(got[i][2] == fold(texts[i]) for i in plain)


def test_composition_of_a_megabyte(spark):
    for x in ("áb" * 350_000, "a" + "̣́" * 40_000, "각" * 100_000):
        began = time.time()
        row = spark.createDataFrame([(x,)], "x string").select(unicode.composed(F.col("x")), T.composed("x")).first()
        assert row[0] == unicodedata.normalize("NFC", x) and (len(x) < 100_000 or not set(x) & {"a", "b"} or row[1] == row[0])
        assert time.time() - began < 60


# Literals and special functions


def plain(value):
    if isinstance(value, dict):
        return {"None" if k is None else str(k): plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def test_literals_equal_the_parser(spark):
    rng = random.Random(2)
    alphabet = [*"abé漢'\"\\\n\t\r\x00\x07 {}[](),:None0.5uU", "\U0001f600", "\x0b"]
    some = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 8)))

    def value(depth=0):
        kind = rng.randint(0, 9 if depth < 3 else 5)
        if kind < 6:
            return [some, some, some, lambda: rng.choice([None, True, False]), lambda: rng.randint(-(10**6), 10**6), lambda: rng.choice([0.5, -1e-7, 1e22, 3.0])][kind]()
        if kind < 8:
            return (list if kind == 6 else tuple)(value(depth + 1) for _ in range(rng.randint(0, 3)))
        return {rng.choice([some(), rng.randint(0, 9), None, True]): value(depth + 1) for _ in range(rng.randint(0, 3))}

    texts = [repr({**{some(): value() for _ in range(2)}, "k": value()}) for _ in range(600)]
    texts += ["{'k': 'v',}", "{'k': u'v'}", " {'k':'\\u00e9\\x41\\101'} ", "{'k': 1_000}", "{'k': .5}", "{'k': 5.}", "{'k': +5}", "{'k': '\\d'}", "{'k': '\\\nx'}", "{'k': '\\U0001f600'}", "{'k': 'a', 'k': 'b'}", "{'k': ['a', 'b',], }", "{1: 'a', 'k': 'z'}"]
    texts += ["{'k': }", "{'k' 'x'}", "{'k': 'a", "{k: 1}", "['k']", "'k'", "{'k': nan}", "{'k': [1,,2]}", "{'k': 1 2}", "", " ", "{,}", "{'k': '\\x4'}", "{'k': 'a\nb'}", "{'k': f()}", "{'k': 'v'} x", "{1, 2}", "{'k': 007}", "{'k': 'a'}}", "{'k': 'a'}, {'k': 'b'}"]
    got = {r["i"]: r["v"] for r in strings(spark, texts).select("i", literals.value_of("x", "k").alias("v")).collect()}
    read = 0
    for i, x in enumerate(texts):
        try:
            want = ast.literal_eval(x.strip())
        except (ValueError, SyntaxError):
            want = None
        want = want.get("k") if isinstance(want, dict) else None
        if want is None or isinstance(want, str):
            assert got[i] == want, x
        else:
            assert json.loads(got[i]) == plain(want), x
        read += want is not None
    assert read > 400
    big = "{'k': '" + "a\\'b\\u00e9 " * 200_000 + "'}"
    began = time.time()
    assert spark.createDataFrame([(big,)], "x string").select(literals.value_of("x", "k")).first()[0] == ast.literal_eval(big)["k"] and time.time() - began < 60
    assert [r["text"] for r in tables.literal_field(spark.createDataFrame([("{'Địa chỉ': '12 Lê Lợi'}",), ("{",), (None,)], "x string"), "x", "Địa chỉ").collect()] == ["12 Lê Lợi", None, None]


def test_erfc_and_published_p_values(spark):
    zs = [0.0, 1e-12, 0.1, 0.5, 1.0, 1.5, 1.999, 2.0, 2.5, 3.0, 5.0, 10.0, 15.6, 22.01, 23.36, 26.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", special.erfc(F.col("z")).alias("p")).collect()
    assert all(r["p"] == pytest.approx(math.erfc(r["z"]), rel=1e-11) for r in got)
    odd = spark.createDataFrame([(None,), (-1.0,), (float("nan"),), (40.0,)], "z double").select(special.erfc(F.col("z"))).collect()
    assert odd[0][0] is None and odd[1][0] is None and math.isnan(odd[2][0]) and odd[3][0] == 0.0
    for stat, p in ((969.0, 9.83e-213), (1091.0, 2.98e-239), (23.1, 1.56e-06)):
        found = scoring.with_p_value(spark.createDataFrame([(stat,)], "statistic double")).first()["p_value"]
        assert found == pytest.approx(math.erfc(math.sqrt(stat / 2)), rel=1e-9) and found == pytest.approx(p, rel=0.2)


# Sinks and facets


def test_single_files_equal_a_row_by_row_writer(spark, tmp_path):
    import csv

    rows = [(i, v, None if i % 3 else "x") for i, v in enumerate(["plain", "a,b", 'say "x"', "two\nlines", "cr\r", "", None, " é "] * 5)]
    df = spark.createDataFrame(rows, "`i,d` int, v string, w string").repartitionByRange(4, "`i,d`").sortWithinPartitions("`i,d`")
    tables.write_csv(df, tmp_path / "a.csv")
    with open(tmp_path / "b.csv", "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(df.columns)
        out.writerows(["" if v is None else v for v in r] for r in rows)
    assert (tmp_path / "a.csv").read_bytes() == (tmp_path / "b.csv").read_bytes()
    tables.write_csv(df.select("v"), tmp_path / "one.csv")
    assert [r["v"] for r in tables.read_csv(spark, str(tmp_path / "one.csv")).collect()].count("") == 10
    tables.write_csv(df.where("false"), tmp_path / "none.csv")
    assert (tmp_path / "none.csv").read_bytes() == tables.BOM + b'"i,d",v,w\n'
    tables.write_json_lines(df, tmp_path / "a.jsonl")
    assert [json.loads(x) for x in (tmp_path / "a.jsonl").read_text(encoding="utf-8").splitlines()] == [dict(zip(df.columns, r, strict=True)) for r in rows]
    with pytest.raises(FileExistsError):
        tables.write_csv(df, tmp_path / "a.csv")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.csv", "a.jsonl", "b.csv", "none.csv", "one.csv"]


def test_facets_and_pages(spark):
    rows = [(i, "ab"[i % 2], None if i % 5 == 0 else str(i % 3)) for i in range(130)]
    df = spark.createDataFrame(rows, "k int, a string, b string").repartition(3)
    got = {(r["facet"], r["option"]): r["n"] for r in explore.facets(df, ["a", "b"]).collect()}
    assert got == {("a", x): sum(r[1] == x for r in rows) for x in "ab"} | {("b", x): sum((r[2] or "") == x for r in rows) for x in ("", "0", "1", "2")}
    want, seen, after = [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]))], [], None
    while page := explore.seek(df, ["a", "k"], after, 50).collect():
        seen += [r["k"] for r in page]
        after = (page[-1]["a"], page[-1]["k"])
    assert seen == want
