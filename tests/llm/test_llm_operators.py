"""Each operator against brute force on small tables with odd rows: nulls, empty and long texts, ties, repeats, clashing columns."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmark.llm import bitslice, components, decontaminate, licences, nearjoin, packing, personal, pseudolm, quality, repair, shared, tokens, warc
from driftmark.llm.queries import vocabulary

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BYTE, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words_of(text):
    return WORD.findall(fold(text))


def prose(rng, n):
    return " ".join("".join(rng.choice(["the", "er", "on", "sh", "é", "ü"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [prose(rng, rng.choice([3, 20, 60, 300])) for _ in range(30)]
    near = [b + " " + prose(rng, 2) for b in base[:8]]
    odd = [None, "", " ", "one", "x\n\ny  z", "<|endoftext|> a <|startoftext|>", "ΑΣ 漢字 é́ İx", "A" * 3000, "don't 12 34!! a's", prose(rng, 5000)]
    return base + near + odd + base[:3]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "src", "lang", "clash", 1.0) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[2]], "doc_id long, text string, source string, lang string, start string, rank double").repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string")


def encoded(path, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_encoders_equal_the_library(texts):
    extra = ["a\x1cb \x85", "İ ª²½ \xad", "x  y \t z", "tail ", " lead", "\x00 \x7f"]
    for t in [*texts, *extra]:
        assert tokens.byte_encoder(BYTE).ids(t).tolist() == encoded(BYTE, t)
        assert np.frombuffer(tokens.word_encoder(WORDS).ids(t), "<u4").tolist() == encoded(WORDS, t)


def test_bitslice(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 6).astype("f4")], "clash") for i in range(400)]
    rows[7] = (7, rows[0][1], "clash")
    rows[8] = (8, rows[0][1], "clash")
    rows += [(500, None, ""), (600, [0.1, None, 0.0, 0.0, 0.0, 0.0], ""), (700, [float("nan")] * 6, ""), (800, [float("inf")] * 6, ""), (900, [0.5, -0.5], ""), (1000, [0.0] * 6, "")]
    rows += [(100, [0.3, -0.4, 0.1, 0.0, 0.9, -0.2], "other"), (100, rows[100][1], "repeat"), (None, [0.1] * 6, ""), (1100, [200000.0, -3.0, 0.25, 0.0, 0.0, 1e7], ""), (1101, [-1e12, 4.0, 0.5, 0.0, 0.0, 0.0], ""), (1200, [1e30, 0.0, 0.0, 0.0, 0.0, 0.0], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    good = [(i, [math.floor(1024 * Fraction(float(np.float32(x)))) for x in v] + [0] * (6 - len(v))) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q in {i for i, _ in good if i % 100 == 0}:
        asked = [w for i, w in good if i == q]
        best = sorted((-max(sum(a * b for a, b in zip(w, v, strict=True)) for w in asked), i) for i, v in good if i != q)[:10]
        want |= {(q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(best)}
    for bits, rows_, blocks in ((3, 64, 2), (7, 64, 1), (7, 16384, 8)):
        got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in bitslice.search(df, slice_bits=bits, block_rows=rows_, task_blocks=blocks).collect()]
        assert sorted(got) == sorted(want)
    assert bitslice.search(df.limit(0)).count() == 0


def test_licences(spark):
    t, rng = licences.TEMPLATES, random.Random(6)
    mit, gpl = t["mit/text"], t["gpl-3.0"]
    wrapped = lambda x, n: re.sub(r"((?:\S+\s+){%d})" % n, r"\1\n * ", x)
    changed = mit.split()
    for i in range(3, len(changed), 20):
        changed[i] = "other"
    rows = [(1, f"Some text.\n  {gpl.upper()}  \nmore"), (2, None), (3, ""), (4, "license"), (5, f"{gpl}\n{gpl}"), (6, "/*\n * Copyright 2020 Foo\n *\n * " + wrapped(mit, 9) + "\n */ int main"), (7, "Licensed under the Apache License, Version 3."), (1, "Released under the MIT License."), (8, "word license " * 3000), (9, "Copyright 2020 Foo. Released under the MIT License."), (10, " ".join(changed)), (11, " ".join(mit.split()[:70])), (12, wrapped(t["isc/text"], 7)), (13, prose(rng, 500) + t["bsd-2/text"] + prose(rng, 500) + t["zlib/text"]), (None, t["mit"] + "\u212a"), (14, "İ" + t["unlicense"])]
    df = spark.createDataFrame([(a, b, "x", "y") for a, b in rows], "doc_id long, text string, matches string, dm_low string")

    def brute(text):
        words, out = licences.words_of(text or ""), []
        for k, x in sorted(t.items()):
            own, grams = licences.words_of(x), set(licences.bigrams(x))
            place = dict(licences.anchors(x, 0.8))
            best = []
            for i, g in enumerate(f"{a} {b}" for a, b in zip(words, words[1:])):
                if g in place:
                    s = max(0, min(i - place[g], len(words) - len(own)))
                    have = set(licences.bigrams(" ".join(words[s : s + len(own)])))
                    best.append((-2 * len(have & grams) / (len(have) + len(grams)), s))
            if best and min(best)[0] <= -0.8 + 1e-12:
                out.append((k.split("/")[0], round(-min(best)[0], 9), min(best)[1]))
        return out

    got = licences.scan(df).collect()
    assert sorted(((r["doc_id"], [(m["licence"], round(m["dice"], 9), m["start"]) for m in r["matches"]]) for r in got), key=str) == sorted(((i, brute(x)) for i, x in rows), key=str)
    by = {r["doc_id"]: {m["licence"] for m in r["matches"]} for r in got if r["doc_id"] not in (1, None)}
    assert by[6] == by[9] == by[10] == {"mit"} and by[12] == {"isc"} and {"bsd-2", "zlib"} <= by[13] and not by[7] and not by[8] and by[14] == {"unlicense"}
    assert all(brute(x) and brute(x)[0][1] <= 1 for x in t.values())
    assert licences.scan(df.limit(0)).count() == 0


def test_any_window_over_the_threshold_holds_an_anchor():
    """Every set of bigrams with the needed share of a template's has one of its anchors."""
    rng = random.Random(1)
    for x in licences.TEMPLATES.values():
        grams, own = licences.bigrams(x), {g for g, _ in licences.anchors(x, 0.8)}
        for _ in range(20):
            have = set(rng.sample(grams, -(-len(grams) * 2 // 3)))
            more = sum(g not in grams for g in have)
            if 2 * len(have) / (len(have) + more + len(grams)) >= 0.8:
                assert have & own


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_personal(spark):
    rng = random.Random(5)
    rows = ["mail a@b.co, x.y@c-d.org_e@f.de.", "1.2.3.4 1.2.3.4.5 256.1.1.1 001.02.003.255 9.9.9.9.9.9.9.9", "4111 1111 1111 1111 and 4111111111111112 or 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "+1 (234) 555-6789 +12 +1--2 ++49 (0) 30 123456 7", None, "", "é😀 a@b.co é 10.0.0.1", "9" * 60000, "a" * 60000 + "@b.c", "a@" * 500, "call 234-567-8901 now; write to joe (at) site (dot) com", "+1-2-3-4-5-6-7-8-9.0.1.2@x.y"]
    rows += ["".join(rng.choice("ab1 9.@+-()\n😀") for _ in range(200)) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r["spans"] for r in personal.personal_data(df).collect()}
    for i, t in enumerate(rows):
        base = [(s["start"], personal.KINDS.index(s["kind"]), s["stop"]) for s in got[i] if s["base"]]
        assert base == base_spans(t), (i, t[:80] if t else t)
        more = [s for s in got[i] if not s["base"]]
        assert all(s["stop"] <= a or b <= s["start"] for s in more for a, _, b in base)
    text = df.where("doc_id = 0").withColumn("s", personal.final_spans(personal.candidates(F.col("text")), {})).select(personal.redacted(F.col("text"), F.col("s"))).first()[0]
    assert text == "mail <EMAIL>, <EMAIL><EMAIL>."
    assert personal.personal_data(df.limit(0)).count() == 0


def test_weak_supervision_learns_reliable_labelers(spark):
    def cand(base, v, n):
        return [(i, [{"start": 0, "stop": 3, "kind": 3, "base": base, "v": v, "f": 0}]) for i in range(n)]

    rows = cand(True, [1, 1, 1, 1], 60) + cand(False, [-1, 1, 1, 1], 40) + cand(False, [-1, -1, 0, -1], 80)
    df = spark.createDataFrame(rows, "doc_id long, spans array<struct<start:long,stop:long,kind:int,base:boolean,v:array<int>,f:int>>")
    accepted = personal.learn(df)
    assert accepted[3, (1, 1, 1, 1), 0] and not accepted[3, (-1, -1, 0, -1), 0]
    assert personal.learn(df.limit(0)) == {}


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    for base, high in ((50, 40), (70000, 60), (65530, 30)):
        ids = rng.integers(0, high, 4000) * (1 if base < 65536 else 7)
        ids[1000:2000] = 5  # a run of one id
        ends = np.array([0, 0, 3, 1500, 1500, 4000])
        data = repair.to_bytes([3, None, 4, 4, 5, 6], ids, ends, max(base, int(ids.max()) + 1))
        seg = repair.Segment(data)
        assert seg.doc_ids == [3, None, 4, 4, 5, 6]
        a = 0
        for k, b in enumerate(ends):
            assert seg.document(k).tolist() == ids[a:b].tolist()
            for s, t in ((0, 1), (2, 9), (0, b - a)):
                assert seg.stretch(k, s, min(t, b - a)).tolist() == ids[a : min(a + t, b)][s:].tolist()
            a = b
        assert (repair.expand_all(seg.symbols, seg.base, seg.rules, seg.sizes) == ids).all()
        assert len(seg.symbols) < len(ids)
    with pytest.raises(ValueError):
        repair.Segment(data[:-1] + b"x")


def test_repair_files(spark, docs, texts):
    out = shared.scratch(spark, "t")
    manifest = repair.write(docs, out, WORDS, shard_rows=7, segment_ids=500)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in repair.read(manifest, out).collect())
    want, at = [], 0
    for i, t in sorted([*enumerate(texts), (2, texts[2])]):
        ids = [*encoded(WORDS, t), 1]
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == want and manifest.count() > 5
    again = shared.scratch(spark, "t")
    assert sorted(repair.write(docs.repartition(2), again, WORDS, shard_rows=7, segment_ids=500).collect()) == sorted(manifest.collect())
    none = shared.scratch(spark, "t")
    assert repair.read(repair.write(empty(spark), none, WORDS), none).count() == 0


def contaminated(text, items, window):
    words, hit, found = words_of(text), set(), set()
    for item, t in items:
        w = words_of(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[k : k + n]:
                    hit.update(range(i, i + n))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize(("block", "chunk"), [(1_000_000, 10**6), (8, 50)])
def test_decontaminate(spark, tmp_path, block, chunk):
    rng = random.Random(2)
    items = [(1, "a b c d"), (2, "B, c! d e f g"), (3, None), (4, ""), (5, "x"), (6, "é ü é"), (10, "a b c d"), (None, "r s t q"), (12, " ".join(prose(rng, 1) + str(k) for k in range(40)))]
    rows = [(i, " ".join(rng.choice("A b-c,d e.f g x é ü q r s t".split(" ")) for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(60, None), (61, ""), (61, "a  B\nc d"), (None, "r s T. q"), (63, "a b c d " * 9000), (64, items[-1][1] + " B c d e f"), (62, "xx é_ü é")]
    spark.createDataFrame([(*r, "c", "d") for r in rows], "doc_id long, text string, n_hit string, c0 string").repartition(3).write.parquet(f"{tmp_path}/d")
    df = spark.read.parquet(f"{tmp_path}/d")
    bench = spark.createDataFrame(items, "item_id long, text string")
    blocks = decontaminate.patterns(bench, "item_id", "text", 3, block, "t")[1]
    assert blocks == 1 if block > 100 else blocks > 20
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], tuple(r["items"])) for r in decontaminate.contamination(df, bench, window=3, block_bytes=block, chunk=chunk).collect())
    named = [("" if i is None else i, t) for i, t in items]
    found = [(i, t, *contaminated(t, named, 3)) for i, t in rows]
    assert got == collections.Counter((i, n, h, len(f), tuple(f)) for i, _, n, h, f in found)
    spans = {r["doc_id"]: r["spans"] for r in decontaminate.contamination(df.where("doc_id = 62"), bench, window=3, block_bytes=block).collect()}
    assert [rows[-1][1][s["start"] : s["stop"]] for s in spans[62]] == ["é_ü é"]
    for given in (df, df.repartition(5)):
        clean = decontaminate.clean(given, bench, window=3, block_bytes=block, chunk=chunk)
        assert clean.columns == df.columns
        assert sorted(clean.collect(), key=str) == sorted([r for r in df.collect() if not contaminated(r["text"], named, 3)[1]], key=str)
    assert decontaminate.contamination(df, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.clean(df, bench.limit(0)).count() == df.count()
    assert decontaminate.contamination(df.limit(0), bench).count() == 0


def test_pseudo_likelihood(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        w = []
        for _ in range(rng.randint(5, 60)):
            k = rng.randint(0, 30)
            w += [f"head{k}", f"mid{k}", f"tail{k}"]
        rows.append((i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, " ".join(rng.sample(rows[0][1].split(), len(rows[0][1].split())))), (303, "unseen " * 4000), (0, rows[0][1]), (None, "head1 mid1")]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, n int, ids string").repartition(2)
    got = {r["doc_id"]: r for r in pseudolm.pseudo_likelihood(df, rounds=8).collect()}
    assert got[None]["n_words"] == 2 and got[300]["n_words"] == 0 and got[301]["log_prob"] == 0 and got[301]["mean_log_prob"] is None
    assert got[0]["mean_log_prob"] > got[302]["mean_log_prob"] + 1  # the same words out of order
    words = pseudolm.vocabulary(pseudolm.word_counts(df, "text"))
    raw, fitted = pseudolm.Network(pseudolm.start(), words), pseudolm.Network(pseudolm.fit(pseudolm.symbolised(df, words), words, rounds=8), words)
    held = " ".join(f"head{k} mid{k} tail{k}" for k in range(30))
    assert fitted.scores([held])[0][1] > raw.scores([held])[0][1]
    p = sum(np.exp(fitted.log_probs(np.array([1, 2, s, 3, 4]), np.array([2]))[0] + fitted.extra[s]) for s in range(pseudolm.SYMBOLS))
    assert abs(p - 1) < 1e-3  # a distribution over symbols
    assert pseudolm.pseudo_likelihood(df.limit(0)).count() == 0


def test_packing(spark, docs, texts):
    for cap in (64, 2048):
        got = packing.pack(docs, BYTE, capacity=cap, islands=2, epochs=2).collect()
        by = collections.defaultdict(list)
        bins = collections.defaultdict(list)
        for r in got:
            by[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        total = 0
        for i, t in enumerate(texts):
            ids = [*encoded(BYTE, t), 0]
            cuts = list(range(len(ids) % cap or cap, len(ids) + 1, cap))
            want = [(k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip([0, *cuts[:-1]], cuts))]
            assert sorted(by[i]) == sorted(want * (2 if i == 2 else 1))
            total += len(ids) * (2 if i == 2 else 1)
        for own in bins.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= cap
        assert len(bins) <= 1.1 * total / cap + 2
    assert packing.pack(empty(spark), BYTE).count() == 0


def test_genetic_operators_keep_every_document():
    rng = random.Random(0)
    sizes = {n: rng.randint(1, 9) for n in rng.sample(range(1, 100), 60)}
    count = lambda plan: collections.Counter({n: sum(k * m for p, m in plan.items() for q, k in p if q == n) for n in sizes})
    a = packing.best_fit({}, sorted(sizes.items(), reverse=True), 100)
    b = packing.best_fit({}, sorted(sizes.items()), 100)
    for plan in (a, b, packing.crossover(a, b, sizes, 100, rng), packing.mutate(b, 100, rng), packing.evolve(sizes, 100, 1, [b])):
        assert count(plan) == collections.Counter(sizes)
        assert all(packing.fill(p) <= 100 for p in plan)
    best = packing.evolve(sizes, 100, 1, [b])
    assert packing.cost(best, 100) <= packing.cost(b, 100)


def test_crossover_and_migration_beat_best_fit(spark):
    """Triplets that fill bins exactly: best fit stays above the bound, islands come below it."""
    rng, sizes, cap = random.Random(4), collections.Counter(), 1000
    for _ in range(60):
        a = rng.randint(380, 490)
        b = rng.randint(250, (cap - a) // 2)
        sizes.update((a, b, cap - a - b))
    plain = sum(packing.best_fit({}, sorted(sizes.items(), reverse=True), cap).values())
    alone = packing.evolve(dict(sizes), cap, 1, [])
    plan = packing.plan_islands(spark, dict(sizes), cap)
    assert sum(plan.values()) < plain and packing.cost(plan, cap) <= packing.cost(alone, cap)
    got = collections.Counter()
    for p, m in plan.items():
        assert packing.fill(p) <= cap
        for n, k in p:
            got[n] += m * k
    assert got == sizes


def test_warc(spark):
    long, short = "<p>" + "x" * 2000, "short"
    rows = [(1, "http://a/\r\nb c", long), (5, None, long), (3, "u", long), (2, "u", short), (4, "u", short), (6, "u", None), (7, "u", "é" * 600), (8, "u", "é" * 600), (None, "u", long), (5, "again", long), (9, "u", "y" * 100000), (5, "other", "z" * 1500)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, kind string").repartition(3)
    out = shared.scratch(spark, "w")
    manifest = warc.write(df, out, shard_bytes=3000, roll_bytes=600)
    got = sorted(map(tuple, warc.read(manifest, out).collect()), key=str)
    want, seen = [], set()
    for page, _, html in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (html or "").encode()
        same = [p for p, _, h in rows if h == html and p is not None]
        to = None
        if len(raw) >= 1000 and page is not None:
            to = max(same) if page < max(same) or (page, html) in seen else None
            seen.add((page, html))
        want.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if to is not None else "response", to))
    assert got == sorted(want, key=str)
    again = shared.scratch(spark, "w")
    assert sorted(warc.write(df.repartition(1), again, shard_bytes=3000, roll_bytes=600).collect()) == sorted(manifest.collect())
    none = shared.scratch(spark, "w")
    assert warc.read(warc.write(df.limit(0), none), none).count() == 0


def labelled(spark, n=900):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randint(10, 80)).split()
        quality_, toxic = 1, 0
        if i % 9 == 0:
            words = [w + "***" for w in words]
            quality_ = 0
        elif i % 7 == 0:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["vilest", "rotten", "badword" + rng.choice(["ly", "ness", "ity"])]))
            toxic = 1
        rows.append((i, " ".join(words), f"s{i % 5}" if i % 3 else None, "en"))
        labels.append((i, quality_, toxic))
    df = spark.createDataFrame([*rows, (n, None, "s1", None), (n + 1, "", None, None)], "doc_id long, text string, source string, lang string")
    return df, spark.createDataFrame([*labels, (None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = labelled(spark)
    model = quality.fit(docs, labels.where("doc_id % 2 = 0 or doc_id is null"))
    scores = quality.scored(docs, model)
    out = quality.judged(scores, quality.posteriors(scores.drop("text"), "source", "lang"), "source", "lang")
    truth = {r["doc_id"]: r["quality"] == 1 and r["toxic"] == 0 for r in labels.where("doc_id is not null and quality is not null").collect()}
    got = {r["doc_id"]: r["dm_bad"] < quality.KEEP_BELOW for r in out.collect()}
    held = [i for i in truth if i % 2]
    assert len(got) == 902
    assert sum(got[i] == truth[i] for i in held) / len(held) > 0.97
    assert all(got[i] for i in held if truth[i])
    plain = quality.scored(docs, quality.fit(docs, labels.limit(0)))
    assert plain.where("dm_quality <> 0 or dm_toxic <> 0").count() == 0
    assert quality.scored(docs.limit(0), model).count() == 0


def test_posteriors_shrink_sparse_sites(spark):
    rows = [("big", "a", 2.0)] * 200 + [("big", "b", -2.0)] * 200 + [("fine", "a", -3.0)] * 400 + [("tiny", "a", 3.0)]
    df = spark.createDataFrame(rows, "source string, lang string, dm_quality double").withColumn("dm_toxic", F.lit(-30.0))
    shift = {(r["dm_host"], r["dm_path"]): r["dm_shift"] for r in quality.posteriors(df, "source", "lang").collect()}
    assert shift["big", "a"] > shift["tiny", "a"] > shift["fine", "a"]
    assert shift["big", "a"] > shift["big", "b"]


def test_posteriors_equal_plain_moments(spark):
    """The shrunken rates of hosts and paths against the same moments in plain Python."""
    rng = random.Random(3)
    rows = [(h, p, rng.gauss({"a": -2, "b": 0, None: 1}[h], 1.5), rng.gauss(-3, 1)) for h in ("a", "b", None) for p in ("x", "y", None) for _ in range(rng.randint(1, 60))]
    df = spark.createDataFrame([*rows, rows[0]], "source string, lang string, dm_quality double, dm_toxic double").repartition(3)
    rate = lambda x: 1 / (1 + math.exp(-max(-30, min(30, x))))
    bad = lambda q, t: 1 - (1 - rate(q)) * (1 - rate(t))
    logit = lambda p: math.log(max(1e-6, min(1 - 1e-6, p)) / (1 - max(1e-6, min(1 - 1e-6, p))))
    hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
    for h, p, q, t in [*rows, rows[0]]:
        hosts[h].append(bad(q, t))
        paths[h, p].append(bad(q, t))
    every = [x for v in hosts.values() for x in v]
    centre = (sum(every) + 1) / (len(every) + 2)

    def strength(groups):
        n = sum(k for k, *_ in groups)
        within = sum(k * c * (1 - c) for k, _, c in groups)
        between = sum(k * (m - c) ** 2 for k, m, c in groups)
        var = within / n
        return max(1.0, var / max((between - len(groups) * var) / n, var / 1e4) - 1)

    a = strength([(len(v), sum(v) / len(v), centre) for v in hosts.values()])
    mean = {h: (a * centre + sum(v)) / (a + len(v)) for h, v in hosts.items()}
    b = strength([(len(v), sum(v) / len(v), mean[k[0]]) for k, v in paths.items()])
    want = {k: logit((b * mean[k[0]] + sum(v)) / (b + len(v))) - logit(centre) for k, v in paths.items()}
    shifts = quality.posteriors(df, "source", "lang")
    got = {(r["dm_host"], r["dm_path"]): r["dm_shift"] for r in shifts.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    for most in (100_000, 1):  # broadcast or joined
        out = quality.judged(df, shifts, "source", "lang", most).collect()
        assert sorted(r["dm_bad"] for r in out) == pytest.approx(sorted(logit(bad(q, t)) + want[h, p] for h, p, q, t in [*rows, rows[0]]))


def test_labels_and_documents_that_repeat(spark):
    """One text for each labelled id, the worst label, never more than ``most``; columns with inner names are not read."""
    docs = spark.createDataFrame([(1, "b b", "q"), (1, "a a", "q"), (2, None, "q"), (3, "long " * 50000, "q"), (None, "x", "q")], "doc_id long, text string, dm_bad string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 1, 0), (2, 1, 0), (3, 1, 1), (None, 0, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    got = {(r["dm_id"], r["quality"], r["toxic"], len(r["text"])) for r in quality.labelled(docs, labels).collect()}
    assert got == {(1, 0, 1, 3), (2, 1, 0, 0), (3, 1, 1, 250000)}
    assert quality.labelled(docs, labels, most=2).count() <= 2
    assert quality.scored(docs, quality.fit(docs, labels)).count() == 5


def test_sites_of_urls(spark):
    urls = ["https://User@Www.A.org:8080/b/c/d.html?x#y", "http://a.org", "//a.org/x", "http://a.org/x/?q=/z/", None, "mailto:x"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    host, path = quality.site_of(F.col("u"))
    assert [tuple(r) for r in df.select(host, path).collect()] == [("www.a.org", "/b/"), ("a.org", "/"), ("a.org", "/"), ("a.org", "/x/"), (None, None), ("", "/")]


def jaccard_classes(rows, width=5):
    sets = []
    for _, t in rows:
        w = words_of(t)
        k = min(width, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, least[find(i)], links[i]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("limit", "block"), [(512, 1024), (4, 8)])
def test_nearjoin(spark, limit, block):
    rng = random.Random(11)
    rows = []
    for _ in range(12):
        words = prose(rng, rng.choice([6, 12, 40, 150])).split()
        for _ in range(rng.randint(1, 5)):
            w = list(words)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = prose(rng, 1)
            rows.append(" ".join(w))
    big = prose(rng, 200).split()
    for _ in range(40):
        w = list(big)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        rows.append(" ".join(w))
    rows += [rows[0]] * 30 + [None, "", "", " ,", "one two", "One, two", "one two three", prose(rng, 20000)]
    rows = list(enumerate(rows)) + [(2, rows[2])]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, node string").repartition(3)
    got = sorted(map(tuple, nearjoin.near_duplicates(df, limit=limit, block=block, shingles=5000 * block).collect()))
    want = jaccard_classes(rows)
    assert got == want
    assert nearjoin.near_duplicates(df, limit=limit, shingles=100).exceptAll(spark.createDataFrame(want, "doc_id long, class_id long, n_links long")).count() == 0
    assert nearjoin.near_duplicates(df.limit(0)).count() == 0


def test_deduplicated_keeps_one_row_of_each_class(spark):
    rng = random.Random(12)
    a, b = prose(rng, 80), prose(rng, 60)
    rows = [(5, a), (3, a + " end"), (None, a), (7, b), (7, b), (7, prose(rng, 40)), (8, None), (8, None), (9, " ,"), (None, prose(rng, 50)), (None, "x y")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, node string, c0 int").repartition(3)
    got = nearjoin.deduplicated(df)
    assert got.columns == df.columns
    want = [rows[i] for i in (1, 3, 5, 6, 7, 8, 9, 10)]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)
    links = collections.Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in nearjoin.near_duplicates(df).collect())
    assert links[None, 3, 2] == 1 and links[7, 7, 1] == 2 and links[7, 7, 0] == 1 and links[None, None, 0] == 2
    assert nearjoin.deduplicated(df.limit(0)).count() == 0


def test_sketches_agree_with_jaccard():
    rng = np.random.default_rng(0)
    s = nearjoin.Shingler(5)
    for n in (8, 40, 400):
        error = []
        for _ in range(60):
            common, a, b = rng.integers(0, 1 << 63, n, dtype="u8"), rng.integers(0, 1 << 63, n // 8, dtype="u8"), rng.integers(0, 1 << 63, n // 8, dtype="u8")
            x, y = np.unique(np.concatenate([common, a])), np.unique(np.concatenate([common, b]))
            error.append((s.sketch(x) == s.sketch(y)).mean() - len(np.intersect1d(x, y)) / len(np.union1d(x, y)))
        assert abs(np.mean(error)) < 0.05


def test_overlaps():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 300, dtype="u8") * 2
    sets = [np.unique(rng.choice(pool, rng.integers(1, 200))) for _ in range(20)]
    for most in (10**6, 100):
        got = nearjoin.overlaps(sets, most)
        for i in range(20):
            for j in range(20):
                assert got[i, j] == len(np.intersect1d(sets[i], sets[j])) or i == j
    assert nearjoin.overlaps(sets[:2])[0, 1] == len(np.intersect1d(*sets[:2]))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)] + [(3, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {(x, find(x)) for x in list(root) if find(x) != x}
    got = components.components(spark.createDataFrame(edges, "u long, v long"), "t")
    assert {(r["node"], r["root"]) for r in got.collect()} == want
    assert components.components(spark.createDataFrame([], "u long, v long"), "t").count() == 0


def test_range_cuts(spark):
    keys = [0, 5, -(2**62), 2**62, 7, None] + list(range(1000, 3000)) + [10**15 + i for i in range(500)]
    df = spark.createDataFrame([(k,) for k in keys], "k long").withColumn("w", F.lit(1))
    cuts = shared.range_cuts(df, "k", F.col("w"), 100)
    got = shared.with_range(df, "k", cuts, "r").groupBy("r").agg(F.count("*").alias("n"), F.min("k").alias("a"), F.max("k").alias("b")).orderBy("r").collect()
    assert max(r["n"] for r in got) <= 101
    spans = [(r["a"], r["b"]) for r in got if r["a"] is not None]
    assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
    assert shared.range_cuts(df.limit(0), "k", F.col("w"), 1) == (0, 0, [])
