"""Personal data by weak supervision, in DataFrame functions alone.

Base spans are the leftmost non-overlapping matches of one pattern for each kind. Looser patterns
(spelled-out addresses, numbers without a country code, longer addresses of the network) add
candidates. Labelers vote on every candidate: the strict pattern, a gazetteer (top-level domains,
calling codes and area codes, card issuers, address ranges), words of context before the span, and
the shape of the match. Expectation-maximisation over the counted vote patterns estimates how
reliable each labeler is for each kind, and a logistic span classifier is trained on the posteriors
with features of the surroundings. Candidates that it accepts and that overlap no base span join the
base spans, which always stay.

The vote patterns and features are counted over all documents; there are at most a few hundred of
them, and only those counts reach the driver. Texts are read once: the spans go to a table.

A null text counts as empty; texts without spans have the digest of the empty string; repeated rows
give a row each; an empty table gives none, and then nothing is learned. Columns beside the id and
the text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

KINDS = ("email", "ip", "card", "phone")

# The lookbehinds and \G only keep a failing search linear: a match begins where its run of
# characters begins or where the last match ended. Possessive loops do not recurse.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)\b[a-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[a-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[a-z0-9-]{1,63}){1,4}",
    "ip": r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+.(-])(?:00[1-9][0-9]{0,2}[ .-])?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
}
NEEDS = {
    "email": (lambda t: t.contains("@"), lambda t: F.lower(t).rlike(r"[(\[]at[)\]]")),
    "ip": (lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda t: t.rlike(r"(?i)[0-9a-f]:[0-9a-f]")),
    "card": (lambda t: t.rlike(r"[0-9][ -]?[0-9]"), lambda t: t.rlike(r"[0-9]{4}[./_][0-9]{4}[./_][0-9]{4}")),
    "phone": (lambda t: t.rlike(r"\+[0-9]"), lambda t: t.rlike(r"[0-9]{3}[ .-][0-9]{4}")),
}
CONTEXT = {
    "email": r"(?i)(mail|contact|write|reach|send|kontakt|courriel|correo|schreib)",
    "ip": r"(?i)(\bip\b|address|host|server|login|adresse|direcci)",
    "card": r"(?i)(card|visa|master|credit|debit|pay|karte|carte|tarjeta)",
    "phone": r"(?i)(phone|tel|call|mobile|cell|fax|dial|ruf|appel|llam)",
}
GAZETTEER = {
    "email": r"(?i)[.\])] ?(?:com|org|net|edu|gov|mil|int|info|io|biz|co|uk|de|fr|es|it|nl|eu|us|ca|au|ch|at|be|pl|pt|ru|jp|cn|in|br|mx)$",
    "ip": r"^(?!0|22[4-9]|2[3-5][0-9]|127\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|36|38|30|6011|65|35)",
    "phone": r"^(?:\+|00)(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})|^\(?[2-9][0-9]{2}",
}
LABELERS = ("regex", "gazetteer", "context", "shape")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, op) -> Column:
    """The inclusive running totals of an array under an associative operation.

    Blocks of 128 are totalled one by one, then the blocks' totals in the same way, so that no step copies more than a block (or n / 2^14 totals).
    """
    wide = 128
    totals = lambda v: F.aggregate(F.slice(v, F.lit(2), F.size(v)), F.slice(v, F.lit(1), F.lit(1)), lambda a, x: F.concat(a, F.array(op(F.element_at(a, F.lit(-1)), x))))

    def level(v: Column, within) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / wide).cast("int")), lambda i: totals(F.slice(v, i * wide + 1, F.lit(wide))))

        def moved(bs):
            before = within(F.transform(F.slice(bs, F.lit(1), F.size(bs) - 1), lambda b: F.element_at(b, F.lit(-1))))
            return _let(before, lambda o: F.flatten(F.transform(bs, lambda b, k: F.when(k == 0, b).otherwise(F.transform(b, lambda x: op(F.get(o, k - 1), x))))))

        return F.when(F.size(v) <= wide, totals(v)).otherwise(_let(blocks, moved))

    return _let(values, lambda v: level(v, lambda t: _let(t, lambda u: level(u, totals))))


def _spans(text: Column, pattern: str, there: Column) -> Column:
    """Leftmost non-overlapping matches: start (code points), m, before (32 characters), after (1)."""

    def places(z):
        sizes = F.zip_with(F.slice(z["gaps"], F.lit(1), F.size(z["hits"])), z["hits"], lambda g, m: (F.length(g) + F.length(m)).cast("long"))
        return _let(running(sizes, lambda a, b: a + b), lambda ends: F.transform(z["hits"], lambda m, i: F.struct((ends[i] - F.length(m)).alias("start"), m.alias("m"), F.right(z["gaps"][i], F.lit(32)).alias("before"), F.left(z["gaps"][i + 1], F.lit(1)).alias("after"))))

    none = F.array().cast("array<struct<start:bigint,m:string,before:string,after:string>>")
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.when(there, _let(both, lambda z: F.when(F.size(z["hits"]) > 0, places(z)).otherwise(none))).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: _let(F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def _card(m: Column) -> Column:
    return _let(_digits(m), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))


def _holds(kind: str, m: Column) -> Column:
    """The base rule beyond the pattern."""
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return m.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return _card(m)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _shape(kind: str, m: Column) -> Column:
    """Whether the match looks as its kind usually does."""
    if kind == "email":
        return F.length(m).between(6, 80)
    if kind == "ip":
        return ~m.rlike(r"(?:^|\.)0[0-9]")
    if kind == "card":
        return _card(m)
    return F.length(_digits(m)).between(9, 15)


def _votes(number: int, kind: str, base: bool):
    """Turns a match of _spans into a candidate with its votes."""
    sign = lambda c: F.when(c, 1).otherwise(-1)

    def vote(x):
        known = _digits(x["m"]) if kind == "card" else x["m"]
        votes = F.array(F.lit(1 if base else -1), sign(known.rlike(GAZETTEER[kind])), F.when(x["before"].rlike(CONTEXT[kind]), 1).otherwise(0), sign(_shape(kind, x["m"])))
        joined = F.right(x["before"], F.lit(1)).rlike(r"[A-Za-z0-9]").cast("int") + F.lit(2) * x["after"].rlike(r"[A-Za-z0-9]").cast("int")
        return F.struct(x["start"].alias("start"), (x["start"] + F.length(x["m"])).alias("stop"), F.lit(number).alias("kind"), F.lit(base).alias("base"), votes.alias("v"), F.coalesce(joined, F.lit(0)).alias("f"))

    return vote


def _of(kind: str):
    return lambda x: _holds(kind, x["m"])


def candidates(text: Column) -> Column:
    """All candidate spans of a text with their votes: start, stop, kind (number), base, v (votes), f (surroundings)."""
    parts = []
    for number, kind in enumerate(KINDS):
        strict = _spans(text, BASE[kind], NEEDS[kind][0](text))
        parts.append(F.transform(F.filter(strict, _of(kind)), _votes(number, kind, True)))
        parts.append(F.transform(_spans(text, LOOSE[kind], NEEDS[kind][1](text)), _votes(number, kind, False)))

    def apart(all_):
        """Base spans, and others that overlap none: of the base spans that start before the other stops, none stops after it starts."""
        # One sorted sweep: a base span comes in at its start, another one asks at its stop, before what starts there.
        events = F.array_sort(F.transform(all_, lambda c: F.struct(F.when(c["base"], c["start"]).otherwise(c["stop"]).alias("at"), c["base"].alias("base"), c.alias("c"))))
        reach = lambda es: running(F.transform(es, lambda e: F.when(e["base"], e["c"]["stop"]).otherwise(F.lit(0).cast("long"))), F.greatest)
        kept = _let(events, lambda es: _let(reach(es), lambda r: F.filter(es, lambda e, i: e["base"] | (r[i] <= e["c"]["start"]))))
        return F.transform(kept, lambda e: e["c"])

    every = _let(F.concat(*parts), lambda all_: F.when(F.exists(all_, lambda c: ~c["base"]), apart(all_)).otherwise(all_))
    return F.array_sort(every)


def found_in(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: str = "personal") -> DataFrame:
    """A table of doc_id and candidate spans; texts are read here only."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return shared.stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("dm_text")).select("doc_id", candidates(F.col("dm_text")).alias("spans")), scope)


def learn(spans: DataFrame, turns: int = 25) -> dict[tuple, bool]:
    """Which (kind, votes, surroundings) the trained classifier accepts.

    At most 4 kinds x 3^4 votes x 4 surroundings are counted and come to the driver.
    """
    rows = spans.select(F.explode("spans").alias("s")).groupBy(F.col("s.kind").alias("kind"), F.col("s.v").alias("v"), F.col("s.f").alias("f")).count().collect()
    accepted: dict[tuple, bool] = {}
    for kind in range(len(KINDS)):
        own = sorted((tuple(r["v"]), r["f"], r["count"]) for r in rows if r["kind"] == kind)
        if not own:
            continue
        # EM: the reliability of each labeler's votes under either truth, from the majority vote on.
        total = sum(n for *_, n in own)
        belief = [0.9 if sum(v) > 0 else 0.1 for v, _, _ in own]
        for _ in range(turns):
            prior = (1 + sum(p * n for p, (*_, n) in zip(belief, own, strict=True))) / (2 + total)
            seen = {}
            for p, (v, _, n) in zip(belief, own, strict=True):
                for j, x in enumerate(v):
                    for truth, q in ((1, p), (0, 1 - p)):
                        seen[truth, j, x] = seen.get((truth, j, x), 0.0) + q * n
            mass = (total * (1 - prior), total * prior)
            # Smoothing leans on a labeler being right more often than not.
            lean = lambda truth, x: 2.0 if x and (x > 0) == bool(truth) else 1.0
            rate = lambda truth, j, x: (seen.get((truth, j, x), 0.0) + lean(truth, x)) / (mass[truth] + 4.0)  # noqa: E731, B023
            belief = []
            for v, _, _ in own:
                odds = math.log(prior / (1 - prior)) + sum(math.log(rate(1, j, x) / rate(0, j, x)) for j, x in enumerate(v))
                belief.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        # The span classifier: logistic on votes and surroundings, with the posteriors as soft labels.
        row = lambda v, f: [1.0, *[float(x) for x in v], float(f & 1), float(f >> 1)]
        xs = [row(v, f) for v, f, _ in own]
        w = [0.0] * len(xs[0])
        for _ in range(400):
            g = [1e-3 * x for x in w]
            for x, p, (*_, n) in zip(xs, belief, own, strict=True):
                z = sum(a * b for a, b in zip(w, x, strict=True))
                d = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p) * n / total
                g = [a + d * b for a, b in zip(g, x, strict=True)]
            w = [a - 1.0 * b for a, b in zip(w, g, strict=True)]
        for x, (v, f, _) in zip(xs, own, strict=True):
            accepted[kind, v, f] = sum(a * b for a, b in zip(w, x, strict=True)) >= 0
    return accepted


def final_spans(column: Column, accepted: dict[tuple, bool]) -> Column:
    """Base spans and accepted candidates, by start and then kind: start, stop, kind (name)."""
    keys = [f"{k}:{','.join(map(str, v))}:{f}" for (k, v, f), yes in accepted.items() if yes]
    known = F.array(*[F.lit(k) for k in keys]).cast("array<string>")
    key = lambda s: F.concat_ws(":", s["kind"].cast("string"), F.array_join(F.transform(s["v"], lambda x: x.cast("string")), ","), s["f"].cast("string"))
    kept = F.filter(column, lambda s: s["base"] | F.array_contains(known, key(s)))
    ordered = F.array_sort(F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), s["base"].alias("base"))))
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), name[s["kind"]].alias("kind"), s["base"].alias("base")))


def joined(spans: Column) -> Column:
    """kind:start:stop of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: str = "personal") -> DataFrame:
    """Per document: doc_id, spans (start, stop, kind, base)."""
    found = found_in(docs, id_col, text_col, scope)
    return found.select("doc_id", final_spans(F.col("spans"), learn(found)).alias("spans"))


def redacted(text: Column, spans: Column, wide: int = 4096) -> Column:
    """The text with each stretch of spans (by start) replaced by the first one's kind in angle brackets.

    The text is cut into chunks once, as a place in a long string is found by walking to it.
    """
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{wide}}}"), F.lit(0))

    def piece(c, a, b):
        """The characters from a to b."""
        i, j = F.floor(a / wide).cast("int"), F.floor(b / wide).cast("int")
        offset = lambda x: (x % wide).cast("int")
        within = F.substring(F.get(c, i), offset(a) + 1, (b - a).cast("int"))
        across = F.concat(F.substring(F.get(c, i), offset(a) + 1, F.lit(wide)), F.array_join(F.slice(c, i + 2, j - i - 1), ""), F.coalesce(F.left(F.get(c, j), offset(b)), F.lit("")))
        return F.when(b <= a, "").when(i == j, within).otherwise(across)

    def pieces(z):
        # Where the spans before one end at most; it begins a stretch where that is not beyond its start.
        before = lambda i: F.when(i > 0, z["ends"][i - 1]).otherwise(F.lit(0).cast("long"))
        marks = F.filter(F.transform(z["spans"], lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), before(i).alias("from"))), lambda m: m["start"] >= m["from"])
        said = F.transform(marks, lambda m: F.concat(piece(z["chunks"], m["from"], m["start"]), F.lit("<"), F.upper(m["kind"]), F.lit(">")))
        return F.concat(F.array_join(said, ""), piece(z["chunks"], F.element_at(z["ends"], F.lit(-1)), F.length(text).cast("long")))

    parts = F.struct(spans.alias("spans"), running(F.transform(spans, lambda s: s["stop"]), F.greatest).alias("ends"), chunks.alias("chunks"))
    return F.when(F.size(spans) > 0, _let(parts, pieces)).otherwise(text)
