"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic model of each document's words, word beginnings and surface counts, fitted on a bounded
sample of labelled documents, gives its evidence of being bad (low quality or toxic). Grouped sums
of that evidence over hosts and over paths of a host are shrunk, host towards the whole corpus and
path towards its host, with prior strengths estimated from the spread between groups, so that sparse
sites lean on the global prior. The posterior of a document adds its evidence and its path's.

Null and empty texts have the evidence of no words; null hosts and paths are groups of their own;
repeated rows count each; an empty table gives no rows; without labels of both kinds a model
abstains (0). Of several labels of a document the worst counts. Texts of any length are read whole.
Of the input the id, text, host and path columns are read; ``scored`` keeps all others as they are
and adds dm_quality and dm_toxic, which the input must not have itself. Ties between features go to
the smaller number.
"""

from __future__ import annotations

import zlib
from operator import eq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

SPACE = 1 << 21
#: A document stays while its log odds of being bad are below this: a bad one that stays costs some seven times as much as a good one that goes.
KEEP_BELOW = -2.0
#: Deleting these bytes and comparing lengths counts them.
_UPPER, _MARKS, _DIGITS = bytes(range(65, 91)), b"*#$%&|!<>{}[]=_~^\\", b"0123456789"


def features_of(word: str) -> list[int]:
    """Hashed features of a lower-cased word: itself and its beginnings of 4, 5 and 6 letters."""
    word = word.strip(".,;:!?\"'()[]*#$%&|")
    own = [f"w{word}", *(f"b{word[:k]}" for k in (4, 5, 6) if len(word) >= k)]
    return [zlib.crc32(x.encode()) % SPACE for x in own] if word else []


def surface_of(text: str, words: list[str], distinct: int) -> list[float]:
    """Surface counts of a whole text, as rates."""
    import math

    raw = text.encode()
    n, k = max(1, len(raw)), max(1, len(words))
    less = lambda chars: len(raw) - len(raw.translate(None, chars))
    lines = [x for x in text.split("\n") if x]
    same = sum(map(eq, words, words[1:]))
    return [less(_UPPER) / n, less(_MARKS) / n, less(_DIGITS) / n, distinct / k, math.log1p(k), distinct / k * math.log1p(k), same / k, len(set(lines)) / max(1, len(lines)), len(text) / k / 10, less(b"!") / k, less(b"|") / k]


def logistic(block, y, width: int, penalty: float = 2e-6, steps: int = 25, rows: int = 500):
    """Weights (bias last) of a logistic regression by damped Newton steps; zeros if y has one class.

    ``block(a, b)`` gives rows a to b of the design, bias included; only ``rows`` of them are held
    at once. Both classes weigh the same, so that the odds are evidence, apart from how rare a class is.
    """
    import numpy as np

    w = np.zeros(width)
    if len(y) == 0 or y.min() == y.max():
        return w
    even = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    ridge = np.full(width, penalty)
    ridge[-1] = 1e-9
    cuts = [(a, min(len(y), a + rows)) for a in range(0, len(y), rows)]

    def loss(v):
        z = np.concatenate([block(a, b) @ v for a, b in cuts])
        return float(np.mean(even * (np.logaddexp(0, z) - y * z)) + 0.5 * (ridge * v * v).sum()), z

    now, z = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        slope, bend = even * (p - y), even * p * (1 - p)
        grad, curve = np.zeros(width), np.zeros((width, width))
        for a, b in cuts:
            x = block(a, b)
            grad += x.T @ slope[a:b]
            curve += x.T @ (x * bend[a:b, None])
        grad = grad / len(y) + ridge * w
        curve = curve / len(y) + np.diag(ridge + 1e-9)
        step, size = np.linalg.solve(curve, grad), 1.0
        while size > 1e-4:
            new, z_new = loss(w - size * step)
            if new < now:
                break
            size /= 2
        else:
            break
        done = now - new < 1e-9
        w, now, z = w - size * step, new, z_new
        if done:
            break
    return w


def labelled(docs: DataFrame, labels: DataFrame, most: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """dm_id, text, quality, toxic of at most ``most`` labelled documents, the first by a hash of the id.

    Of several labels of an id the worst counts, of several documents of an id the least text.
    """
    worst = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(id_col).cast("long").alias("dm_id")).agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    chosen = worst.orderBy(F.xxhash64("dm_id"), "dm_id").limit(most)
    rows = docs.select(F.col(id_col).cast("long").alias("dm_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "dm_id")
    return rows.groupBy("dm_id", "quality", "toxic").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, most: int = 10_000, kept: int = 512, id_col: str = "doc_id", text_col: str = "text", scope: str = "quality") -> dict:
    """The two models, fitted on at most ``most`` labelled documents.

    Of the hashed features the ``kept`` most telling ones (by likelihood ratio) enter each model.
    Features are made and counted on executors; the driver sees those of the ``kept`` ones that each
    of the ``most`` documents has, and solves two systems of ``kept`` unknowns.
    """
    import numpy as np

    rows = labelled(docs, labels, most, id_col, text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sparse, dense = [], []
            texts = batch.column(3)
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                words = text.split()
                distinct = set(text.lower().split())
                sparse.append(sorted({f for w in distinct for f in features_of(w)}))
                dense.append(surface_of(text, words, len(distinct)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sparse, pa.list_(pa.int32())), pa.array(dense, pa.list_(pa.float64()))], names=["dm_id", "quality", "toxic", "sparse", "dense"])

    found = shared.stored(rows.select("dm_id", "quality", "toxic", "text").mapInArrow(run, "dm_id long, quality int, toxic int, sparse array<int>, dense array<double>"), scope)
    is_bad = {"quality": F.col("quality") < 1, "toxic": F.col("toxic") > 0}
    n, *positive = found.agg(F.count("*"), *[F.sum(c.cast("long")) for c in is_bad.values()]).first()
    if not n:
        nothing = {"words": {}, "dense": [], "bias": 0.0}
        return {"mean": [], "spread": [], "quality": nothing, "toxic": nothing}
    counts = found.select(F.explode("sparse").alias("f"), *[c.cast("long").alias(k) for k, c in is_bad.items()]).groupBy("f").agg(F.count("*").alias("n"), *[F.sum(k).alias(k) for k in is_bad]).where("n >= 3")

    def gain(bad, pos):
        """Log likelihood ratio of a feature, from its count, that in bad documents and the number of those."""
        seen, good, pos, neg = F.col("n"), F.col("n") - F.col(bad), max(1.0, float(pos)), max(1.0, float(n - pos))
        rate = seen / n
        cell = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
        return cell(F.col(bad), pos * rate) + cell(good, neg * rate) + cell(pos - F.col(bad), pos * (1 - rate)) + cell(neg - good, neg * (1 - rate))

    gains = shared.stored(counts.select("f", *[gain(k, p).alias(k) for k, p in zip(is_bad, positive, strict=True)]), scope)
    # Chance alone would hardly lift one of all features over 20.
    chosen = {k: [r["f"] for r in gains.where(F.col(k) > 20).orderBy(F.desc(k), "f").limit(kept).collect()] for k in is_bad}
    own = F.array(*[F.lit(f) for f in sorted({f for c in chosen.values() for f in c})]).cast("array<int>")
    seen = sorted(found.select("dm_id", "quality", "toxic", F.array_intersect("sparse", own).alias("sparse"), "dense").toLocalIterator())
    dense = np.array([r["dense"] for r in seen])
    mean, spread = dense.mean(0), dense.std(0) + 1e-6
    dense = np.hstack([(dense - mean) / spread, np.ones((n, 1))])
    out = {"mean": mean.tolist(), "spread": spread.tolist()}
    for name, top in chosen.items():
        y = np.array([r["quality"] < 1 if name == "quality" else r["toxic"] > 0 for r in seen], "f8")
        at = {f: i for i, f in enumerate(top)}
        has = [np.array([at[f] for f in r["sparse"] if f in at], "i4") for r in seen]

        def block(a, b, has=has, top=top):
            x = np.zeros((b - a, len(top) + dense.shape[1]))
            for i in range(a, b):
                x[i - a, has[i]] = 1
            x[:, len(top) :] = dense[a:b]
            return x

        w = logistic(block, y, len(top) + dense.shape[1])
        out[name] = {"words": dict(zip(top, w[: len(top)].tolist(), strict=True)), "dense": w[len(top) : -1].tolist(), "bias": float(w[-1])}
    return out


class Scorer:
    """Log odds of low quality and of toxicity of whole texts."""

    def __init__(self, model: dict, limit: int = 150_000):
        self.model, self.limit, self.memo = model, limit, {}

    def odds(self, text: str | None) -> tuple[float, float]:
        text = text or ""
        words = text.split()
        distinct = set(text.lower().split())
        memo, found = self.memo, set()
        q, t = self.model["quality"], self.model["toxic"]
        if len(memo) > self.limit:
            memo.clear()
        for w in distinct:
            own = memo.get(w)
            if own is None:
                own = memo[w] = tuple(f for f in features_of(w) if f in q["words"] or f in t["words"])
            if own:
                found.update(own)
        z = [(v - m) / s for v, m, s in zip(surface_of(text, words, len(distinct)), self.model["mean"], self.model["spread"], strict=True)] if self.model["mean"] else []
        return tuple(h["bias"] + sum(a * b for a, b in zip(h["dense"], z, strict=True)) + sum(h["words"].get(f, 0.0) for f in sorted(found)) for h in (q, t))


def scored(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs with dm_quality and dm_toxic, the log odds of low quality and of toxicity."""
    from pyspark.sql import types as T

    shipped = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 x kept weights
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(shipped.value)
        for batch in batches:
            both = [scorer.odds(batch.column(at)[i].as_py()) for i in range(batch.num_rows)]
            arrays = [*batch.columns, pa.array([b[0] for b in both], pa.float64()), pa.array([b[1] for b in both], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "dm_quality", "dm_toxic"])

    schema = T.StructType([*docs.schema.fields, T.StructField("dm_quality", T.DoubleType()), T.StructField("dm_toxic", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def site_of(url) -> tuple:
    """(host, path) columns of a url column: lower-cased host without port, first directory of the path. Null: neither."""
    rest = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*(/[^/?#]*/)", 1)
    return F.lower(rest), F.when(path == "", F.lit("/")).otherwise(path)


def _bad(q: str, t: str):
    """Probability that at least one of the two holds."""
    p = lambda c: 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col(c)))))
    return 1 - (1 - p(q)) * (1 - p(t))


def _logit(p):
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, n: str, s: str, centre) -> float:
    """Prior strength by moments: how much less the rates of groups spread than their sizes allow."""
    row = groups.agg(F.count("*").alias("g"), F.sum(n).alias("n"), F.sum(F.col(n) * F.pow(F.col(s) / F.col(n) - centre, 2)).alias("between"), F.sum(F.col(n) * centre * (1 - centre)).alias("within")).first()
    if not row["g"] or not row["within"]:
        return 1.0
    var = row["within"] / row["n"]
    tau = max((row["between"] - row["g"] * var) / row["n"], var / 1e4)
    return max(1.0, var / tau - 1)


def posteriors(scores: DataFrame, host: str, path: str, scope: str = "quality") -> DataFrame:
    """Per (host, path): dm_host, dm_path, dm_shift, the log odds that its posterior adds to a document's own."""
    paths = shared.stored(scores.groupBy(F.col(host).alias("dm_host"), F.col(path).alias("dm_path")).agg(F.count("*").cast("double").alias("n"), F.sum(_bad("dm_quality", "dm_toxic")).alias("s")), scope)
    hosts = paths.groupBy("dm_host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
    centre = (total["s"] + 1) / (total["n"] + 2) if total["n"] else 0.5
    a = _strength(hosts, "hn", "hs", F.lit(centre))
    means = hosts.withColumn("hm", (F.lit(a * centre) + F.col("hs")) / (a + F.col("hn")))
    both = paths.join(means.withColumnRenamed("dm_host", "dm_of"), F.col("dm_host").eqNullSafe(F.col("dm_of")))
    b = _strength(both, "n", "s", F.col("hm"))
    mean = (F.lit(b) * F.col("hm") + F.col("s")) / (b + F.col("n"))
    return both.select("dm_host", "dm_path", (_logit(mean) - _logit(F.lit(centre))).alias("dm_shift"))


def judged(scores: DataFrame, shifts: DataFrame, host: str, path: str, most: int = 100_000) -> DataFrame:
    """scores with dm_bad, the posterior log odds of being bad. Up to ``most`` groups are broadcast, more are joined by shuffle."""
    if shifts.limit(most + 1).count() <= most:
        shifts = F.broadcast(shifts)
    met = scores.join(shifts, F.col(host).eqNullSafe(F.col("dm_host")) & F.col(path).eqNullSafe(F.col("dm_path")), "left")
    return met.withColumn("dm_bad", _logit(_bad("dm_quality", "dm_toxic")) + F.coalesce("dm_shift", F.lit(0.0))).drop("dm_host", "dm_path", "dm_shift")
