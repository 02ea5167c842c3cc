"""Masked pseudo-likelihood of documents under a bidirectional window network trained in numpy.

Every word is predicted from the ``SPAN`` words on either side of it; a document's score is the sum
of those conditional log-probabilities. Words are counted over all documents; the most frequent ones
are symbols of their own, at least 768 and more with the square root of the vocabulary, the others
share hashed buckets, in which a word has its share of the bucket's count: of up to 2^17 frequent
words every task knows the count, those of all others are looked up by a join. The network
(embeddings, one tanh layer, a softmax over classes and one within the class) is trained by every
partition on its own masked positions, in each round another share of all words, over all rounds
every word of all documents once, and averaged over the partitions by their number of positions. So
the weights, and in small measure the scores, depend on how Spark splits the table into partitions
(files, cores and split sizes): the same splits of the same files give the same weights.

Texts are read twice, to count words and to turn them into symbols, which are stored; training and
scoring read those.

Null texts and texts without words have no words and score 0; repeated rows score alike; rows
without id keep a null id; texts of any length are scored whole, some 2^16 positions at a time; an
empty table gives no rows. Places beyond a document's ends are one padding symbol. Columns beside
the id and the text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .decontaminate import words_of

CLASSES, WIDTH = 32, 32  # symbols = CLASSES x WIDTH, at least; larger vocabularies widen both
SYMBOLS, BUCKETS, SPAN, DIM, HIDDEN = CLASSES * WIDTH, 256, 2, 16, 32
FINE = 1 << 30  # log counts are summed as whole parts of this size
PLACES = [p for p in range(-SPAN, SPAN + 1) if p]


def word_counts(docs: DataFrame, text_col: str, most: int = 200_000) -> DataFrame:
    """(word, n) over all documents. Each task sums before it sends, with at most ``most`` words held."""

    def run(batches):
        import pyarrow as pa

        def send(c):
            return pa.RecordBatch.from_arrays([pa.array(list(c.keys()), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])

        held: Counter = Counter()
        for batch in batches:
            for i in range(batch.num_rows):
                held.update(words_of(batch.column(0)[i].as_py()))
                if len(held) > most:
                    yield send(held)
                    held.clear()
        if held:
            yield send(held)

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def width_of(distinct: int) -> int:
    """Classes, and symbols in each, for so many distinct words: room for 2 sqrt(distinct) words of their own."""
    return max(WIDTH, math.isqrt(2 * math.isqrt(distinct) + BUCKETS - 1) + 1)


def vocabulary(counts: DataFrame, known: int = 1 << 17) -> dict:
    """The most frequent words, the first ones (``own``) with symbols of their own, log counts of up to ``known`` further ones and, for each bucket, the count of its words."""
    spread = counts.groupBy(F.pmod(F.crc32("word"), F.lit(BUCKETS)).alias("b")).agg(F.count("*").alias("d"), F.sum("n").alias("n")).collect()
    width = width_of(sum(r["d"] for r in spread))
    top = width * width - BUCKETS
    # Counts in bounded bins (each number up to 4096, then 64 a doubling): the words above a bin's edge come to the driver.
    level = F.when(F.col("n") < 4096, F.col("n")).otherwise(4096 + F.floor((F.log2("n") - 12) * 64)).cast("long")
    least, held = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        held += r["count"]
        if held > top + known:
            break
        least = r["level"]
    frequent = counts.where(level >= least).collect() if least is not None else []
    ranked = sorted(((bytes(r["word"]), r["n"]) for r in frequent), key=lambda r: (-r[1], r[0]))
    inside: Counter = Counter()
    for w, n in ranked[:top]:
        inside[top + zlib.crc32(w) % BUCKETS] += n
    return {"words": [w for w, _ in ranked], "own": min(top, len(ranked)), "logs": [round(math.log(n) * FINE) for _, n in ranked[top:]], "width": width, "total": {top + r["b"]: max(1, r["n"] - inside[top + r["b"]]) for r in spread}}


class Symbols:
    """Symbols of texts. Frequent words have numbers, from which arrays give symbols and log counts."""

    def __init__(self, words: dict):
        import numpy as np

        self.top = words.get("width", WIDTH) ** 2 - BUCKETS
        known, own = words["words"], words["own"]
        self.number = {w: i + 1 for i, w in enumerate(known)}
        bucket = [self.top + zlib.crc32(w) % BUCKETS for w in known[own:]]
        self.symbol = np.array([0, *range(own), *bucket], "u4")  # number 0: not known
        self.log = np.array([0] * (own + 1) + words["logs"], "i8")

    def of(self, text: str | None):
        """(symbols, sum of the known log counts of bucketed words in 2^-30ths, counts of the other bucketed words)."""
        import numpy as np

        words = words_of(text)
        get = self.number.get
        numbers = np.fromiter([get(w, 0) for w in words], "i8", len(words))
        ids, rare = self.symbol[numbers], {}
        for i in np.flatnonzero(numbers == 0).tolist():
            w = words[i]
            ids[i] = self.top + zlib.crc32(w) % BUCKETS
            rare[w] = rare.get(w, 0) + 1
        return ids, int(self.log[numbers].sum()), rare


def symbolised(docs: DataFrame, words: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, n_words, ids (symbols, 32-bit little-endian), ln, rare (words whose count has to be looked up); to be stored once."""
    shipped = docs.sparkSession.sparkContext.broadcast(words)  # at most 2 sqrt(vocabulary) + 2^17 words

    def run(batches):
        import pyarrow as pa

        symbols, row = Symbols(shipped.value), TaskContext.get().partitionId() << 40
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.map_(pa.binary(), pa.int64()))
        for batch in batches:
            ids, at = batch.column(0), 0
            while at < batch.num_rows:
                out = []
                for i in range(at, min(at + 1000, batch.num_rows)):
                    own, ln, rare = symbols.of(batch.column(1)[i].as_py())
                    out.append((row, ids[i].as_py(), len(own), own.astype("<u4").tobytes(), ln, list(rare.items())))
                    row += 1
                at += len(out)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["row", "doc_id", "n_words", "ids", "ln", "rare"])

    schema = "row long, doc_id long, n_words long, ids binary, ln long, rare map<binary,bigint>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def windows(raw: list[bytes], pad: int, first=0, every: int = 1, turn: int = 0):
    """(flat, places) of documents' symbols between paddings: the window of place i is flat[i - SPAN : i + SPAN + 1].

    Of the positions of a document, counted from ``first``, those that are ``turn`` modulo ``every``.
    """
    import numpy as np

    gap = np.full(SPAN, pad, "i4")
    sizes = np.array([len(r) // 4 for r in raw])
    parts = [gap]
    for r in raw:
        parts += [np.frombuffer(r, "<u4").astype("i4"), gap]
    flat = np.concatenate(parts)
    own = np.arange(sizes.sum())
    starts = np.cumsum(sizes) - sizes
    inside = own - np.repeat(starts, sizes)
    places = own + SPAN + np.repeat(np.arange(len(sizes)) * SPAN, sizes)
    return flat, places[(inside + first) % every == turn]


def stretches(batches, column: int, most: int = 1 << 16):
    """Lists of (batch, rows) with about ``most`` positions each; a longer document is one of its own."""
    for batch in batches:
        ids, at = batch.column(column), 0
        while at < batch.num_rows:
            first, raw, held = at, [], 0
            while at < batch.num_rows and held < 4 * most:
                raw.append(ids[at].as_py())
                held += len(raw[-1])
                at += 1
            yield batch.slice(first, at - first), raw


def start(seed: int = 5, width: int = WIDTH) -> dict:
    """Initial weights, the same everywhere."""
    import numpy as np

    rng = np.random.default_rng(seed)
    draw = lambda *s: rng.normal(0, 0.1, s).astype("f4")
    return {"e": draw(width * width + 1, DIM), "w": draw(len(PLACES) * DIM, HIDDEN), "b": np.zeros(HIDDEN, "f4"), "c": draw(HIDDEN, width), "cb": np.zeros(width, "f4"), "u": draw(width, HIDDEN, width), "ub": np.zeros((width, width), "f4")}


def _soft(z):
    import numpy as np

    if z.max() > 60 or z.min() < -60:  # rare, as tanh bounds what feeds the logits
        z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z *= (1 / (z @ np.ones(z.shape[1], "f4")))[:, None]
    return z


class Trainer:
    """Adagrad over masked positions, in steps of ``least`` positions that grow to ``batch``; weights and past gradients stay between calls."""

    def __init__(self, model: dict, rate: float = 0.1, least: int = 128, batch: int = 8192):
        import numpy as np

        self.m = {k: v.copy() for k, v in model.items()}
        self.past = {k: np.full_like(v, 1e-3) for k, v in model.items()}
        self.rate, self.least, self.batch, self.width, self.seen = rate, least, batch, len(model["cb"]), 0

    def learn(self, flat, places) -> None:
        a = 0
        while a < len(places):
            own = places[a : a + min(self.batch, max(self.least, self.seen // 16))]
            self._step(flat, own)
            a += len(own)
            self.seen += len(own)

    def _step(self, flat, at) -> None:
        import numpy as np

        m, width, n = self.m, self.width, len(at)
        t = flat[at]
        order = np.argsort((t // width).astype("u2"), kind="stable")
        at, t = at[order], t[order]
        k, r = t // width, t % width
        w = m["w"].reshape(len(PLACES), DIM, HIDDEN)
        ctx = [flat[at + p] for p in PLACES]
        h = np.take(m["e"] @ w[0] + m["b"], ctx[0], axis=0)
        for i in range(1, len(PLACES)):
            h += np.take(m["e"] @ w[i], ctx[i], axis=0)
        np.tanh(h, out=h)
        g = {key: np.zeros_like(v) for key, v in m.items()}
        pc = _soft(h @ m["c"] + m["cb"])
        pc[np.arange(n), k] -= 1
        dh = pc @ m["c"].T
        g["c"], g["cb"] = h.T @ pc, pc.sum(0)
        edges = np.searchsorted(k, np.arange(width + 1)).tolist()
        for c in range(width):
            a, b = edges[c], edges[c + 1]
            if b > a:
                pu = _soft(h[a:b] @ m["u"][c] + m["ub"][c])
                pu[np.arange(b - a), r[a:b]] -= 1
                dh[a:b] += pu @ m["u"][c].T
                g["u"][c] = h[a:b].T @ pu
                g["ub"][c] = pu.sum(0)
        np.multiply(h, h, out=h)
        np.subtract(1, h, out=h)
        dh *= h
        g["b"] = dh.sum(0)
        gw = g["w"].reshape(len(PLACES), DIM, HIDDEN)
        small = "u2" if len(m["e"]) <= 1 << 16 else "u4"
        for i, symbols in enumerate(ctx):
            order = np.argsort(symbols.astype(small), kind="stable")
            own = symbols[order]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            sums, seen = np.add.reduceat(np.take(dh, order, axis=0), first, axis=0), own[first]
            gw[i] = m["e"][seen].T @ sums
            g["e"][seen] += sums @ w[i].T
        for key, v in m.items():
            d = g[key] / n
            self.past[key] += d * d
            v -= self.rate * d / np.sqrt(self.past[key])


class Network:
    """Scores of symbols under trained weights."""

    def __init__(self, model: dict, words: dict):
        import numpy as np

        self.m, self.width, self.words = model, len(model["cb"]), words
        w = model["w"].reshape(len(PLACES), DIM, HIDDEN)
        self.table = [model["e"] @ w[i] for i in range(len(PLACES))]
        self.extra = np.zeros(self.width**2)
        for s, n in words.get("total", {}).items():
            self.extra[s] = np.log(n)

    def log_probs(self, flat, places):
        """Conditional log-probability of each place, short of the log counts of its bucketed words."""
        import numpy as np

        width = self.width
        t = flat[places]
        order = np.argsort(t.astype("u2" if width <= 256 else "u4"), kind="stable")
        at, t = places[order], t[order]
        h = np.take(self.table[0], flat[at + PLACES[0]], axis=0)
        for i in range(1, len(PLACES)):
            h += np.take(self.table[i], flat[at + PLACES[i]], axis=0)
        h += self.m["b"]
        np.tanh(h, out=h)
        n = len(t)
        k, r = t // width, t % width

        ones = np.ones(width, "f4")

        def of(z, right):
            if z.max() > 60:  # rare, as tanh bounds what feeds the logits
                z -= z.max(1, keepdims=True)
            own = z[np.arange(len(z)), right]
            return own - np.log(np.exp(z, out=z) @ ones[: z.shape[1]])

        out = of(h @ self.m["c"] + self.m["cb"], k).astype("f8")
        edges = np.searchsorted(k, np.arange(width + 1))
        for c in range(width):
            a, b = edges[c], edges[c + 1]
            if b > a:
                out[a:b] += of(h[a:b] @ self.m["u"][c] + self.m["ub"][c], r[a:b])
        out -= self.extra[t]
        back = np.empty(n)
        back[order] = out
        return back

    def sums(self, raw: list[bytes], most: int = 1 << 16) -> list[float]:
        """Summed log-probabilities of documents, given as their symbols."""
        import numpy as np

        flat, places = windows(raw, self.width**2)
        if not len(places):
            return [0.0] * len(raw)
        p = np.concatenate([self.log_probs(flat, places[a : a + most]) for a in range(0, len(places), most)])
        ends = np.cumsum([len(r) // 4 for r in raw])
        total = np.concatenate([[0.0], np.add.reduceat(p, np.unique(np.concatenate([[0], ends[ends < len(p)]])))])
        out, at = [], 1
        for r in raw:
            out.append(float(total[at]) if r else 0.0)
            at += bool(r)
        return out

    def scores(self, texts: list[str | None]) -> list[tuple[int, float]]:
        """(words, sum of log-probabilities) of whole texts, with the log counts that are known."""
        own = [Symbols(self.words).of(t) for t in texts]
        return [(len(x), p + ln / FINE) for (x, ln, _), p in zip(own, self.sums([x.astype("<u4").tobytes() for x, *_ in own]), strict=True)]


def pack(model: dict) -> bytes:
    import numpy as np

    return np.concatenate([model[k].reshape(-1) for k in sorted(model)]).astype("<f4").tobytes()


def unpack(flat, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype("f4")
        at += like[k].size
    return out


def fit(texts: DataFrame, words: dict, rounds: int = 2, spread: int = 32) -> dict:
    """The network; texts: the table of ``symbolised``. In round i each partition trains on the positions that are i modulo ``rounds`` in all its documents.

    Weights travel in 16 slices and are summed in two steps, so that no task sees more than a
    ``spread``-th of all partitions' slices; the driver gets one weight vector.
    """
    import numpy as np

    sc = texts.sparkSession.sparkContext
    width = words.get("width", WIDTH)
    model, slices = start(width=width), 16

    for turn in range(rounds):
        sent = sc.broadcast(model)

        def run(batches, sent=sent, turn=turn):
            import pyarrow as pa

            trainer, total = Trainer(sent.value), 0
            for _, raw in stretches(batches, 0):
                sizes = np.array([len(r) // 4 for r in raw])
                flat, places = windows(raw, width * width, np.repeat(sizes, sizes), rounds, turn)
                trainer.learn(flat, places)
                total += len(places)
            if total:
                flat = np.frombuffer(pack(trainer.m), "<f4").astype("f8") * total
                part = TaskContext.get().partitionId()
                cut = np.array_split(flat, slices)
                yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([part] * slices, pa.int32()), pa.array([total] * slices, pa.int64()), pa.array([c.tobytes() for c in cut])], names=["slice", "part", "n", "sum"])

        def add(batches):
            import pyarrow as pa

            held: dict = {}
            for batch in batches:
                for s, part, n, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    key = (s, part % spread)
                    a, b = held.get(key, (0, 0.0))
                    held[key] = (a + n, b + np.frombuffer(raw, "<f8"))
            if held:
                keys = sorted(held)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([held[k][0] for k in keys], pa.int64()), pa.array([held[k][1].tobytes() for k in keys])], names=["slice", "part", "n", "sum"])

        schema = "slice int, part int, n long, sum binary"
        weights = texts.select("ids").mapInArrow(run, schema)
        first = weights.repartition(F.col("slice"), F.pmod("part", F.lit(spread))).sortWithinPartitions("slice", "part").mapInArrow(add, schema)
        rows = first.repartition("slice").sortWithinPartitions("slice", "part").select("slice", F.lit(0).alias("part"), "n", "sum").mapInArrow(add, schema).collect()
        if rows:
            rows = sorted(rows, key=lambda r: r["slice"])
            model = unpack(np.concatenate([np.frombuffer(r["sum"], "<f8") / r["n"] for r in rows]), model)
    return model


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2, known: int = 1 << 17, scope: str = "pseudolm") -> DataFrame:
    """Per document: doc_id, n_words, log_prob (summed), mean_log_prob (null without words)."""
    counts = shared.stored(word_counts(docs, text_col), scope)
    words = vocabulary(counts, known)
    texts = shared.stored(symbolised(docs, words, id_col, text_col), scope)
    small = {"width": words["width"], "total": words["total"]}
    shipped = docs.sparkSession.sparkContext.broadcast((fit(texts, small, rounds), small))

    def run(batches):
        import pyarrow as pa

        net = Network(*shipped.value)
        for batch, raw in stretches(batches, 4):
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(net.sums(raw), pa.float64())], names=["row", "doc_id", "n_words", "ln", "base"])

    scored = texts.select("row", "doc_id", "n_words", "ln", "ids").mapInArrow(run, "row long, doc_id long, n_words long, ln long, base double")
    # Log counts as whole 2^-30ths, so that sums do not depend on their order. A word that occurs once adds none.
    logs = counts.where("n > 1").select("word", F.round(F.log("n") * FINE).cast("long").alias("more"))
    rare = texts.select("row", F.explode("rare").alias("word", "c")).join(logs, "word").groupBy("row").agg(F.sum(F.col("c") * F.col("more")).alias("more"))
    out = scored.join(rare, "row", "left").select("doc_id", "n_words", (F.col("base") + (F.col("ln") + F.coalesce("more", F.lit(0))) / FINE).alias("log_prob"))
    return out.select("doc_id", "n_words", "log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")).alias("mean_log_prob"))
