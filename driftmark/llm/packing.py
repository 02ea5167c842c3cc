"""Best-fit packing by a grouping genetic algorithm on islands.

Only the number of documents of each length matters for how many sequences are needed, and there
are at most ``capacity`` lengths. So the genetic algorithm works on bins as counted patterns
(length x count, ...) of that bounded histogram, whatever the number of documents; each island is
one Spark task. The documents then take the places of the best plan by their rank among those of
their length, in parallel, without a shuffle of texts.

Nulls and empty texts are documents of one token (the end id); repeated rows are documents of their
own; an empty table gives no rows; ties are settled by partition and order of rows. Columns beside
the id and the text are not read.
"""

from __future__ import annotations

import bisect
import random
import zlib
from collections import Counter

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import shared, tokens

Pattern = tuple[tuple[int, int], ...]
Plan = dict[Pattern, int]


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32, and (dm_part, dm_rank), the rank among the partition's pieces of that length.

    Only documents of more than ``capacity`` tokens are cut; the first piece takes what is left over.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        encoder, part, seen = tokens.byte_encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, "i8")
        end = np.array([end_id], "<u4")
        for batch in batches:
            rows: list[tuple] = []
            texts = batch.column(1)
            for at, doc in enumerate(batch.column(0).to_pylist()):
                ids = np.concatenate([encoder.ids(texts[at].as_py()), end])
                n = len(ids)
                start, stop = 0, n % capacity or capacity
                for piece in range(-(-n // capacity)):
                    size = stop - start
                    rows.append((doc, piece, start, size, zlib.crc32(ids[start:stop].tobytes()), part, int(seen[size])))
                    seen[size] += 1
                    start, stop = stop, stop + capacity
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "dm_part", "dm_rank"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, dm_part int, dm_rank long"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


# --- the genetic algorithm, on counted patterns ---------------------------------------------


def fill(pattern: Pattern) -> int:
    return sum(n * k for n, k in pattern)


def _put(pattern: Pattern, length: int, k: int) -> Pattern:
    own = Counter(dict(pattern))
    own[length] += k
    return tuple(sorted(own.items(), reverse=True))


def best_fit(plan: Plan, demand: list[tuple[int, int]], capacity: int) -> Plan:
    """Place (length, count) in the given order, each document into the fullest bin that has room for it.

    Bins of one pattern are handled together, so the work depends on the number of lengths and
    patterns, not on the number of documents.
    """
    rooms: dict[int, Plan] = {}
    for p, m in plan.items():
        rooms.setdefault(capacity - fill(p), {})[p] = m
    order = sorted(r for r in rooms if r > 0)

    def add(p: Pattern, m: int) -> None:
        room = capacity - fill(p)
        if room not in rooms:
            rooms[room] = {}
            if room > 0:
                bisect.insort(order, room)
        rooms[room][p] = rooms[room].get(p, 0) + m

    for length, count in demand:
        while count > 0:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                each = capacity // length
                whole, rest = divmod(count, each)
                if whole:
                    add(((length, each),), whole)
                if rest:
                    add(((length, rest),), 1)
                break
            room = order[at]
            here = rooms[room]
            p, m = here.popitem()
            each = room // length
            whole = min(m, count // each)
            if whole:
                add(_put(p, length, each), whole)
                count -= whole * each
                m -= whole
            if m and 0 < count < each:
                add(_put(p, length, count), 1)
                count, m = 0, m - 1
            if m:
                here[p] = here.get(p, 0) + m
            if not here:
                del rooms[room]
                order.pop(bisect.bisect_left(order, room))
    out: Plan = {}
    for here in rooms.values():
        for p, m in here.items():
            out[p] = out.get(p, 0) + m
    return out


def cost(plan: Plan, capacity: int) -> tuple[int, float]:
    """Number of bins, then less the more of them are well filled."""
    return sum(plan.values()), -sum(m * (fill(p) / capacity) ** 2 for p, m in plan.items())


def crossover(a: Plan, b: Plan, sizes: dict[int, int], capacity: int, rng: random.Random) -> Plan:
    """Inject whole well-filled bins of b, drop the bins of a that hold duplicates, best-fit what they displace."""
    left, child = dict(sizes), {}

    def take(p: Pattern, m: int) -> None:
        m = min([m, *(left[n] // k for n, k in p)])
        if m > 0:
            child[p] = child.get(p, 0) + m
            for n, k in p:
                left[n] -= m * k

    for p, m in b.items():
        if fill(p) >= 0.995 * capacity and rng.random() < 0.5:
            take(p, m)
    for p, m in sorted(a.items(), key=lambda x: (-fill(x[0]), x[0])):
        take(p, m)
    return best_fit(child, sorted(((n, k) for n, k in left.items() if k), reverse=True), capacity)


def mutate(a: Plan, capacity: int, rng: random.Random) -> Plan:
    """Empty the worst bins and a few others, and best-fit their documents again."""
    order = sorted(a, key=lambda p: (fill(p), p))
    out = set(order[: max(1, len(order) // 10)]) | {p for p in order if rng.random() < 0.05}
    demand: Counter = Counter()
    for p in out:
        for n, k in p:
            demand[n] += k * a[p]
    return best_fit({p: m for p, m in a.items() if p not in out}, sorted(demand.items(), reverse=True), capacity)


def evolve(sizes: dict[int, int], capacity: int, seed: int, guests: list[Plan], population: int = 4, turns: int = 6) -> Plan:
    """One island for one epoch: the best of its own population and the guests."""
    rng = random.Random(seed)
    least = -(-sum(n * k for n, k in sizes.items()) // capacity)
    home = list(guests)
    while len(home) < population:
        jitter = 0 if not home else rng.choice((8, 64, 256))
        order = sorted(sizes.items(), key=lambda x: (-(x[0] + rng.random() * jitter), x[0]))
        home.append(best_fit({}, order, capacity))
    home.sort(key=lambda p: cost(p, capacity))
    for _ in range(turns):
        if sum(home[0].values()) == least:
            break
        a, b = home[0], home[1 + rng.randrange(len(home) - 1)] if len(home) > 1 else home[0]
        if rng.random() < 0.5:
            a, b = b, a
        home.append(mutate(crossover(a, b, sizes, capacity, rng), capacity, rng))
        home = sorted(home, key=lambda p: cost(p, capacity))[:population]
    return home[0]


def plan_islands(spark, sizes: dict[int, int], capacity: int, islands: int = 4, epochs: int = 3) -> Plan:
    """Islands evolve as Spark tasks; after each epoch every elite also goes to the next island."""
    import json

    if not sizes:
        return {}
    least = -(-sum(n * k for n, k in sizes.items()) // capacity)
    elites: list[Plan] = []
    dump = lambda p: json.dumps([[list(map(list, k)), m] for k, m in p.items()])
    load = lambda s: {tuple(map(tuple, k)): m for k, m in json.loads(s)}
    for epoch in range(epochs):
        sent = [[dump(elites[i]), dump(elites[i - 1])] if elites else [] for i in range(islands)]

        def run(batches, sent=sent, epoch=epoch):
            import pyarrow as pa

            for batch in batches:
                for i in batch.column(0).to_pylist():
                    best = evolve(sizes, capacity, 1000 * epoch + i, [load(s) for s in dict.fromkeys(sent[i])])
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([dump(best)])], names=["island", "plan"])

        rows = spark.range(0, islands, 1, islands).mapInArrow(run, "island long, plan string").collect()
        elites = [load(r["plan"]) for r in sorted(rows, key=lambda r: r["island"])]
        if min(sum(p.values()) for p in elites) == least:
            break
    return min(elites, key=lambda p: cost(p, capacity))


def places(plan: Plan):
    """Arrays that map (length, rank) to places: keys (length << 40 | first rank), count in the bin, first sequence, first offset."""
    import numpy as np

    rows, used, base = [], Counter(), 0
    for p, m in sorted(plan.items(), key=lambda x: (-fill(x[0]), x[0])):
        offset = 0
        for n, k in p:
            rows.append(((n << 40) | used[n], k, base, offset))
            used[n] += m * k
            offset += n * k
        base += m
    rows.sort()
    return tuple(np.array(c, "i8") for c in zip(*rows, strict=True)) if rows else (np.zeros(0, "i8"),) * 4


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", islands: int = 4, epochs: int = 3, scope: str = "packing") -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` tokens as the search finds.

    Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    spark = docs.sparkSession
    pieces = shared.stored(token_pieces(docs, path, capacity, end_id, id_col, text_col), scope)
    by_part = pieces.groupBy("length", "dm_part").agg(F.count("*").alias("n"))
    rows = by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``capacity`` rows
    sizes = {r["length"]: r["n"] for r in rows}
    full = sizes.pop(capacity, 0)
    plan = plan_islands(spark, sizes, capacity, islands, epochs)
    if full:
        plan[((capacity, 1),)] = full
    shipped = spark.sparkContext.broadcast(places(plan))  # a few rows for each length
    before = F.sum("n").over(W.partitionBy("length").orderBy("dm_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = by_part.select("length", "dm_part", F.coalesce(before, F.lit(0)).alias("dm_before"))
    ranked = pieces.join(offsets, ["length", "dm_part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("dm_before") + F.col("dm_rank")).alias("rank"))

    def place(batches):
        import numpy as np
        import pyarrow as pa

        keys, counts, bases, offs = shipped.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted(keys, (length << 40) | rank, "right") - 1
            slot = rank - (keys[at] & ((1 << 40) - 1))
            bins, inside = np.divmod(slot, counts[at])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bases[at] + bins), pa.array(offs[at] + inside * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
