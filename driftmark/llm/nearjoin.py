"""Jaccard join of documents on word n-grams by chosen paths.

Sets of ``width``-word shingles are embedded by min-hashing, so that a token is a pair (coordinate,
min-hash). A run splits all sets by their tokens at ``branch`` coordinates; a bucket of more than
``limit`` sets is split again at coordinates that its own path chooses, smaller ones are compared by
brute force. Runs repeat until the chance that a pair at the threshold never met is below
1 - ``recall``. Buckets that depth does not split hold alike sets and are compared block by block.

What meets by sketch (with a margin of 4.5 standard deviations) forms loose classes; inside each,
all pairs are compared exactly on their shingles, in blocks. So a document's number of links and
the final classes rest on exact Jaccard values, and no list of pairs is ever made: a block gives a
row for each of its documents.

Equal shingle sets are one node with a count. Texts of fewer than ``width`` words are one shingle;
null texts and texts without words link to nothing and are classes of their own; repeated rows are
copies; rows without id take part, keep a null id and come last in their class (which has a null id
if all its rows have); texts of any length are compared whole; an empty table gives no rows. Columns
beside the id and the text are not read, and ``deduplicated`` keeps them, whatever their names.

A class of n different sets costs n^2 / 2 exact comparisons, as bit matrices in blocks, and each of
its texts goes to as many tasks as the class has blocks.
"""

from __future__ import annotations

import functools
import hashlib
import math
from fractions import Fraction

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .components import components
from .decontaminate import words_of
from .tokens import Memo

COORDINATES = 128


def _mixed(x):
    """Scrambled 64-bit values (array)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, width: int, limit: int = 300_000):
        import numpy as np
        import xxhash

        self.width, self.memo = width, Memo(xxhash.xxh64_intdigest, limit)
        self.mult = np.random.default_rng(width).integers(1, 1 << 63, width, dtype="u8") * 2 + 1
        self.edges = np.arange(COORDINATES, dtype="u8") << np.uint64(64 - COORDINATES.bit_length() + 1)
        steps = np.arange(64 * COORDINATES, dtype="u8")
        self.tries = (_mixed(steps) % np.uint64(COORDINATES)).astype("i4").reshape(64, COORDINATES)

    def __call__(self, text: str | None):
        import numpy as np

        words = words_of(text)
        if not words:
            return np.zeros(0, "u8")
        h = np.fromiter(map(self.memo.__getitem__, words), "u8", len(words))
        k = min(self.width, len(h))
        n = len(h) - k + 1
        s = h[:n] * self.mult[0]
        for i in range(1, k):
            s = (s ^ (s >> np.uint64(29))) + h[i : i + n] * self.mult[i]
        s = np.sort(_mixed(s + np.uint64(k)))
        return s[np.concatenate([[True], s[1:] != s[:-1]])] if n > 1 else s

    def sketch(self, s):
        """COORDINATES min-hashes (int32) of a non-empty set, by one permutation.

        Coordinate i is the least hash in the i-th part of the hash range; an empty part takes that
        of the first part with a hash in its own fixed sequence, so that each coordinate still
        agrees with the chance that the Jaccard coefficient gives.
        """
        import numpy as np

        at = np.searchsorted(s, self.edges)
        least = s[np.minimum(at, len(s) - 1)]
        full = np.append(at[1:], len(s)) > at
        if not full.all():
            empty = np.flatnonzero(~full)
            for row in self.tries:
                source = row[empty]
                good = full[source]
                least[empty[good]] = least[source[good]]
                empty = empty[~good]
                if not len(empty):
                    break
            least[empty] = s[0]
        return least.astype("u4").view("i4")


def signature(s) -> tuple[int, int]:
    """128 bits of a set."""
    raw = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def sketched(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """docs with dm_row (a number of its own for each row), node and s2 (the set's signature), n (its size), mh (its min-hashes); null node: no words.

    Row numbers come from the partition and the place in it, so the result has to be stored once.
    """
    from pyspark.sql import types as T

    at_text = docs.columns.index(text_col)
    extra = [("dm_row", T.LongType()), ("node", T.LongType()), ("s2", T.LongType()), ("n", T.IntegerType()), ("mh", T.ArrayType(T.IntegerType()))]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        shingler, row = Shingler(width), TaskContext.get().partitionId() << 40
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                own = batch.slice(at, 500)
                at += own.num_rows
                texts = own.column(at_text)
                sets = [shingler(texts[i].as_py()) for i in range(own.num_rows)]
                full = [s for s in sets if len(s)]
                mh = map(shingler.sketch, full)
                signs = [signature(s) if len(s) else (None, None) for s in sets]
                rows = [next(mh) if len(s) else None for s in sets]
                held = [r for r in rows if r is not None]
                offsets = np.cumsum([0] + [COORDINATES if r is not None else 0 for r in rows])
                flat = np.concatenate(held) if held else np.zeros(0, "i4")
                made = [pa.array(range(row, row + own.num_rows), pa.int64()), pa.array([s[0] for s in signs], pa.int64()), pa.array([s[1] for s in signs], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))]
                row += own.num_rows
                yield pa.RecordBatch.from_arrays([*own.columns, *made], names=[*own.schema.names, *(k for k, _ in extra)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(k, t) for k, t in extra)]))


def runs_needed(threshold: float, recall: float, branch: int = 2) -> int:
    """Runs after which a pair at the threshold has met with chance ``recall``, at any depth.

    A pair that survives a level meets again at one of ``branch`` coordinates; the chance p of never
    being split for good solves p = 1 - (1 - threshold * p) ^ branch.
    """
    p = 1.0
    for _ in range(200):
        p = 1 - (1 - threshold * p) ** branch
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def grouped(rows: DataFrame, keys: list[str], order: list[str], work, schema: str) -> DataFrame:
    """Apply work(list of record batches of one group) to each group; groups are met in sorted partitions, one in memory at a time."""
    sorted_rows = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    wide = len(keys)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(wide)]
            change = np.zeros(batch.num_rows, bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            out = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = tuple(c[a] for c in columns)
                if own != key and held:
                    out += work(held)
                    held = []
                key = own
                held.append(batch.slice(a, b - a))
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
        if held:
            yield from work(held)

    return sorted_rows.mapInArrow(run, schema)


def roots_of(n: int, a, b):
    """Least member of each item's component, from index pairs."""
    import numpy as np

    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    while (root[root] != root).any():
        root = root[root]
    return root


def floors(threshold: float, margin: float = 4.5):
    """Least number of equal coordinates, by the size of the smaller set, that a pair at the threshold has but for ``margin`` deviations.

    A set of n hashes fills about COORDINATES * (1 - exp(-n / COORDINATES)) parts; that many
    coordinates are independent.
    """
    import numpy as np

    n = np.arange(1, 16 * COORDINATES)
    filled = COORDINATES * -np.expm1(-n / COORDINATES)
    out = np.floor(COORDINATES * (threshold - margin * np.sqrt(threshold * (1 - threshold) / filled)))
    return np.concatenate([[1], np.maximum(out, 1)]).astype("i4")


def loose_edges(buckets: DataFrame, threshold: float) -> DataFrame:
    """(u, v) stars of what is alike by sketch within each bucket; buckets: key, part, other, node, n, mh.

    Rows of a bucket with other = 0 are compared with each other, those with other = 1 with those with other = 2.
    """
    low = floors(threshold)

    def work(batches):
        import numpy as np
        import pyarrow as pa

        t = pa.Table.from_batches(batches)
        node, n, side = (t.column(c).to_numpy() for c in ("node", "n", "other"))
        mh = t.column("mh").combine_chunks()
        mh = (mh.chunk(0) if isinstance(mh, pa.ChunkedArray) else mh).flatten().to_numpy().reshape(len(node), -1)
        pairs_a, pairs_b = [], []
        step = max(1, 4_000_000 // (len(node) * mh.shape[1]))
        cross = side.any()
        left = np.flatnonzero(side == 1) if cross else np.arange(len(node))
        for i in range(0, len(left), step):
            rows = left[i : i + step]
            own, other = n[rows][:, None], n[None, :]
            same = (mh[rows][:, None, :] == mh[None, :, :]).sum(2, dtype="i4") >= low[np.minimum(np.minimum(own, other), len(low) - 1)]
            same &= (own >= threshold * other - 1e-9) & (other >= threshold * own - 1e-9)
            a, b = np.nonzero(same)
            a = rows[a]
            keep = (side[b] == 2) if cross else b > a
            pairs_a.append(a[keep])
            pairs_b.append(b[keep])
        root = roots_of(len(node), np.concatenate(pairs_a), np.concatenate(pairs_b))
        moved = np.flatnonzero(root != np.arange(len(node)))
        moved = moved[node[moved] != node[root[moved]]]
        return [pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[root[moved]])], names=["u", "v"])] if len(moved) else []

    return grouped(buckets, ["key", "part"], [], work, "u long, v long")


def blocks_of(rows: DataFrame, blocks) -> DataFrame:
    """Deal groups into ``blocks`` blocks each and pair the blocks: (part, other), each row once for every block beside its own.

    A group of one block is part 0.
    """
    own = F.pmod(F.xxhash64("node"), F.col("dm_blocks"))
    # part a * blocks + b, a <= b: rows of block a have other = 1, those of block b other = 2 (a = b: all 0)
    met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("dm_blocks") - 1), lambda x: F.struct((F.least(x, F.col("dm_own")) * F.col("dm_blocks") + F.greatest(x, F.col("dm_own"))).alias("part"), F.when(F.col("dm_own") == x, 0).when(F.col("dm_own") < x, 1).otherwise(2).alias("other")))
    return rows.withColumn("dm_blocks", blocks).withColumn("dm_own", own).withColumn("dm_met", F.explode(met)).withColumn("part", F.col("dm_met.part")).withColumn("other", F.col("dm_met.other")).drop("dm_blocks", "dm_own", "dm_met")


def chosen_paths(sets: DataFrame, runs: int, branch: int, limit: int, scope: str, depth: int = 40) -> tuple[DataFrame, DataFrame]:
    """Buckets to compare: (key, node) of small ones, and (key, c, node) of large ones of alike sets.

    A large bucket is split once more, unless a half of it would stay together: then its sets are
    alike, splitting does not help, and it is compared block by block as it is. So each level at
    least halves what it goes on with.
    """
    import random

    rng = random.Random(7)
    first = F.array(*[F.xxhash64(F.lit(r * branch + j), F.element_at("mh", i + 1)) for r in range(runs) for j, i in enumerate(rng.sample(range(COORDINATES), branch))])
    rows = sets.select("node", F.explode(first).alias("key"))
    small, alike = [], []
    for _ in range(depth):
        rows = shared.stored(rows, scope)
        # Buckets with the same members, which alike sets form over and over, are kept once.
        counts = rows.groupBy("key").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.hash("node")).alias("y")).where("c > 1")
        once = shared.stored(counts.groupBy("c", "x", "y").agg(F.min("key").alias("key")).select("key", "c"), scope)
        met = shared.stored(rows.join(once.hint("shuffle_hash"), "key"), scope)  # hot buckets are split by AQE
        small.append(met.where(F.col("c") <= limit).select("key", "node"))
        big = met.where(F.col("c") > limit)
        if big.isEmpty():
            break
        at = lambda j: F.element_at("mh", (F.pmod(F.xxhash64("key", F.lit(j)), F.lit(COORDINATES)) + 1).cast("int"))
        again = F.array(*[F.xxhash64("key", F.lit(j), at(j)) for j in range(branch)])
        split = shared.stored(big.join(sets.select("node", "mh"), "node").select("key", "c", "node", F.explode(again).alias("next")), scope)
        kept = shared.stored(split.groupBy("key", "c", "next").count().where(F.col("count") >= F.col("c") / 2).select("key").distinct(), scope)
        alike.append(big.join(kept, "key", "left_semi").select("key", "c", "node"))
        rows = split.join(kept, "key", "left_anti").select("node", F.col("next").alias("key"))
    else:
        alike.append(big.select("key", "c", "node"))
    union = lambda parts: functools.reduce(DataFrame.union, parts)
    none = sets.where("false").select(F.col("node").alias("key"), F.col("c"), "node")
    return union(small), union(alike or [none])


def overlaps(sets: list, most: int = 2_000_000):
    """Matrix of the sizes of all intersections of sorted sets of 64-bit hashes.

    Hashes are taken range by range, about ``most`` of them at a time, and within a range as a 0/1
    matrix of those that two sets share, so that memory does not grow with the length of texts.
    """
    import numpy as np

    n, total = len(sets), sum(map(len, sets))
    both = np.zeros((n, n), "f4")
    if n == 2:
        both[0, 1] = both[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
        return both
    parts = 1 + total // most
    bounds = np.array([k * (1 << 64) // parts for k in range(1, parts)], "u8")
    cuts = [[0, *np.searchsorted(s, bounds).tolist(), len(s)] for s in sets]
    for k in range(parts):
        own = [s[c[k] : c[k + 1]] for s, c in zip(sets, cuts, strict=True)]
        flat, row = np.concatenate(own), np.repeat(np.arange(n), list(map(len, own)))
        _, token, often = np.unique(flat, return_inverse=True, return_counts=True)
        common = often > 1
        number, width = np.cumsum(common) - 1, int(common.sum())
        keep = common[token]
        token, row = number[token[keep]], row[keep]
        order = np.argsort(token, kind="stable")
        token, row = token[order], row[order]
        step = max(64, 8_000_000 // n)
        for a in range(0, width, step):
            lo, hi = np.searchsorted(token, [a, a + step])
            m = np.zeros((n, min(step, width - a)), "f4")
            m[row[lo:hi], token[lo:hi] - a] = 1
            both += m @ m.T
    return both


def exact_links(texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """Per block and node: links to others (with their copies) in it, and the least node that it is connected to there.

    texts: key, part, other, node, s2, c, text.
    """
    share = Fraction(str(threshold))
    made: list[Shingler] = []

    def work(batches):
        import numpy as np
        import pyarrow as pa

        if not made:
            made.append(Shingler(width))
        rows: dict[int, tuple] = {}
        for b in batches:
            for node, s2, c, side, text in zip(*(b.column(b.schema.get_field_index(x)).to_pylist() for x in ("node", "s2", "c", "other", "text")), strict=True):
                if node not in rows:
                    s = made[0](text)
                    if signature(s) == (node, s2):  # of repeated ids the row that was sketched
                        rows[node] = (c, side, s)
        node = np.array(list(rows), "i8")
        n = len(node)
        if n < 2:
            return []
        copies = np.array([r[0] for r in rows.values()], "i8")
        side = np.array([r[1] for r in rows.values()])
        sets = [r[2] for r in rows.values()]
        sizes = np.array(list(map(len, sets)))
        both = overlaps(sets)
        inter = both.astype("i8")
        union = sizes[:, None] + sizes[None, :] - inter
        linked = inter * share.denominator >= union * share.numerator
        np.fill_diagonal(linked, False)
        if side.any():
            linked &= side[:, None] != side[None, :]
        links = linked @ copies
        a, b = np.nonzero(np.triu(linked))
        root = roots_of(n, a, b)
        return [pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(node[root])], names=["node", "links", "root"])]

    return grouped(texts, ["key", "part"], [], work, "node long, links long, root long")


#: Order of the rows of a class: ids first, the least one before the others, then the number of the row.
_FIRST = "struct<none:boolean,id:bigint,row:bigint>"


def classes_of(rows: DataFrame, width: int, threshold: float, recall: float, branch: int, limit: int, block: int, shingles: int, scope: str) -> DataFrame:
    """Per set: node, s2, c (its rows), links (to rows of other sets), first (of its class, as ``_FIRST``).

    rows: dm_id, text and the columns of ``sketched``, stored.
    """
    rank = F.struct(F.col("dm_id").isNull(), "dm_id", "dm_row").cast(_FIRST)
    sets = shared.stored(rows.where("node is not null").groupBy("node", "s2").agg(F.min(rank).alias("rep"), F.count("*").alias("c"), F.first("n").alias("n"), F.first("mh").alias("mh")), scope)
    small, big = chosen_paths(sets, runs_needed(threshold, recall, branch), branch, limit, scope)
    known = sets.select("node", "n", "mh")
    deal = blocks_of(big, F.ceil(F.col("c") / F.lit(block)).cast("long")).select("key", "part", "other", "node").union(small.select("key", F.lit(0).cast("long"), F.lit(0), "node"))
    stars = loose_edges(deal.join(known, "node").select("key", "part", "other", "node", "n", "mh"), threshold)
    loose = components(stars, scope)
    member = loose.select("node", F.col("root").alias("key")).union(loose.select(F.col("root"), "root").distinct())
    placed = shared.stored(member.join(sets.select("node", "s2", "rep", "c", "n"), "node").select("key", "node", "s2", "c", "n", F.col("rep.row").alias("dm_row")), scope)
    # Only classes of more than one block need a look-up of their size; there is one of them for ``block`` sets at most.
    sizes = placed.groupBy("key").agg(F.count("*").alias("k"), F.sum("n").alias("total"))
    parts = F.greatest(F.ceil(F.col("k") / F.lit(block)), F.ceil(F.col("total") / F.lit(shingles))).cast("long")
    large = shared.stored(sizes.select("key", parts.alias("b")).where("b > 1"), scope)
    if large.limit(100_001).count() <= 100_000:
        large = F.broadcast(large)
    texts = rows.select("dm_row", "text").join(placed.hint("shuffle_hash"), "dm_row").join(large, "key", "left")
    met = blocks_of(texts, F.coalesce("b", F.lit(1).cast("long"))).select("key", "part", "other", "node", "s2", "c", "text")
    exact = shared.stored(exact_links(met, width, threshold), scope)
    near = components(exact.select(F.col("node").alias("u"), F.col("root").alias("v")), scope)
    linked = near.union(near.select("root", "root").distinct())
    of = linked.join(sets.select("node", "rep"), "node")
    first = shared.stored(of.groupBy("root").agg(F.min("rep").alias("first")), scope)
    tied = linked.join(first, "root").select("node", "first").join(exact.groupBy("node").agg(F.sum("links").alias("links")), "node")
    out = sets.select("node", "s2", "c", "rep").join(tied, "node", "left")
    return shared.stored(out.select("node", "s2", "c", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("first", "rep").alias("first")), scope)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, recall: float = 0.9999, branch: int = 2, limit: int = 512, block: int = 1024, shingles: int = 1_500_000, scope: str = "nearjoin") -> DataFrame:
    """Per row: doc_id, class_id (the least doc_id of its class), n_links (rows whose set has at least ``threshold``)."""
    source = docs.select(F.col(id_col).cast("long").alias("dm_id"), F.col(text_col).alias("text"))
    rows = shared.stored(sketched(source, "text", width), scope)
    sets = classes_of(rows, width, threshold, recall, branch, limit, block, shingles, scope)
    final = sets.select("node", "s2", F.col("first.id").alias("class_id"), (F.col("links") + F.col("c") - 1).alias("n_links"))
    out = rows.where("node is not null").select(F.col("dm_id").alias("doc_id"), "node", "s2").join(final, ["node", "s2"]).select("doc_id", "class_id", "n_links")
    return out.union(rows.where("node is null").select("dm_id", "dm_id", F.lit(0).cast("long")))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, recall: float = 0.9999, branch: int = 2, limit: int = 512, block: int = 1024, shingles: int = 1_500_000, scope: str = "nearjoin") -> DataFrame:
    """The rows of docs, with all their columns: of each class the one with the least id, and all rows without words."""
    plain, at = shared.numbered(docs)
    source = plain.withColumn("dm_id", F.col(at[id_col]).cast("long"))
    rows = shared.stored(sketched(source, at[text_col], width), scope)
    sets = classes_of(rows.withColumnRenamed(at[text_col], "text"), width, threshold, recall, branch, limit, block, shingles, scope)
    first = sets.select(F.col("first.row").alias("dm_row")).distinct()
    kept = rows.where("node is not null").join(first.hint("shuffle_hash"), "dm_row", "left_semi").select(plain.columns)
    return kept.union(rows.where("node is null").select(plain.columns)).toDF(*docs.columns)
