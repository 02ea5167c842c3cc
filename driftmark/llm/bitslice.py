"""Exact top-k search over a bit-sliced index of quantised vectors.

A component x is the integer floor(scale * x). A block of rows keeps, for each dimension, the
``slice_bits`` most significant bits of its integers as bitmaps over the rows. A query adds the
slices of all dimensions, weighted by its own integers in signed-digit form, with carry-save
additions on bitmaps; the sum's slices are then read from the most significant one downward to find
the k-th row, and every row that the dropped low bits could still lift over it is resolved by its
exact integer inner product.

Vectors that are null or hold a null or non-finite component take no part, nor do rows without id.
Integers of 2^30 or more in magnitude go through the same index as Python integers, in blocks of
their own; a score beyond 64 bits ranks by its exact value and is reported as the nearest 64-bit
number. Shorter vectors count as padded with zeros. Ties go to the smaller id; rows of the query's
own id are left out; repeated rows are candidates of their own; query rows that share an id are one
query, to which a candidate has its best score; fewer than k candidates give fewer rows; an empty
table gives none. Columns beside the id and the vector are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import shared


#: Integers below this are stored as 32-bit ones, rows with larger ones keep their components.
_NARROW = float(1 << 30)


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """vec_id and, of each row that takes part, its integers (v), or its components (x) where some integer is too large for v."""
    x = F.col(vec_col)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    narrow = F.forall(x, lambda c: F.abs(c.cast("double")) < _NARROW / scale)
    whole = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("int"))
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull()).where(fine)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.when(narrow, whole).alias("v"), F.when(~narrow, x.cast("array<double>")).alias("x"))


def matrix(rows: list):
    """A matrix of rows, padded with zeros: of int64, or of Python integers if any row holds such."""
    import numpy as np

    wide = any(isinstance(c, int) for r in rows for c in r[:1])
    out = np.zeros((len(rows), max(map(len, rows), default=0)), object if wide else "i8")
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def vectors_of(v, x, scale: int) -> list:
    """Integers of each row of two Arrow columns: arrays, or lists of Python integers."""
    import math
    from fractions import Fraction

    import numpy as np

    return [np.asarray(a, "i8") if b is None else [math.floor(Fraction(c) * scale) for c in b] for a, b in zip(v.to_pylist(), x.to_pylist(), strict=True)]


def products(v, w):
    """Exact inner products of rows with a query."""
    import numpy as np

    if v.dtype != object and w.dtype != object and int(np.abs(v).max(initial=0)) * sum(map(abs, w.tolist())) < 1 << 63:
        return v @ w
    return v.astype(object) @ w.astype(object)


def best_of(ids, scores, k: int, rows):
    """Places of the k highest scores, best first; ties to the smaller id, then to the smaller row."""
    import numpy as np

    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i], rows[i]))[:k], "i8")
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return some[np.lexsort((rows[some], ids[some], -scores[some]))[:k]]
    return np.lexsort((rows, ids, -scores))[:k]


class Block:
    """The index of one block of rows: the bitmaps of the leading bits, and the integers."""

    def __init__(self, ids, values, slice_bits: int):
        import numpy as np

        order = np.argsort(ids, kind="stable")
        self.ids, self.v = np.asarray(ids)[order], np.asarray(values)[order]
        n, self.dims = self.v.shape
        self.bits = slice_bits
        need = int(np.abs(self.v).max(initial=0)).bit_length() + 1
        self.shift = max(0, need - slice_bits)
        lifted = (self.v >> self.shift).astype("i8") + (1 << (slice_bits - 1))  # unsigned
        words = -(-n // 64)
        self.slices = np.zeros((2, slice_bits, self.dims, words), "u8")  # as they are, and complemented
        for b in range(slice_bits):
            packed = np.zeros((self.dims, words * 8), "u1")
            raw = np.packbits(((lifted >> b) & 1).astype("u1").T, axis=1, bitorder="little")
            packed[:, : raw.shape[1]] = raw
            self.slices[0, b] = packed.view("<u8")
        self.slices[1] = ~self.slices[0]
        valid = np.zeros(words * 8, "u1")
        bits = np.packbits(np.ones(n, "u1"), bitorder="little")
        valid[: len(bits)] = bits
        self.valid = valid.view("<u8")

    def sums(self, w):
        """Slices, least significant first, of a sum that ranks rows as the weighted leading bits do."""
        import numpy as np

        at: dict[int, list] = {}
        left, k = w.copy(), 0
        while left.any():
            odd = (left & 1).astype(bool)
            digit = np.where(odd, 2 - (left & 3), 0)
            for sign, which in ((1, 0), (-1, 1)):
                dims = np.flatnonzero(digit == sign)
                if len(dims):
                    for b in range(self.bits):
                        at.setdefault(k + b, []).append(self.slices[which, b, dims])
            left, k = (left - digit) >> 1, k + 1
        out, pos = [], 0
        none = np.zeros_like(self.valid)
        while at:
            planes = at.pop(pos, None)
            if planes is None:
                out.append(none)
                pos += 1
                continue
            p = np.concatenate(planes)
            up = at.setdefault(pos + 1, [])
            while len(p) >= 3:
                m = len(p) // 3
                a, b, c = p[:m], p[m : 2 * m], p[2 * m : 3 * m]
                x = a ^ b
                up.append((a & b) | (x & c))
                p = np.concatenate([x ^ c, p[3 * m :]])
            if len(p) == 2:
                up.append((p[0] & p[1])[None])
                p = (p[0] ^ p[1])[None]
            if not up:
                del at[pos + 1]
            out.append(p[0])
            pos += 1
        return out

    def top(self, query_id: int, w, k: int):
        """(rows, scores) of the k best rows, best first."""
        import numpy as np

        w = np.concatenate([w, np.zeros(max(0, self.dims - len(w)), w.dtype)])[: self.dims]
        valid = self.valid
        lo, hi = np.searchsorted(self.ids, [query_id, query_id + 1])
        if hi > lo:
            mask = np.unpackbits(valid.view("u1"), bitorder="little")
            mask[lo:hi] = 0
            valid = np.packbits(mask, bitorder="little").view("<u8")
        planes = self.sums(w)
        equal, need, kth = valid, k, 0
        for i in range(len(planes) - 1, -1, -1):  # from the most significant slice downward
            ones = equal & planes[i]
            c = int(np.bitwise_count(ones).sum())
            if c >= need:
                equal, kth = ones, kth | 1 << i
            else:
                need -= c
                equal = equal & ~planes[i]
        slack = ((1 << self.shift) - 1) * sum(map(abs, w.tolist()))
        floor = kth - (slack >> self.shift)
        if floor <= 0 or int(np.bitwise_count(valid).sum()) <= k:
            chosen = valid
        elif floor >> len(planes):
            chosen = np.zeros_like(valid)
        else:
            over, equal = np.zeros_like(valid), valid
            for i in range(len(planes) - 1, -1, -1):
                if floor >> i & 1:
                    equal = equal & planes[i]
                else:
                    over, equal = over | (equal & planes[i]), equal & ~planes[i]
            chosen = over | equal
        rows = np.flatnonzero(np.unpackbits(chosen.view("u1"), bitorder="little"))
        scores = products(self.v[rows], w)
        best = best_of(self.ids[rows], scores, k, rows)
        return rows[best], scores[best]


def reported(score: int) -> tuple[int, bytes | None]:
    """The nearest 64-bit number and, where that is another one, bytes that sort as the scores do."""
    near = max(-(1 << 63), min((1 << 63) - 1, score))
    if near == score:
        return score, None
    size = (score.bit_length() + 7) // 8
    raw = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return near, raw if score > 0 else bytes(255 - b for b in raw)


class Best:
    """The k best candidate rows of one query id, over its query rows and all blocks of a task."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def add(self, block: int, ids, rows, scores) -> None:
        for i, r, s in zip(ids.tolist(), rows.tolist(), scores.tolist(), strict=True):
            self.held[block, r] = max((s, -i), self.held.get((block, r), (s, -i)))
        if len(self.held) > 4 * self.k:
            self.held = dict(self.top())

    def top(self) -> list:
        return sorted(self.held.items(), key=lambda x: (-x[1][0], -x[1][1], x[0]))[: self.k]


def search(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", slice_bits: int = 7, block_rows: int = 16384, task_blocks: int = 8, scope: str = "bitslice") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each id that is divisible by ``every``.

    The queries are a table in the shared folder, sorted by id within each file, which each task
    reads a batch at a time for the ``task_blocks`` blocks that it has indexed; nothing is broadcast
    and no pairs are joined. A task gives at most k rows for each query id, which one window then merges.
    """
    spark = vectors.sparkSession
    rows = shared.stored(quantised(vectors, id_col, vec_col, scale), scope)
    path = shared.scratch(spark, scope)
    n = rows.count()
    blocks = max(1, -(-n // block_rows))
    tasks = max(-(-blocks // task_blocks), min(blocks, spark.sparkContext.defaultParallelism))
    asked = rows.where(F.col("vec_id") % every == 0).distinct()
    asked.repartition(1 + n // (every * 8192), "vec_id").sortWithinPartitions("vec_id").write.parquet(path)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        files, root = shared.files(path)
        parts = sorted(f.path for f in files.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet"))

        def emit(out):
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["query_id", "vec_id", "score", "beyond"])

        def answer(indexed):
            for part in parts:
                query, best, out = None, Best(k), []
                for queries in pq.ParquetFile(files.open_input_file(part)).iter_batches(1024):
                    weights = vectors_of(queries.column(1), queries.column(2), scale)
                    for q, w in zip(queries.column(0).to_pylist(), weights, strict=True):
                        if q != query:
                            out += [(query, -i, *reported(s)) for _, (s, i) in best.top()]
                            query, best = q, Best(k)
                        w = matrix([w])[0]
                        for b, block in enumerate(indexed):
                            at, scores = block.top(q, w, k)
                            best.add(b, block.ids[at], at, scores)
                    if out:
                        yield emit(out)
                        out = []
                out += [(query, -i, *reported(s)) for _, (s, i) in best.top()]
                if out:
                    yield emit(out)

        def index(held):
            """Blocks of the narrow rows and of the others."""
            table = pa.Table.from_batches(held)
            ids, values = table.column(0).to_numpy(), vectors_of(table.column(1), table.column(2), scale)
            wide = np.array([isinstance(v, list) for v in values], bool)
            return [Block(ids[own], matrix([values[i] for i in own]), slice_bits) for own in (np.flatnonzero(~wide), np.flatnonzero(wide)) if len(own)]

        indexed, held, size = [], [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, block_rows - size))
                at += held[-1].num_rows
                size += held[-1].num_rows
                if size == block_rows:
                    indexed, held, size = indexed + index(held), [], 0
                    if len(indexed) >= 2 * task_blocks:
                        yield from answer(indexed)
                        indexed = []
        if size:
            indexed += index(held)
        if indexed:
            yield from answer(indexed)

    found = rows.repartition(tasks).mapInArrow(run, "query_id long, vec_id long, score long, beyond binary")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
