"""Substring deduplication by level-wise doubling of repeated word windows.

Words are runs without ASCII white space, unchanged. A word goes if a window of ``window`` words that
covers it also starts anywhere else, in the same text or another one; windows are judged on the
input, not on what is left.

Lengths double until they reach the window: 9, 18 and 35 words for 35. At each length every
candidate window names one of the shorter sequences that it holds, the leftmost with the least hash,
so that all copies of a window name the same. Only windows whose sequence stands at two places or
more stay candidates and are looked at again at twice that length; at the last length the sequence
is the window itself. It ends early where no candidates survive.

Texts are stored once, in blocks of whole texts. A level is one pass over the blocks: the distinct
hashes of a block go to buckets of the hash, where a hash that two blocks hold is repeated; one bit a
hash goes back to the block, in a table in the shared folder, and the next pass reads it. A hash that
a third of all places share is one entry a block, so no bucket grows with its copies. Hashes have 64
bits until the last length, where they have 128 (of 128-bit word hashes). A task holds one block,
which is longer than ``block_bytes`` only where a single text is.

A null or empty text has no words; repeated rows repeat each other's windows; rows without id take
part; texts shorter than the window stay whole; texts of any length are read whole; an empty table
gives no rows. Columns beside the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import itertools

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .nearjoin import _mixed, grouped

#: Sequences of fewer words than this are common anywhere and are not counted.
SHORTEST = 7


def doublings(window: int) -> list[int]:
    """1, ..., window, each at most twice the one before."""
    out = [window]
    while out[0] > 1:
        out.insert(0, -(-out[0] // 2))
    return out


def levels(window: int) -> list[int]:
    """The lengths at which sequences are counted; the last is the window."""
    return [n for n in doublings(window) if n >= min(SHORTEST, window)]


def grown(h, have: int, n: int):
    """Hashes of n consecutive words from those of have, have < n <= 2 have."""
    import numpy as np

    step = n - have
    return _mixed(h[: max(0, len(h) - step)] * np.uint64(0x9E3779B97F4A7C15) + _mixed(h[step:] + np.uint64(n)))


def leftmost_least(h, wide: int):
    """For each place the place of the leftmost least value among it and the wide - 1 after it."""
    import numpy as np

    at, have = np.arange(len(h)), 1
    while have < wide:
        step = min(have, wide - have)
        left, right = h[: max(0, len(h) - step)], h[step:]
        less = right < left
        at = np.where(less, at[step:], at[: len(left)])
        h = np.where(less, right, left)
        have += step
    return at


def distinct(keys):
    """Distinct rows of an array of keys in ascending order, the number of each row's, and their counts."""
    import numpy as np

    order = np.lexsort(keys.T[::-1])
    rows = keys[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(1)
    group = np.cumsum(new) - 1
    number = np.empty(len(rows), "i8")
    number[order] = group
    return rows[new], number, np.bincount(group, minlength=int(new.sum()))


class Codes(dict):
    """A number for each word, in the order in which words come up."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self)
        return out


class Block:
    """The words of some texts and the places at which candidate windows start."""

    def __init__(self, texts: list[str | None], window: int):
        import numpy as np
        import xxhash

        self.window = window
        self.words = [t.encode().split() if t else [] for t in texts]
        self.ends = np.cumsum([len(w) for w in self.words])
        codes = Codes()
        flat = np.fromiter(map(codes.__getitem__, itertools.chain.from_iterable(self.words)), "i8", int(self.ends[-1]) if len(self.ends) else 0)
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, codes)), "<u8").reshape(-1, 2)
        self.hashes = [(1, digests[flat, 0].copy()), (1, digests[flat, 1].copy())]
        # A window starts where its last word is in the same text.
        text = np.repeat(np.arange(len(self.words)), [len(w) for w in self.words])
        n = max(0, len(text) - window + 1)
        self.starts = np.flatnonzero(text[:n] == text[window - 1 :])

    def _hash(self, stream: int, n: int):
        have, h = self.hashes[stream]
        for m in doublings(n):
            if m > have:
                h, have = grown(h, have, m), m
        self.hashes[stream] = (have, h)
        return h

    def sequences(self, n: int):
        """At a level: distinct keys of the candidates' sequences, whether each stands twice in here, and its number for each candidate."""
        import numpy as np

        h = self._hash(0, n)
        if n == self.window:
            keys, number, often = distinct(np.stack([h[self.starts], self._hash(1, n)[self.starts]], 1))
            return keys, often > 1, number
        at = leftmost_least(h, self.window - n + 1)[self.starts]
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        keys, number, often = distinct(h[at[new]][:, None])
        return keys, often > 1, number[np.cumsum(new) - 1]

    def covered(self):
        """Which words the windows that are left cover."""
        import numpy as np

        total = sum(map(len, self.words))
        change = np.zeros(total + 1, "i8")
        np.add.at(change, self.starts, 1)
        np.add.at(change, self.starts + self.window, -1)
        return np.cumsum(change)[:total] > 0


def parts_of(keys, buckets: int):
    """(bucket, first, end) of each bucket that holds some of the ascending keys."""
    import numpy as np

    of = (keys[:, 0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    held, first = np.unique(of, return_index=True)
    return zip(held.tolist(), first.tolist(), np.append(first, len(of))[1:].tolist(), strict=True)


def in_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, scope: str) -> DataFrame:
    """A table of blocks of whole texts: block, size, ids, texts."""

    def run(batches):
        import pyarrow as pa

        number = TaskContext.get().partitionId() << 33
        schema = pa.schema([("block", pa.int64()), ("size", pa.int64()), ("ids", pa.list_(pa.int64())), ("texts", pa.list_(pa.string()))])
        ids, texts, size = [], [], 0
        out = lambda: pa.RecordBatch.from_pylist([{"block": number, "size": size, "ids": ids, "texts": texts}], schema)
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = t.as_py()
                if ids and (size + len(t or "") > block_bytes or len(ids) >= 50_000):
                    yield out()
                    ids, texts, size, number = [], [], 0, number + 1
                ids.append(i)
                texts.append(t)
                size += len(t or "")
        if ids:
            yield out()

    return shared.stored(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "block long, size long, ids array<long>, texts array<string>"), scope)


def _narrowed(number: int, block: Block, found: list[tuple[str, int]], buckets: int) -> None:
    """Keep the candidates of a block that the verdicts of the levels so far leave."""
    import numpy as np
    import pyarrow.dataset as ds
    from pyarrow import fs

    for n, (path, folders) in zip(levels(block.window), found, strict=False):
        keys, _, at = block.sequences(n)
        files, root = shared.files(f"{path}/part={number % folders}")
        repeated = np.zeros(len(keys), bool)
        if files.get_file_info(root).type != fs.FileType.NotFound:
            rows = ds.dataset(root, filesystem=files, format="parquet").to_table(columns=["bucket", "bits"], filter=ds.field("block") == number)
            bits = dict(zip(rows.column("bucket").to_pylist(), rows.column("bits").to_pylist(), strict=True))
            for b, first, end in parts_of(keys, buckets):
                if b in bits:
                    repeated[first:end] = np.unpackbits(np.frombuffer(bits[b], "u1"), count=end - first).astype(bool)
        block.starts = block.starts[repeated[at]]


def verdicts(blocks: DataFrame, window: int, found: list[tuple[str, int]], buckets: int, folders: int, scope: str) -> DataFrame:
    """The next level's verdicts: part, block, bucket, bits (one for each key of the block in the bucket)."""
    n = levels(window)[len(found)]
    wide = 2 if n == window else 1

    def spread(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for number, texts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = Block(texts.as_py(), window)
                _narrowed(number, block, found, buckets)
                keys, twice, _ = block.sequences(n)
                rows = [(b, number, keys[i:j].tobytes(), np.packbits(twice[i:j]).tobytes()) for b, i, j in parts_of(keys, buckets)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "block", "keys", "twice"])

    def meet(batches):
        import numpy as np
        import pyarrow as pa

        rows = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)]
        keys = np.frombuffer(b"".join(r[2] for r in rows), "<u8").reshape(-1, wide)
        _, at, often = distinct(keys)
        shared_ = (often > 1)[at]
        out, first = [], 0
        for bucket, block, own, twice in rows:
            size = len(own) // (8 * wide)
            bits = shared_[first : first + size] | np.unpackbits(np.frombuffer(twice, "u1"), count=size).astype(bool)
            first += size
            if bits.any():
                out.append((block, bucket, np.packbits(bits).tobytes()))
        return [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["block", "bucket", "bits"])] if out else []

    met = grouped(blocks.select("block", "texts").mapInArrow(spread, "bucket long, block long, keys binary, twice binary"), ["bucket"], [], meet, "block long, bucket long, bits binary")
    return met.withColumn("part", F.pmod("block", F.lit(folders)))


def repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 2 << 20, bucket_bytes: int = 16 << 20, scope: str = "substring") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept (the words that stay, one space between), spans (start, stop) of removed words."""
    if window < 1:
        raise ValueError("a window has a word at least")
    spark = docs.sparkSession
    blocks = in_blocks(docs, id_col, text_col, block_bytes, scope)
    size, count = blocks.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    buckets = 1 + size // bucket_bytes
    folders = count // 16 | 1
    found: list[tuple[str, int]] = []
    left = True
    for _ in levels(window):
        path = shared.scratch(spark, scope)
        verdicts(blocks, window, found, buckets, folders, scope).repartition("part").sortWithinPartitions("part", "block").write.partitionBy("part").parquet(path)
        found.append((path, folders))
        left = not spark.read.schema("block long").parquet(path).isEmpty()
        if not left:
            break

    def run(batches):
        import numpy as np
        import pyarrow as pa

        spans_of = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            for number, ids, texts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                block = Block(texts.as_py(), window)
                if left:
                    _narrowed(number, block, found, buckets)
                else:
                    block.starts = block.starts[:0]
                gone, first = block.covered(), 0
                rows = []
                for words, end in zip(block.words, block.ends.tolist(), strict=True):
                    own = gone[first:end]
                    first, removed, spans, kept = end, int(own.sum()), [], words
                    if removed:
                        edges = np.flatnonzero(np.diff(own.astype("i1"), prepend=0, append=0)).tolist()
                        spans = [{"start": a, "stop": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]
                        kept = itertools.compress(words, (~own).tolist())
                    rows.append((len(words), removed, b" ".join(kept).decode(), spans))
                n_words, n_removed, kept, spans = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, spans_of)], names=["doc_id", "n_words", "n_removed", "kept", "spans"])

    return blocks.select("block", "ids", "texts").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:long,stop:long>>")
