"""Re-Pair grammar compression of token ids, per shard, with random-access decoding.

Frequent pairs of adjacent ids become nonterminals, round after round, until no pair pays for its
rule; pairs never span documents. A segment file holds the rules and the expansion length of each of them, so a
document, or a stretch of one, is decoded alone.

File (little-endian): magic ``RPG1``; u32 width of a symbol (2 or 4), documents, rules, first
nonterminal; u64 symbols; then i64 doc ids, u8 null flags, u64 first symbol of each document and the
end, u64 tokens of each document, rules as pairs, u32 expansion lengths, symbols; last the u32 crc32
of all before.

Null and empty texts hold the end id alone; null ids sort first; repeated rows stay, in the order of
their texts; an empty table writes no file. Columns beside the id and the text are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import shared, tokens

_HEAD = "<4sIIIIQ"


def _hashed(keys, bits: int = 18):
    """Slots of 32- or 64-bit keys in a table of 2 ** bits."""
    import numpy as np

    if keys.dtype == np.uint32:
        return (keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def _found(keys, chosen, bits: int = 18):
    """(places in keys, numbers in chosen) of keys among the chosen ones. Of chosen keys that share a slot one counts this time."""
    import numpy as np

    table = np.zeros(1 << bits, "i2" if len(chosen) < 1 << 15 else "i4")
    table[_hashed(chosen, bits)] = np.arange(len(chosen))
    at = table[_hashed(keys, bits)]
    places = np.flatnonzero(chosen[at] == keys)
    return places, at[places].astype("i8")


def _apart(where, rule, rank):
    """Places that do not overlap: of two next to each other the one whose rule ranks before, of a run of one rule every other one."""
    import numpy as np

    near = np.diff(where) == 1
    met = np.zeros(len(where), bool)
    met[1:] |= near
    met[:-1] |= near
    taken, some = ~met, np.flatnonzero(met)
    if not len(some):
        return where, rule
    place, own = where[some], rule[some]
    near = np.diff(place) == 1
    run = np.flatnonzero(np.concatenate([[True], ~near | (own[1:] != own[:-1])]))
    odd = (np.arange(len(place)) - np.repeat(run, np.diff(np.append(run, len(place))))) & 1
    k = 2 * rank[own] + odd
    open_ = np.ones(len(place), bool)
    for _ in range(4):  # what is still open then waits for the next round
        first = near & (k[:-1] < k[1:])  # of two neighbours the left one goes before
        wins = open_.copy()
        wins[1:] &= ~first
        wins[:-1] &= first | ~near
        taken[some[wins]] = True
        open_ &= ~wins
        open_[1:] &= ~(wins[:-1] & near)
        open_[:-1] &= ~(wins[1:] & near)
        if not open_.any():
            break
        k[~open_] = 2 * len(rank) + 2
    return where[taken], rule[taken]


def compress(ids, ends, base: int, per_round: int = 6144, least: int = 5):
    """(symbols, ends, rules, expansion lengths) of ids; ``ends``: one past the last id of each document.

    A round replaces up to ``per_round`` of the most frequent pairs at once. Rounds go on until no pair
    is left that stands ``least`` times without overlapping itself: a rule takes the bytes of four
    symbols (its pair and its length), so fewer places do not pay. Where 16 bits are used up, symbols
    become 32 bits wide if all pairs that are left, taken together, could save what that costs;
    otherwise none of them pays any more.
    """
    import numpy as np

    ends = np.asarray(ends, "i8")
    narrow = base < 1 << 16
    s = np.asarray(ids).astype("u2" if narrow else "u4")
    rules, sizes = np.zeros((0, 2), "u4"), np.zeros(0, "u4")
    fresh = None  # where only pairs with a symbol of the latest round can have become frequent, the first of these symbols
    while len(s) > 1:
        room = (1 << 16 if narrow else 1 << 31) - base - len(rules)
        kind, shift, low = ("u4", 16, 0xFFFF) if narrow else ("u8", 32, 0xFFFFFFFF)
        inner = np.ones(len(s), bool)
        inner[ends[ends > 0] - 1] = False
        if fresh is None:
            pair = s[:-1].astype(kind) << shift
            pair |= s[1:]
            order = np.sort(pair[inner[:-1]])
        else:
            at = np.flatnonzero(s >= fresh)
            at = np.union1d(at, at - 1)
            at = at[(at >= 0) & (at < len(s) - 1)]
            at = at[inner[at]]
            pair = (s[at].astype(kind) << shift) | s[at + 1]
            order = np.sort(pair)
        edge = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]])) if len(order) else np.zeros(0, "i8")
        value, count = order[edge], np.diff(np.append(edge, len(order)))
        often = np.flatnonzero(count >= least)
        if not room and len(often):
            if 4 * int(count[often].sum()) <= 2 * (len(s) + 2 * len(rules)):
                break
            narrow, s, fresh = False, s.astype("u4"), None
            continue
        k = min(per_round, room)
        capped = len(often) > k
        if capped:
            often = np.sort(often[np.lexsort((value[often], -count[often]))[:k]])
        where = rule = np.zeros(0, "i8")
        if len(often):
            chosen = value[often]
            ranked = np.lexsort((chosen, -count[often]))
            rank = np.empty(len(chosen), "i8")
            rank[ranked] = np.arange(len(chosen))
            places, rule = _found(pair, chosen)
            if fresh is None:
                own = inner[places]
                where, rule = places[own], rule[own]
            else:
                where = at[places]
            capped |= np.bincount(rule, minlength=len(chosen)).min() == 0  # pairs that shared a slot
            where, rule = _apart(where, rule, rank)
            keep = np.bincount(rule, minlength=len(chosen)) >= least
            if not keep.any():
                # Others took their places from all of them: the first that has enough by itself is taken alone.
                for one in ranked.tolist():
                    where = np.flatnonzero(pair == chosen[one])
                    where = where[inner[where]] if fresh is None else at[where]
                    where, rule = _apart(where, np.full(len(where), one), rank)
                    if len(where) >= least:
                        keep[one] = True
                        break
            where, rule = where[keep[rule]], (np.cumsum(keep) - 1)[rule[keep[rule]]]
        if not len(where):
            if fresh is None:
                break
            fresh = None  # a last look at all pairs
            continue
        left, right = (chosen[keep] >> shift).astype("i8"), (chosen[keep] & low).astype("i8")
        every = np.concatenate([np.ones(base, "u4"), sizes])
        sizes = np.concatenate([sizes, every[left] + every[right]])
        fresh = None if capped else base + len(rules)
        s[where] = base + len(rules) + rule
        stay = np.ones(len(s), bool)
        stay[where + 1] = False
        ends = ends - np.searchsorted(where + 1, ends)
        s = s[stay]
        rules = np.concatenate([rules, np.stack([left, right], 1).astype("u4")])
    return s, ends, rules, sizes


def expand(s, base: int, rules):
    """The ids that symbols stand for."""
    import numpy as np

    s = np.asarray(s, "u4")
    while True:
        big = s >= base
        if not big.any():
            return s
        times = 1 + big.astype("i8")
        at = np.cumsum(times) - times
        out = np.repeat(s, times)
        out[at[big]] = rules[s[big] - base, 0]
        out[at[big] + 1] = rules[s[big] - base, 1]
        s = out


def expand_all(s, base: int, rules, sizes):
    """The same for many symbols: each rule is expanded once."""
    import numpy as np

    flat = np.concatenate([np.arange(base, dtype="u4"), expand(np.arange(base, base + len(rules)), base, rules)])
    size = np.concatenate([np.ones(base, "i8"), sizes])
    first = np.cumsum(size) - size
    own = size[s]
    ends = np.cumsum(own)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[s] - (ends - own), own)]


def to_bytes(doc_ids: list[int | None], ids, ends, base: int) -> bytes:
    """A segment file's content."""
    import numpy as np

    counts = np.diff(np.concatenate([[0], ends])).astype("<u8")
    s, new_ends, rules, sizes = compress(ids, ends, base)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    kind = f"<u{width}"
    body = [
        struct.pack(_HEAD, b"RPG1", width, len(doc_ids), len(rules), base, len(s)),
        np.array([d if d is not None else 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], "u1").tobytes(),
        np.concatenate([[0], new_ends]).astype("<u8").tobytes(),
        counts.tobytes(),
        rules.astype(kind).tobytes(),
        sizes.astype("<u4").tobytes(),
        s.astype(kind).tobytes(),
    ]
    data = b"".join(body)
    return data + struct.pack("<I", zlib.crc32(data))


class Segment:
    """A segment file read back."""

    def __init__(self, data: bytes):
        import numpy as np

        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("the segment is damaged")
        magic, width, docs, rules, self.base, symbols = struct.unpack_from(_HEAD, data)
        if magic != b"RPG1":
            raise ValueError("not a segment")
        at = struct.calcsize(_HEAD)

        def take(kind: str, n: int):
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null, strict=True)]
        self.first, self.counts = take("<u8", docs + 1).astype("i8"), take("<u8", docs).astype("i8")
        self.rules = take(f"<u{width}", 2 * rules).reshape(-1, 2).astype("<u4")
        self.sizes = take("<u4", rules)
        self.symbols = take(f"<u{width}", symbols)

    def document(self, k: int):
        """All ids of the k-th document."""
        return expand(self.symbols[self.first[k] : self.first[k + 1]], self.base, self.rules)

    def stretch(self, k: int, start: int, stop: int):
        """Ids start..stop of the k-th document; only the symbols that cover them are expanded."""
        import numpy as np

        s = self.symbols[self.first[k] : self.first[k + 1]].astype("<u4")
        size = np.where(s < self.base, 1, self.sizes[np.maximum(s.astype("i8") - self.base, 0)] if len(self.sizes) else 1)
        ends = np.cumsum(size)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skipped = int(ends[a - 1]) if a else 0
        return expand(s[a:b], self.base, self.rules)[start - skipped : stop - skipped]


def write(docs: DataFrame, out: str, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = 2500, segment_ids: int = 1 << 20) -> DataFrame:
    """Write all documents' ids, ascending by id, as segments below ``out``; returns the manifest.

    Ranges of ids of about ``shard_rows`` documents are one task each (cut by the id column alone, so
    that texts are read once); a task streams its documents and writes a segment for
    about ``segment_ids`` ids (a longer document has one of its own), under a temporary name first.
    A task that runs again writes the same bytes under the same names. The manifest is a table in
    ``out``/manifest: shard, segment, file, documents, ids, bytes.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = shared.range_cuts(rows.select("doc_id"), "doc_id", F.lit(1), shard_rows)
    ranged = shared.with_range(rows, "doc_id", cuts, "dm_shard").repartitionById(len(cuts[2]) + 1, "dm_shard").sortWithinPartitions("doc_id", "text")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        files, root = shared.files(out)
        encoder = tokens.word_encoder(path)
        base = encoder.library.get_vocab_size()
        shard, segment, made = TaskContext.get().partitionId(), 0, []
        end = struct.pack("<I", end_id)
        ids: list[bytes] = []
        names: list[int | None] = []
        held = 0

        def flush():
            nonlocal ids, names, held, segment
            flat = np.frombuffer(b"".join(ids), "<u4")
            ends = np.cumsum([len(x) // 4 for x in ids])
            data = to_bytes(names, flat, ends, max(base, int(flat.max()) + 1))
            name = f"{shard:06d}-{segment:05d}.rpg"
            files.create_dir(f"{root}/tmp", recursive=True)
            with files.open_output_stream(temp := f"{root}/tmp/{name}.{uuid.uuid4().hex}", compression=None) as f:
                f.write(data)
            files.move(temp, f"{root}/{name}")
            made.append((shard, segment, name, len(names), len(flat), len(data)))
            ids, names, held, segment = [], [], 0, segment + 1

        for batch in batches:
            texts = batch.column(1)
            for at, doc in enumerate(batch.column(0).to_pylist()):
                own = encoder.ids(texts[at].as_py()) + end
                if held and held + len(own) // 4 > segment_ids:
                    flush()
                ids.append(own)
                names.append(doc)
                held += len(own) // 4
        if held:
            flush()
        if made:
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names=["shard", "segment", "file", "documents", "ids", "bytes"])

    schema = "shard int, segment int, file string, documents long, ids long, bytes long"
    files, root = shared.hadoop_path(docs.sparkSession, out)
    files.mkdirs(root)
    ranged.select("doc_id", "text").mapInArrow(run, schema).write.parquet(f"{out}/manifest")
    return docs.sparkSession.read.schema(schema).parquet(f"{out}/manifest")


def read(manifest: DataFrame, out: str) -> DataFrame:
    """Per document of the segments: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    totals = manifest.groupBy("shard").agg(F.sum("ids").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("ids").over(W.partitionBy("shard").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = manifest.join(totals.select("shard", before.alias("dm_before")), "shard").select("file", (F.col("dm_before") + inside).alias("dm_start"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        files, root = shared.files(out)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with files.open_input_stream(f"{root}/{name}", compression=None) as f:
                    seg = Segment(f.read())
                flat = expand_all(seg.symbols, seg.base, seg.rules, seg.sizes)
                ends = np.cumsum(seg.counts)
                view = memoryview(flat.tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip((ends - seg.counts).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(seg.doc_ids, pa.int64()), pa.array(start + ends - seg.counts), pa.array(seg.counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = 1 + manifest.count() // 4  # a few files each
    return starts.repartition(min(tasks, 4096)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
