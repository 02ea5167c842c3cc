"""Benchmark decontamination by an Aho-Corasick automaton over normalised test items.

Texts are normalised byte by byte (A-Z folded, everything that is no word character a space), so
places in the normalised text map back to the original. Every window of ``window`` consecutive
words of an item (or the whole item, if it is shorter) is a pattern of the automaton; a document is
scanned once.

The patterns are a table in the shared folder, dealt by their hash into as many blocks as it takes
for about ``block_bytes`` of item text each; a task reads the blocks in turn, so neither it nor the
driver holds more than one automaton (some 60 times ``block_bytes``) and the texts of ``chunk`` characters.
Findings of all blocks are merged before a document's row is made, so that blocks change nothing.

Null texts, texts without words and items without words match nothing; equal windows of several
items count for each of them; items without id count as one with an empty id; repeated rows give a
row each; texts of any length are scanned whole; an empty benchmark leaves every document clean.
Columns beside the named ones are not read; ``clean`` keeps them, whatever their names.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: A-Z to a-z; digits, a-z and all bytes of non-ASCII characters as they are; the rest to spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_BUILT: dict[tuple, object] = {}


def words_of(text: str | None) -> list[bytes]:
    """Normalised words of a whole text."""
    return text.encode().translate(_FOLD).split() if text else []


def windows_of(words: list[bytes], window: int) -> set[bytes]:
    if len(words) < window:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + window]) for i in range(len(words) - window + 1)}


def patterns(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int, scope: str) -> tuple[str, int]:
    """(path, number of blocks) of the table of patterns: folders block=0, 1, ... of (w, item)."""
    texts = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text")).where("text is not null")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            items = batch.column(0).to_pylist()
            for i in range(batch.num_rows):
                own = sorted(windows_of(words_of(batch.column(1)[i].as_py()), window))
                for a in range(0, len(own), 10_000):
                    some = own[a : a + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array([items[i]] * len(some), pa.string())], names=["w", "item"])

    path = shared.scratch(benchmark.sparkSession, scope)
    if blocks:
        dealt = texts.mapInArrow(run, "w binary, item string").withColumn("block", F.pmod(F.xxhash64("w"), F.lit(blocks)))
        dealt.repartition("block").write.partitionBy("block").parquet(path)
    return path, blocks


def automaton(block: dict[bytes, list[str]]):
    """The automaton of a block; each pattern yields (number of words, item ids). None without patterns."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for w, items in block.items():
        out.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, items))
    out.make_automaton()
    return out if block else None


def built(path: str, block: int):
    """The automaton of one block of the table of patterns; a worker keeps the last one."""
    if (path, block) not in _BUILT:
        import pyarrow.parquet as pq
        from pyarrow import fs

        _BUILT.clear()
        files, root = shared.files(f"{path}/block={block}")
        held: dict[bytes, set[str]] = {}
        listed = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        for f in sorted(x.path for x in listed if x.path.endswith(".parquet")):
            for batch in pq.ParquetFile(files.open_input_file(f)).iter_batches(columns=["w", "item"]):
                for w, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    held.setdefault(w, set()).add(item)
        _BUILT[path, block] = automaton({w: sorted(x) for w, x in held.items()})
    return _BUILT[path, block]


def spaced(text: str | None) -> tuple[int, str, bytes]:
    """(number of words, words between single spaces, folded text) of a whole text."""
    folded = text.encode().translate(_FOLD) if text else b""
    words = folded.split()
    return len(words), (b" " + b" ".join(words) + b" ").decode("latin-1") if words else "", folded


def occurrences(lines: list[str], path: str, blocks: int, first_only: bool = False) -> list[list]:
    """Of each line the (place of the last character, (words, items)) of all patterns in it, block by block."""
    out: list[list] = [[] for _ in lines]
    for block in range(blocks):
        found = built(path, block)
        if found is not None:
            for line, hits in zip(lines, out, strict=True):
                if line and not (first_only and hits):
                    hits.extend(itertools.islice(found.iter(line), 1) if first_only else found.iter(line))
    return out


def merged(line: str, hits: list) -> tuple[list[tuple[int, int]], set[str]]:
    """(ranges of hit words, items) of the occurrences in a line."""
    import numpy as np

    hits.sort(key=lambda h: h[0])
    ranges, items = [], set()
    spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), "u1") == 32)
    ends = np.searchsorted(spaces, [e for e, _ in hits])  # the space after word i is space i + 1
    for end, (_, (n, own)) in zip(ends.tolist(), hits, strict=True):
        items.update(own)
        if ranges and ranges[-1][1] >= end - n:
            first = min(ranges[-1][0], end - n)
            while len(ranges) > 1 and ranges[-2][1] >= first:
                first = min(first, ranges.pop(-2)[0])
            ranges[-1] = (first, max(end, ranges[-1][1]))
        else:
            ranges.append((end - n, end))
    return ranges, items


def chunks(batch, at: int, chunk: int):
    """(first row, texts) of stretches of a batch of about ``chunk`` characters."""
    column, row = batch.column(at), 0
    while row < batch.num_rows:
        first, texts, held = row, [], 0
        while row < batch.num_rows and held < chunk:
            texts.append(column[row].as_py())
            held += len(texts[-1] or "")
            row += 1
        yield first, texts


def char_spans(folded: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of words as spans of code points of the original text."""
    import numpy as np

    raw = np.frombuffer(folded, "u1")
    word = np.concatenate([[False], raw != 32, [False]])
    starts, ends = np.flatnonzero(~word[:-1] & word[1:]), np.flatnonzero(word[:-1] & ~word[1:])
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return [(int(chars[starts[a]]), int(chars[ends[b - 1]])) for a, b in ranges]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 1_000_000, chunk: int = 32_000_000, scope: str = "benchmark") -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items (sorted as strings), spans (of code points). One scan, no shuffle."""
    path, blocks = patterns(benchmark, item_col, item_text, window, block_bytes, scope)

    def run(batches):
        import pyarrow as pa

        pair = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pair)
        for batch in batches:
            ids = batch.column(0)
            for first, texts in chunks(batch, 1, chunk):
                out, known = [], [spaced(t) for t in texts]
                for i, hits in enumerate(occurrences([k[1] for k in known], path, blocks)):
                    n, line, folded = known[i]
                    ranges, items = merged(line, hits) if hits else ([], set())
                    spans = [{"start": a, "stop": b} for a, b in char_spans(folded, ranges)] if ranges else []
                    out.append((ids[first + i].as_py(), n, sum(b - a for a, b in ranges), len(items), sorted(items), spans))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_words", "n_hit", "n_items", "items", "spans"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start:long,stop:long>>")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 1_000_000, chunk: int = 32_000_000, scope: str = "benchmark") -> DataFrame:
    """The rows of docs, with all their columns, in which no window of the benchmark occurs. One scan, no shuffle."""
    path, blocks = patterns(benchmark, item_col, item_text, window, block_bytes, scope)
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first, texts in chunks(batch, at, chunk):
                hits = occurrences([spaced(t)[1] for t in texts], path, blocks, first_only=True)
                yield batch.slice(first, len(texts)).filter(pa.array([not h for h in hits], pa.bool_()))

    plain, _ = shared.numbered(docs)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns) if blocks else docs
