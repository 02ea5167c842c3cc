"""Fuzzy deduplication of texts and pairs of close texts, both over candidates that an equi-join finds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftmark.functions import text as T
from driftmark.operators import order as ranges


class Beginnings:
    """Texts in the order of their coming; ``first`` names the earliest one that another text matches.

    The longest common subsequence bounds what a sequence matcher matches in order. It is found for
    some hundred texts at once: their characters are bits of one number, each text in bytes of its
    own with a spare bit, which keeps carries apart. Only what this bound lets pass goes to the matcher.
    """

    def __init__(self, threshold: float, bits: int = 1 << 15, held: int = 1 << 20):
        self.threshold, self.bits, self.held = threshold, bits, held
        self.texts: list[str] = []
        self.blocks: list[dict] = []
        self.prepared: dict = {}
        self.chars = 0

    def add(self, text: str) -> None:
        if not self.blocks or 8 * self.blocks[-1]["width"] >= self.bits:
            self.blocks.append({"first": len(self.texts), "width": 0, "full": 0, "masks": {}, "starts": [], "sizes": []})
        block = self.blocks[-1]
        raw: dict[str, bytearray] = {}
        for i, c in enumerate(text):
            raw.setdefault(c, bytearray(len(text) // 8 + 1))[i >> 3] |= 1 << (i & 7)
        at = 8 * block["width"]
        for c, m in raw.items():
            block["masks"][c] = block["masks"].get(c, 0) | int.from_bytes(m, "little") << at
        block["full"] |= ((1 << len(text)) - 1) << at
        block["starts"].append(block["width"])
        block["sizes"].append(len(text))
        block["width"] += len(text) // 8 + 1
        self.texts.append(text)

    def _common(self, block: dict, text: str):
        """Length of the longest common subsequence with each text of a block."""
        import numpy as np

        v, full, masks = block["full"], block["full"], block["masks"]
        for c in text:
            if m := masks.get(c):
                u = v & m
                v = ((v + u) | (v - u)) & full
        ones = np.bitwise_count(np.frombuffer(v.to_bytes(block["width"], "little"), "u1")).astype("i8")
        return np.array(block["sizes"]) - np.add.reduceat(ones, block["starts"])

    def _matcher(self, i: int):
        """A matcher prepares its second text once; those of up to ``held`` characters are kept."""
        from difflib import SequenceMatcher

        if i not in self.prepared:
            if self.chars > self.held:
                self.prepared, self.chars = {}, 0
            self.prepared[i] = SequenceMatcher(None, "", self.texts[i])
            self.chars += len(self.texts[i])
        return self.prepared[i]

    def first(self, text: str) -> int | None:
        import numpy as np

        for block in self.blocks:
            sizes = np.array(block["sizes"])
            need = self.threshold * (sizes + len(text)) / 2 - 1e-9
            if not (np.minimum(sizes, len(text)) >= need).any():
                continue
            for i in np.flatnonzero(self._common(block, text) >= need).tolist():
                matcher = self._matcher(block["first"] + i)
                matcher.set_seq1(text)
                if matcher.ratio() >= self.threshold:
                    return block["first"] + i
        return None


def settled(rows: DataFrame, threshold: float) -> DataFrame:
    """(node, norm, house, before): the first beginning that each node matches, null if there is none.

    rows: node, norm, house, slice and role, which is 0 for a beginning, 1 for a node that is only
    compared and 2 for one that becomes a beginning if it matches none. Each slice of a house number
    is one group, read in order; a task holds its beginnings only.
    """
    kinds = "node long, norm string, house string, before long"

    def run(batches):
        import pyarrow as pa

        key, begun, names = None, None, []
        for batch in batches:
            out = []
            for node, norm, house, part, role in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (house, part) != key:
                    key, begun, names = (house, part), Beginnings(threshold), []
                at = begun.first(norm) if role else None
                if role == 0 or (role == 2 and at is None):
                    begun.add(norm)
                    names.append(node)
                    at = len(names) - 1
                if role:
                    out.append((node, norm, house, None if at is None else names[at]))
            if out:
                types = (pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["node", "norm", "house", "before"])

    # Rows are few bytes and much work, so that the number of tasks is not left to their size.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("node", "norm", "house", "slice", "role").repartition(parts, "house", "slice")
    return dealt.sortWithinPartitions("house", "slice", "role", "node").mapInArrow(run, kinds)


def fuzzy_dedup(df: DataFrame, column: str, order: str, threshold: float = 0.82, keep: int = 2, first: int = 64, rows_a_slice: int = 1024) -> DataFrame:
    """The ``keep`` longest distinct texts of each cluster (ties: the lesser text), one column.

    A text joins the first cluster, in order, whose first member has the same house number and a
    matching ratio of at least ``threshold``; otherwise it begins one. Texts of one normal form are
    one node. In each round the first open nodes of every house number, more of them each time but
    at most 1000, settle among themselves which of them begin clusters; all other open nodes are
    compared with these beginnings, and what matches one belongs to the first that it matches, as it
    matched none of the rounds before. Each node meets each beginning up to its own once, so the
    work is nodes times beginnings of a house number. A task holds slices of a house number of about
    ``rows_a_slice`` nodes and the beginnings of a round.

    Null texts are left out; empty ones match each other; repeated texts count once.
    """
    once = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("dm_order")).select(F.col(column).alias("text"), "dm_order", T.fuzzy_key(column).alias("norm"))
    once = ranges.cut(once)
    least = once.groupBy("norm").agg(F.min(F.struct("dm_order", "text")).alias("o")).select("norm", "o.dm_order", "o.text")
    nodes = ranges.cut(ranges.numbered(least, ["dm_order", "text"], "node").select("node", "norm", F.coalesce(T.house_key("norm"), F.lit("")).alias("house")))

    open_, places, seen = nodes, [], first
    while not open_.isEmpty():
        # The limit is known to Spark, which sends no more than these rows of a house number.
        rank = F.row_number().over(W.partitionBy("house").orderBy("node"))
        top = open_.withColumn("r", rank).where(F.col("r") <= seen).drop("r")
        tops = ranges.cut(settled(top.withColumns({"slice": F.lit(0), "role": F.lit(2)}), threshold))
        begun = tops.where("node = before").drop("before")
        rest = open_.join(tops.select("node"), "node", "left_anti")
        large = F.broadcast(rest.groupBy("house").agg(F.ceil(F.count("*") / rows_a_slice).cast("int").alias("slices")).where("slices > 1"))
        slices = F.coalesce("slices", F.lit(1))
        each = begun.join(large, "house", "left").withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).withColumn("role", F.lit(0))
        some = rest.join(large, "house", "left").withColumn("slice", F.pmod(F.xxhash64("node"), slices).cast("int")).withColumn("role", F.lit(1))
        met = ranges.cut(settled(each.unionByName(some), threshold))
        places += [tops.select("node", "before"), met.where("before is not null").select("node", "before")]
        open_ = met.where("before is null").drop("before")
        seen = min(4 * seen, 1000)
    if not places:
        return df.select(column).where("false")
    members = once.join(nodes.select("norm", "node"), "norm").join(reduce(DataFrame.union, places).withColumnRenamed("before", "cluster"), "node")
    rank = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc(F.length("text")), "text"))
    return members.select("text", rank.alias("r")).where(F.col("r") <= keep).select(F.col("text").alias(column))


def neighbourhood(text: Column, most: int) -> Column:
    """The text and all that it becomes with up to ``most`` characters gone. Two texts within ``most`` edits share one of these."""
    less = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.left(t, i - 1), F.substr(t, i + 1)))
    out = level = F.array(text)
    for _ in range(most):
        level = F.flatten(F.transform(level, lambda t: F.when(t == "", F.array(t)).otherwise(less(t))))
        out = F.concat(out, level)
    return F.array_distinct(out)


def close_pairs(df: DataFrame, key: str, id_col: str, column: str, most: int) -> DataFrame:
    """(a, b, distance), a < b: rows with the same key whose texts are at most ``most`` edits apart.

    Texts meet on what deletions leave of them, each text once for all its rows; ids come in at the end,
    by joins on the text, of which Spark splits one that very many rows share. Rows without key, id or
    text have no pairs. The result has a row for every pair of rows, so copies of a text give all theirs.
    """
    rows = df.select(F.col(key).alias("k"), F.col(id_col).alias("id"), F.col(column).alias("t")).dropna()
    texts = ranges.cut(rows.groupBy("k", "t").agg(F.count("*").alias("n")))
    ends = texts.select("k", "t", F.explode(neighbourhood(F.col("t"), most)).alias("left")).select(F.xxhash64("k", "left").alias("h"), "k", "t")
    one, two = ends.select("h", F.col("k").alias("ka"), F.col("t").alias("ta")), ends.select("h", F.col("k").alias("kb"), F.col("t").alias("tb"))
    near = one.join(two, "h").where("ka = kb and ta < tb").where(F.abs(F.length("ta") - F.length("tb")) <= most).select(F.col("ka").alias("k"), "ta", "tb").distinct()
    near = near.withColumn("distance", F.levenshtein("ta", "tb")).where(F.col("distance") <= most)
    several = texts.where("n > 1").select("k", F.col("t").alias("ta"), F.col("t").alias("tb"), F.lit(0).alias("distance"))
    side = lambda p: rows.select("k", F.col("id").alias(p), F.col("t").alias(f"t{p}"))
    met = near.union(several).join(side("a"), ["k", "ta"]).join(side("b"), ["k", "tb"]).where("ta <> tb or a < b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")
