"""Prefix trie of conversations by chained digests.

Each conversation's turns are chained, in order, into SHA-256 digests of its prefixes, so that equal
prefixes, and only those, have equal digests. Every prefix is a row, and a node is a group of (depth,
digest); the root is the prefix without turns. What a subtree adds up to comes from each node's row
exploded to all its ancestors. A node with one member only heads a chain of such nodes, with one leaf
and nothing saved, so below the nodes that several conversations share only leaves are exploded.

Turns are streamed in the order of their conversation, with one row in memory; the ids of those that
end at a node are joined in chunks of 512 and digested as a stream, so that neither a long
conversation nor a node where a third of all of them end is ever collected.

Null roles and texts count as empty; rows without a conversation or without a position are not
turns; repeated rows are turns of their own; turns with equal positions follow by role, then text;
texts of any length are digested whole; an empty table gives no nodes, not even a root. Columns
beside the named ones are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import shared

_ROOT = hashlib.sha256(b"").digest()


def positions(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 1; null turns first, ties by role and text), role, text."""
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select("conv_id", F.row_number().over(W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")).alias("pos"), "role", "text")


def prefixes(turns: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """A row for every prefix of every conversation: conv_id, depth, digest, parent, bytes (of the last text), last.

    turns: conv_id, pos, role, text. members: conv_id of all conversations, turnless ones too.
    """
    known = (turns if members is None else members).select("conv_id").distinct()
    heads = known.select("conv_id", F.lit(None).cast("long").alias("pos"), F.lit("").alias("role"), F.lit("").alias("text"))
    rows = heads.union(turns.where("pos is not null").select("conv_id", F.col("pos").cast("long"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))))

    def run(batches):
        import pyarrow as pa

        kinds = {"conv_id": pa.int64(), "depth": pa.int64(), "digest": pa.binary(), "parent": pa.binary(), "bytes": pa.int64(), "last": pa.bool_()}
        emit = lambda rows_: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows_, strict=True), kinds.values(), strict=True)], names=list(kinds))
        before = None  # the latest prefix, whose being last is not known yet
        for batch in batches:
            out = []
            for conv, pos, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if pos is None or before is None or before[0] != conv:
                    now = (conv, 0, _ROOT, None, 0)
                else:
                    text, own = text.encode(), role.encode()
                    digest = hashlib.sha256(before[2] + len(own).to_bytes(8, "little") + own + text).digest()
                    now = (conv, before[1] + 1, digest, before[2], len(text))
                if before is not None:
                    out.append((*before, before[0] != conv))
                before = now
            if out:
                yield emit(out)
        if before is not None:
            yield emit([(*before, True)])

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("pos"), "role", "text")
    return ordered.mapInArrow(run, "conv_id long, depth long, digest binary, parent binary, bytes long, last boolean")


def joined_digests(rows: DataFrame, keys: list[str], value: str, chunk: int = 9) -> DataFrame:
    """keys and sha256, lower-case hex, of the ascending decimal values of each group, comma-joined. Keys are (long, binary), values distinct longs."""
    chunks = rows.groupBy(*keys, F.shiftright(value, chunk).alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(value)), lambda x: x.cast("string")), ",").alias("ids"))
    ordered = chunks.repartition(*keys).sortWithinPartitions(*keys, "chunk").select(*keys, "ids")

    def run(batches):
        import pyarrow as pa

        key, state = None, None
        emit = lambda done: pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in done], pa.int64()), pa.array([k[1] for k, _ in done], pa.binary()), pa.array([d for _, d in done])], names=[*keys, "sha256"])
        for batch in batches:
            done = []
            for depth, digest, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (depth, digest) != key:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = (depth, digest), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield emit(done)
        if key is not None:
            yield emit([(key, state.hexdigest())])

    return ordered.mapInArrow(run, f"{keys[0]} long, {keys[1]} binary, sha256 string")


def trie(turns: DataFrame, members: DataFrame | None = None, scope: str = "trie") -> DataFrame:
    """A row for each node: conv_id (the least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, pos, role, text. A node saves its last text's bytes for every member but one;
    saved_tokens adds that up over its subtree, n_leaves counts the childless nodes in it.
    """
    key = ["depth", "digest"]
    paths = shared.stored(prefixes(turns, members), scope)
    grouped = paths.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("parent").alias("parent"), F.first("bytes").alias("bytes"))
    nodes = shared.stored(grouped, scope)
    born = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    upper = nodes.select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    # Of a conversation's nodes those with several members come first: deep is the depth of the last of them.
    alone = nodes.where("n_convs = 1").groupBy("conv_id").agg((F.min("depth") - 1).alias("deep"))
    family = nodes.join(born, key, "left").fillna(0, ["n_children"]).join(upper, ["depth", "parent"], "left")
    family = shared.stored(family.join(alone, "conv_id", "left"), scope)
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("bytes")
    adds = family.select("conv_id", F.when(F.col("n_convs") > 1, F.col("depth")).otherwise(F.col("deep")).alias("to"), leaf.alias("leaf"), saved.alias("saved")).where("(leaf > 0 or saved > 0) and to >= 0")
    up = adds.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), "to")).alias("depth"), "leaf", "saved").groupBy("conv_id", "depth").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    sums = up.join(paths.select("conv_id", *key), ["conv_id", "depth"]).groupBy(*key).agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ends = joined_digests(paths.where("last").select(*key, "conv_id"), key, "conv_id").withColumnRenamed("sha256", "ends_sha256")
    full = family.join(sums, key, "left").join(ends, key, "left")
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0).cast("long")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def rebuilt(turns: DataFrame, every: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, members): conversation c starts with the first h turns of c - c % every and goes on with its own after its first h; h = crc32(c) % heads.

    turns: conv_id, pos, role, text, stored.
    """
    h = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % heads
    members = turns.select("conv_id").distinct()
    first = turns.where((F.col("pos") < heads) & (F.col("conv_id") % every == 0)).withColumnRenamed("conv_id", "of")
    led = members.withColumn("of", F.col("conv_id") - F.col("conv_id") % every).join(first, "of").where(F.col("pos") <= h("conv_id"))
    own = turns.where(F.col("pos") > h("conv_id"))
    return own.select("conv_id", "pos", "role", "text").union(led.select("conv_id", "pos", "role", "text")), members
