"""Shared folders, table storage and range cuts that the operators of this package use."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []
_USED: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only where it is unset, and only in local mode (tests), a temporary folder stands in.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        folder = tempfile.mkdtemp(prefix="driftmark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _OWN.append("file://" + folder)
    return _OWN[0]


def home(spark: SparkSession) -> str:
    """The folder of this application below the shared one, removed when the process ends with its session still open."""
    sc = spark.sparkContext
    out = f"{shared_root(spark)}/driftmark/{sc.applicationId}"
    if out not in _USED:
        _USED.add(out)
        atexit.register(_clear, sc.applicationId, out)
    return out


def _clear(application: str, folder: str) -> None:
    sc = SparkContext._active_spark_context
    if sc is not None and sc._jsc is not None and sc.applicationId == application:
        p = sc._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def fresh(scope: str) -> str:
    """A scope that no other call uses."""
    return f"{scope}-{uuid.uuid4().hex[:12]}"


def scratch(spark: SparkSession, scope: str) -> str:
    """A new path of this application below the shared folder; release(scope) removes it."""
    return f"{home(spark)}/{scope}/{uuid.uuid4().hex}"


def files(uri: str):
    """(file system, path) of pyarrow for executors. It opens file, hdfs, s3 (also as s3a), gs and abfss paths."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("s3" + uri[3:] if uri.startswith("s3a:") else uri)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for driver-side renames and deletes."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def release(spark: SparkSession, scope: str) -> None:
    """Remove what a scope has stored; call it once nothing reads those tables any more."""
    fs, p = hadoop_path(spark, f"{home(spark)}/{scope}")
    fs.delete(p, True)


#: Metadata of a column that names the scope which a result reads.
_SCOPE = "driftmark.scope"


def owning(df: DataFrame, scope: str, column: str) -> DataFrame:
    """df, with the scope that it reads named in the column's metadata, which Parquet keeps."""
    return df.withMetadata(column, {**df.schema[column].metadata, _SCOPE: scope})


def release_source(df: DataFrame, column: str) -> None:
    """Remove the scope of the result that df was written from; nothing is removed where df itself still reads it."""
    scope = df.schema[column].metadata.get(_SCOPE)
    if scope:
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()
        plans = [leaves.apply(i) for i in range(leaves.size())]
        read = [p.relation().location().rootPaths().mkString() for p in plans if p.getClass().getSimpleName() == "LogicalRelation"]
        if not any(f"/{scope}/" in x for x in read):
            release(df.sparkSession, scope)


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns c0, c1, ..., so that no name clashes with those that an operator adds, and the new name of each old one."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))), names


def stored(df: DataFrame, scope: str) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage ends there."""
    path = scratch(df.sparkSession, scope)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def range_cuts(df: DataFrame, key: str, weight, target: float, most: int = 20_000) -> tuple[int, int, list[int]]:
    """Deterministic cut points that split a long key into ranges of about equal weight.

    Returns (shift, first bin, cuts); a row's range is the number of cuts that are <= its key.
    The driver sees at most 4097 bins, then 16 parts of each bin that is too heavy; the number of
    cuts is at most ``most``. Nulls and an empty table give no cuts.
    """
    low, high, total = df.agg(F.min(key), F.max(key), F.sum(weight)).first()
    if low is None or not total or total <= target:
        return 0, 0, []
    target = max(target, total / most)
    first = shift = max(0, (high - low).bit_length() - 12)
    at = lambda s: F.shiftright(F.col(key), s)
    leaves: list[tuple[int, float]] = []  # (first key after the leaf, weight)
    rows = df.where(F.col(key).isNotNull()).groupBy(at(shift).alias("b")).agg(F.sum(weight).alias("w")).collect()
    while rows:
        heavy = sorted(r["b"] for r in rows if r["w"] > target and shift)
        leaves += [((r["b"] + 1) << shift, r["w"]) for r in rows if not (r["w"] > target and shift)]
        if not heavy:
            break
        step = min(4, shift)
        bins = df.sparkSession.createDataFrame([(b,) for b in heavy], "hb long")
        below = df.where(F.col(key).isNotNull()).join(F.broadcast(bins), at(shift) == F.col("hb"), "left_semi")
        shift -= step
        rows = below.groupBy(at(shift).alias("b")).agg(F.sum(weight).alias("w")).collect()
    cuts, held = [], 0.0
    for end, w in sorted(leaves):
        if held and held + w > target:
            cuts.append(last)  # noqa: F821  bound by the turn before
            held = 0.0
        held, last = held + w, end  # noqa: F841
    return first, low >> first, cuts


def with_range(df: DataFrame, key: str, cuts: tuple[int, int, list[int]], out: str) -> DataFrame:
    """Add the range number of each row (nulls: 0). At most 4097 bins and the cuts are broadcast."""
    shift, base, points = cuts
    if not points:
        return df.withColumn(out, F.lit(0))
    by: dict[int, list[int]] = {}
    for p in points:
        by.setdefault(p >> shift, []).append(p)
    rows, done = [], 0
    top = max(points) >> shift
    for b in range(base, top + 1):
        rows.append((b, done, by.get(b, [])))
        done += len(by.get(b, []))
    bins = df.sparkSession.createDataFrame(rows, "dm_bin long, dm_done int, dm_points array<long>")
    found = df.join(F.broadcast(bins), F.shiftright(F.col(key), shift) == F.col("dm_bin"), "left")
    inside = F.size(F.filter("dm_points", lambda p: p <= F.col(key)))
    number = F.when(F.col(key).isNull(), 0).when(F.col("dm_bin").isNull(), len(points)).otherwise(F.col("dm_done") + inside)
    return found.withColumn(out, number.cast("int")).drop("dm_bin", "dm_done", "dm_points")
