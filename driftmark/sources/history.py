"""Entity history tables: (osm_type, osm_id, version, ts, visible, tags, lat, lon, refs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "osm_type string, osm_id long, version int, ts timestamp, visible boolean, tags map<string,string>, lat double, lon double, refs array<long>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet history, or JSON lines by their ending."""
    return spark.read.schema(SCHEMA).json(path) if path.endswith((".json", ".jsonl")) else spark.read.schema(SCHEMA).parquet(path)
