"""Readers and writers: CSV with a byte order mark, JSON lines, receipts, JSON and Markdown.

Tables are read all-string with missing values as "". Single files with a byte order mark are for
people and other tools; between stages use write_table().
"""

from __future__ import annotations

import json
import shutil
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.functions import literals
from driftmark.operators import contracts

BOM = b"\xef\xbb\xbf"


def read_csv(spark: SparkSession, path: str, required=(), ordered: bool = False) -> DataFrame:
    """An all-string CSV table with a header; quoted fields may span lines."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', nullValue="\u0000", encoding="UTF-8")
    df = df.toDF(*[c.removeprefix("\ufeff") for c in df.columns])
    contracts.require_columns(df, required, ordered, path)
    return df.fillna("")


def has_bom(path: str | Path) -> bool:
    """Whether a local file begins with a UTF-8 byte order mark."""
    with open(path, "rb") as f:
        return f.read(3) == BOM


def _spelled(c: str, kind: str) -> Column:
    """A value as a CSV field, quoted where it has to be."""
    text = F.coalesce(F.initcap(F.col(f"`{c}`").cast("string")) if kind == "boolean" else F.col(f"`{c}`").cast("string"), F.lit(""))
    return F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def merged(lines: DataFrame, target: Path, head: bytes = b"") -> None:
    """One file of the lines (one text column): executors write parts, whose bytes are put together in the order of the rows.

    The file appears under its name when it is whole. No row comes to the driver. The folder is one that all executors share.
    """
    target.parent.mkdir(parents=True, exist_ok=True)
    parts, whole = target.with_name(f".{target.name}.parts"), target.with_name(f".{target.name}.part")
    lines.write.mode("overwrite").option("compression", "none").text(str(parts))
    with open(whole, "wb") as out:
        out.write(head)
        for p in sorted(parts.glob("part-*")):
            with open(p, "rb") as f:
                shutil.copyfileobj(f, out, 1 << 20)
    whole.replace(target)
    shutil.rmtree(parts)


def write_csv(df: DataFrame, path: str | Path, overwrite: bool = False) -> None:
    """One CSV file with a byte order mark and no index."""
    target = guard(path, overwrite)
    line = F.concat_ws(",", *[_spelled(c, kind) for c, kind in df.dtypes])
    if len(df.columns) == 1:  # an empty line would be no row
        line = F.when(line == "", '""').otherwise(line)
    names = ",".join('"' + c.replace('"', '""') + '"' if set(c) & set('",\n\r') else c for c in df.columns)
    merged(df.select(line.alias("value")), target, BOM + names.encode() + b"\n")


def guard(path: str | Path, overwrite: bool = False) -> Path:
    """The path, unless it exists and must not be overwritten."""
    path = Path(path)
    if path.exists() and not overwrite:
        raise FileExistsError(path)
    return path


def write_table(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """A Parquet table, written once."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines with a schema; without one, the parsed lines as variants (column value)."""
    if schema:
        return spark.read.schema(schema).json(path)
    return spark.read.text(path).where("value <> ''").select(F.parse_json("value").alias("value"))


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path, ignoreNullFields=False)


def write_json_lines(df: DataFrame, path: str | Path, overwrite: bool = False) -> None:
    """One file of JSON lines; write_jsonl() writes a folder."""
    merged(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")), guard(path, overwrite))


def read_receipts(spark: SparkSession, path: str, key: str = "Địa chỉ", column: str = "extractions") -> DataFrame:
    """(text): one field of receipt extractions, which are maps, structs, JSON or Python literals. Only that column is read."""
    df = spark.read.parquet(path).select(column)
    kind = df.schema[column].dataType.typeName()
    if kind in ("struct", "map"):
        return df.select(F.col(column)[key].alias("text")).where("text is not null")
    return literal_field(df, column, key).where("text is not null")


def literal_field(df: DataFrame, column: str, key: str) -> DataFrame:
    """(text): a field of dictionaries written as Python literals; what cannot be read is null."""
    return df.select(literals.value_of(column, key).alias("text"))


def read_addresses(spark: SparkSession, parquet: str | None, csv: str, column: str = "ChuoiDiaChi") -> DataFrame:
    """(text): receipts, or where there are none a CSV table's named column, else its first one."""
    if parquet and Path(parquet).exists():
        return read_receipts(spark, parquet)
    df = read_csv(spark, csv)
    return df.select(F.col(f"`{column if column in df.columns else df.columns[0]}`").alias("text")).where("text <> ''")


def read_json(path: str | Path) -> dict:
    """A JSON configuration."""
    return json.loads(Path(path).read_text(encoding="utf-8"))


def write_json(value: dict, path: str | Path, overwrite: bool = True) -> None:
    target = guard(path, overwrite)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(value, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
