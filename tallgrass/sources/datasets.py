"""Datasets of several tables in a folder, their side files, and report sinks."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, tables: Iterable[str], kind: str = "parquet") -> dict[str, DataFrame]:
    """Frames by table name. ``kind`` is parquet, csv (with header, all text, '' is null), json or xlsx."""
    readers = {
        "parquet": lambda p: spark.read.parquet(p),
        "csv": lambda p: spark.read.option("header", True).option("inferSchema", False).csv(p),
        "json": lambda p: spark.read.option("primitivesAsString", True).json(p),
        "xlsx": lambda p: spark.read.format("sheet").load(p),
    }
    if kind not in readers:
        raise ValueError(f"unknown kind {kind!r}")
    if kind == "xlsx":
        from tallgrass.sources.sheets import SheetSource

        spark.dataSource.register(SheetSource)
    return {t: readers[kind](f"{folder}/{t}.{kind}") for t in tables}


def discover(spark: SparkSession, root: str, marker: str = "mara.parquet") -> list[str]:
    """Folders below ``root``, on any file system Spark reads, that hold ``marker``, sorted."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/*/{marker}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(str(x.getPath().getParent().toString()).removeprefix("file:") for x in found)


def save(tables: Mapping[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{folder}/{name}.parquet")


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth; empty entries of the map ``detail`` are dropped."""
    df = spark.read.parquet(path)
    return df.withColumn("detail", F.map_filter("detail", lambda k, v: v.isNotNull())) if "detail" in df.columns else df


def load_decoys(spark: SparkSession, path: str) -> DataFrame:
    """Pairs that must not match; no rows if the file doesn't exist."""
    schema = "kind string, left_id string, right_id string"
    return spark.read.schema(schema).json(path, multiLine=True) if Path(path).exists() else spark.createDataFrame([], schema)


def save_findings(findings: DataFrame, folder: str, kind: str = "json") -> None:
    """Findings as JSON lines, or as CSV with lists and maps written as JSON."""
    if kind == "csv":
        flat = findings.withColumns({c: F.to_json(c) for c, t in findings.dtypes if t.startswith(("array", "map", "struct"))})
        flat.write.option("header", True).csv(folder)
    else:
        findings.write.json(folder)


def save_vectors(vectors: DataFrame, folder: str, identity: str, content: str) -> None:
    """(key, vector) with the two codes that say what they were made from."""
    vectors.withColumns({"identity_code": F.lit(identity), "content_code": F.lit(content)}).write.parquet(folder)


def load_vectors(spark: SparkSession, folder: str, identity: str, content: str) -> DataFrame | None:
    """Vectors if they were made by the same encoder from the same texts; else None."""
    df = spark.read.parquet(folder)
    codes = df.select("identity_code", "content_code").limit(1).collect()
    return df.drop("identity_code", "content_code") if [tuple(c) for c in codes] == [(identity, content)] else None


def save_json(df: DataFrame, path: str, most_rows: int = 10_000) -> None:
    """A short table (decoys, a manifest, a report) as one JSON list; more than ``most_rows`` rows are an error."""
    rows = [r.asDict(recursive=True) for r in df.limit(most_rows + 1).collect()]
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows; write a table instead")
    Path(path).write_text(json.dumps(rows, indent=2, default=str))
