"""Membership of values in reference lists, plain or scoped."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.plans.lookup import broadcast_if_small


def plain(value: Column) -> Column:
    """The form in which reference values are compared: trimmed, upper case, '' for null."""
    return F.upper(F.trim(F.coalesce(value.cast("string"), F.lit(""))))


def entries(df: DataFrame, table: str, value: str, scope: str | None = None) -> DataFrame:
    """(table_name, scope_key, value): the distinct non-empty values of a list."""
    key = plain(F.col(scope)) if scope else F.lit("")
    return df.select(F.lit(table).alias("table_name"), key.alias("scope_key"), plain(F.col(value)).alias("value")).where("value <> ''").distinct()


def mark_members(df: DataFrame, listed: DataFrame, value: str, scope: Column | None = None, loaded: bool = True, into: str = "is_member") -> DataFrame:
    """``df`` with ``into``: whether the value is listed (within its scope); null where the list isn't loaded or the value is empty."""
    if not loaded:
        return df.withColumn(into, F.lit(None).cast("boolean"))
    marked = df.withColumn("__value", plain(F.col(value))).withColumn("__scope", plain(scope) if scope is not None else F.lit(""))
    known = broadcast_if_small(listed.select(F.col("scope_key").alias("__scope"), F.col("value").alias("__value"), F.lit(True).alias("__hit")).distinct())
    joined = marked.join(known, ["__scope", "__value"], "left")
    return joined.withColumn(into, F.when(F.col("__value") != "", F.coalesce("__hit", F.lit(False)))).drop("__value", "__scope", "__hit")


def match_rate(df: DataFrame, listed: DataFrame, value: str, scope: Column | None = None, loaded: bool = True) -> DataFrame:
    """(n_values, n_matched, match_rate): over non-empty values; rate 0 for none, null where the list isn't loaded."""
    got = mark_members(df, listed, value, scope, loaded)
    n, hit = F.count_if(plain(F.col(value)) != ""), F.count_if(F.col("is_member"))
    rate = F.when(n > 0, hit / n).otherwise(0.0) if loaded else F.lit(None).cast("double")
    return got.agg(n.alias("n_values"), hit.alias("n_matched"), rate.alias("match_rate"))


def permitted(listed: DataFrame, scoped: bool = False) -> DataFrame:
    """The sorted list of values, per scope if ``scoped``. One list is one reference table's entries, not data."""
    by = ["table_name", "scope_key"] if scoped else ["table_name"]
    return listed.groupBy(*by).agg(F.array_sort(F.collect_set("value")).alias("permitted"), F.countDistinct("value").alias("n_permitted"))


def load_manifest(path: str | Path) -> list[dict[str, Any]]:
    """The lists that a YAML manifest names (name, file, value_field, scope_field, status, as_of); a list of lists, not data."""
    import yaml

    got = yaml.safe_load(Path(path).read_text()) or {}
    return list(got.get("tables", [])) if isinstance(got, dict) else []


def load_store(spark: SparkSession, lists: Iterable[Mapping[str, Any]], read: Callable[[str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(entries, manifest): the values of all lists that are loaded, and a row per list.

    ``read`` gives the frame of a list's file. A list that is not extracted yet, or whose file isn't there,
    is pending: it is named in the manifest and has no entries, so membership in it is unknown.
    """
    found, rows = None, []
    for one in lists:
        status, df = one.get("status", "pending_extract"), None
        if status == "loaded" and one.get("file"):
            try:
                df = read(one["file"])
            except Exception as e:  # an absent file makes a list pending
                if not isinstance(e, FileNotFoundError) and "PATH_NOT_FOUND" not in str(e):
                    raise
        if df is not None:
            part = entries(df, one["name"], one["value_field"], one.get("scope_field"))
            found = part if found is None else found.unionByName(part)
        rows.append((one["name"], "loaded" if df is not None else "pending_extract", one.get("as_of"), one.get("scope_field")))
    none = spark.createDataFrame([], "table_name string, scope_key string, value string")
    return none if found is None else found, spark.createDataFrame(rows, "table_name string, status string, as_of string, scope_field string")


def pending(manifest: DataFrame) -> DataFrame:
    """Lists that the manifest names but that aren't extracted yet, or that state no date."""
    return manifest.where((F.col("status") == "pending_extract") | F.col("as_of").isNull()).select("table_name", "status", F.col("as_of").isNull().alias("lacks_date"))
