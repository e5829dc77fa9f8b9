"""Profiles of a table's columns by scans, for tables whose value counts aren't maintained."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.plans.staging import release, stage

CATEGORIES = 50


def _melt(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").cast("string").alias("value")) for f in fields])
    return df.select(F.inline(cells))


def counts(df: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """(field_name, value, n): one scan, combined before the shuffle."""
    return _melt(df, list(fields or df.columns)).groupBy("field_name", "value").agg(F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame, fields: Sequence[str] | None = None, categories: int = CATEGORIES) -> DataFrame:
    """A row per field: rows, populated (not null), populated_pct, distinct_count, lengths, type_hint.

    type_hint is key (all rows populated and distinct), constant, categorical (at most ``categories``
    values), numeric_text (digits only) or free_text, the first that fits. An empty table gives rows of 0.
    """
    named = list(fields or df.columns)
    n, v = F.col("n"), F.col("value")
    got = counts(df, named).groupBy("field_name").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(v.isNotNull(), n)), F.lit(0)).alias("populated_count"),
        F.count(v).alias("distinct_count"),
        F.coalesce(F.min(F.length(v)), F.lit(0)).alias("min_length"),
        F.coalesce(F.max(F.length(v)), F.lit(0)).alias("max_length"),
        F.coalesce(F.min(v.rlike(r"(?U)^\d+$").cast("int")), F.lit(0)).alias("__digits"),
    )
    names = df.sparkSession.createDataFrame([(f,) for f in named], "field_name string")
    pct = F.when(F.col("n_rows") > 0, F.round(100.0 * F.col("populated_count") / F.col("n_rows"), 2)).otherwise(0.0)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    full = names.join(got, "field_name", "left").select("field_name", *[zero(c) for c in ("n_rows", "populated_count", "distinct_count", "min_length", "max_length", "__digits")])
    d = F.col("distinct_count")
    hint = (
        F.when((d == F.col("n_rows")) & (F.col("populated_count") == F.col("n_rows")) & (F.col("n_rows") > 0), "key")
        .when(d <= 1, "constant").when(d <= categories, "categorical").when(F.col("__digits") == 1, "numeric_text").otherwise("free_text")
    )
    return full.withColumns({"populated_pct": pct, "type_hint": hint}).drop("__digits")


def top_values(df: DataFrame, fields: Sequence[str] | None = None, n: int = 20) -> DataFrame:
    """(field_name, place, value, n): the most frequent values of each field, ties by value."""
    place = F.row_number().over(Window.partitionBy("field_name").orderBy(F.desc("n"), "value"))
    return counts(df, fields).where(F.col("value").isNotNull()).withColumn("place", place).where(F.col("place") <= n)


def inferred_domains(df: DataFrame, fields: Sequence[str] | None = None, categories: int = CATEGORIES) -> DataFrame:
    """(field_name, domain): the sorted values of fields with at most ``categories`` of them."""
    kept = counts(df, fields).where(F.col("value").isNotNull())
    few = kept.groupBy("field_name").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= categories).select("field_name")
    return kept.join(F.broadcast(few), "field_name").groupBy("field_name").agg(F.array_sort(F.collect_set("value")).alias("domain"))  # bounded by `categories`


def samples(df: DataFrame, fields: Sequence[str] | None = None, n: int = 5) -> DataFrame:
    """(field_name, samples): the ``n`` smallest values, as row order means nothing here."""
    place = F.row_number().over(Window.partitionBy("field_name").orderBy("value"))
    few = counts(df, fields).where(F.col("value").isNotNull()).withColumn("place", place).where(F.col("place") <= n)
    return few.groupBy("field_name").agg(F.array_sort(F.collect_list("value")).alias("samples"))


def key_uniqueness(df: DataFrame, keys: Sequence[str], n_examples: int = 5) -> DataFrame:
    """One row: rows, distinct_keys (null is a value), rows_sharing_a_key, is_unique, assessable, examples."""
    if not keys or not set(keys) <= set(df.columns):
        return df.sparkSession.createDataFrame([(None, None, None, None, False, [])], "n_rows long, distinct_keys long, rows_sharing_a_key long, is_unique boolean, assessable boolean, examples array<string>")
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    shown = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("None"))) for k in keys])
    firsts = groups.where("n > 1").select(shown.alias("s")).orderBy("s").limit(n_examples).agg(F.array_sort(F.collect_list("s")).alias("examples"))
    facts = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("distinct_keys"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_sharing_a_key"),
    )
    return facts.withColumn("__one", F.lit(1)).join(F.broadcast(firsts.withColumn("__one", F.lit(1))), "__one").select("n_rows", "distinct_keys", "rows_sharing_a_key", (F.col("rows_sharing_a_key") == 0).alias("is_unique"), F.lit(True).alias("assessable"), "examples")


def key_candidates(df: DataFrame, fields: Sequence[str] | None = None, arity: int = 3, most_fields: int = 8, lg_k: int = 12) -> list[tuple[str, ...]]:
    """Minimal sets of up to ``arity`` of the first ``most_fields`` fully populated, varying fields that tell all rows apart.

    All sets of one arity are estimated by sketches in one pass, without a row more than the table has; only
    those whose estimate comes near the number of rows (within six times the error of a sketch of 2^``lg_k`` registers) are tested
    exactly, on the rows that repeat a value of their most varied field. Sets that contain a found key are not tested.
    """
    facts = {r["field_name"]: r for r in profile(df, fields).collect()}  # a row per field
    usable = [f for f in (fields or df.columns) if facts[f]["populated_count"] == facts[f]["n_rows"] > 0 and facts[f]["distinct_count"] > 1][:most_fields]
    found: list[tuple[str, ...]] = [(f,) for f in usable if facts[f]["distinct_count"] == facts[f]["n_rows"]]
    repeats: dict[str, DataFrame] = {}

    def rows_that_matter(c: tuple[str, ...]) -> DataFrame:
        """The rows whose value of the set's most varied field occurs again: only they can agree in all fields."""
        f = max(c, key=lambda x: facts[x]["distinct_count"])
        if f not in repeats:
            again = df.groupBy(f).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(f)
            repeats[f] = stage(df.select(*usable).join(again, f, "left_semi"), "repeated-values")
        return repeats[f]

    for k in range(2, arity + 1):
        trial = [c for c in combinations(usable, k) if not any(set(f) <= set(c) for f in found)]
        if not trial:
            continue
        n = facts[usable[0]]["n_rows"]
        about = df.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(*c), lg_k)).alias(f"k{i}") for i, c in enumerate(trial)]).first()
        near = [c for i, c in enumerate(trial) if about[f"k{i}"] >= (1 - 6 * 1.04 / 2 ** (lg_k / 2)) * n]
        found += [c for c in near if rows_that_matter(c).groupBy(*c).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").isEmpty()]
    release(*repeats.values())
    return found
