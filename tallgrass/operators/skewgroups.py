"""Per-key figures when a handful of keys hold most rows.

Rows are first combined into distinct (key, order, value) rows with a count, map-side. They are
then range-partitioned on the composite key *and* a secondary order, with bounds Spark takes from
sampled quantiles, so a heavy key is spread over as many partitions as its share asks for. Each
partition folds its sorted rows into one partial state per key; the states of a key that was cut
at partition bounds are stitched in partition order. Work per task follows the row count, not the
key sizes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgrass.plans.staging import stage

STATE = ("__rows", "__runs", "__first", "__last", "__sum", "__valued", "__min", "__max", "__latest")


def _fold(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Partial states of one sorted partition; a key open at the end of a batch is carried on."""
    open_key: tuple | None = None
    state: dict = {}
    index = 0

    def close() -> pd.DataFrame:
        return pd.DataFrame([dict(zip(keys, open_key)) | state])

    for batch in batches:
        if not len(batch):
            continue
        part = batch["__part"].iloc[0]
        change = np.zeros(len(batch), dtype=bool)
        change[0] = True
        for k in keys:
            col = batch[k].to_numpy(dtype=object)
            before, now = pd.isna(col[:-1]), pd.isna(col[1:])
            change[1:] |= (before != now) | (~before & ~now & (col[1:] != col[:-1]))
        starts = np.flatnonzero(change)
        order = batch["__order"].to_numpy(dtype=object)
        counts = batch["__n"].to_numpy(dtype=np.int64)
        times = batch["__times"].to_numpy(dtype=np.int64)
        value = batch["__value"].to_numpy(dtype=np.float64)
        latest = batch["__when"].to_numpy(dtype="datetime64[us]")
        new_run = change.copy()
        new_run[1:] |= order[1:] != order[:-1]
        new_run &= ~pd.isna(order)
        for start, end in zip(starts, np.append(starts[1:], len(batch))):
            key = tuple(None if pd.isna(x) else x for x in (batch[k].iloc[start] for k in keys))
            span = slice(start, end)
            known = ~np.isnan(value[span])
            when = latest[span]
            when = when[~np.isnat(when)]
            named = order[span][~pd.isna(order[span])]
            first, last = (named[0], named[-1]) if len(named) else (None, None)
            runs = int(new_run[span].sum())
            got = {
                "__rows": int(counts[span].sum()),
                "__runs": runs,
                "__first": first,
                "__last": last,
                "__sum": float((value[span][known] * times[span][known]).sum()),
                "__valued": int(times[span][known].sum()),
                "__min": float(value[span][known].min()) if known.any() else None,
                "__max": float(value[span][known].max()) if known.any() else None,
                "__latest": pd.Timestamp(when.max()) if len(when) else None,
            }
            if key == open_key:
                if first is not None and first == state["__last"]:
                    got["__runs"] -= 1
                state = _merge(state, got)
            else:
                if open_key is not None:
                    yield close()
                    index += 1
                open_key, state = key, got | {"__part": int(part), "__index": index}
    if open_key is not None:
        yield close()


def _merge(a: dict, b: dict) -> dict:
    pick = lambda f, x, y: y if x is None else x if y is None else f(x, y)
    return a | {
        "__rows": a["__rows"] + b["__rows"],
        "__runs": a["__runs"] + b["__runs"],
        "__first": a["__first"] if a["__first"] is not None else b["__first"],
        "__last": b["__last"] if b["__last"] is not None else a["__last"],
        "__sum": a["__sum"] + b["__sum"],
        "__valued": a["__valued"] + b["__valued"],
        "__min": pick(min, a["__min"], b["__min"]),
        "__max": pick(max, a["__max"], b["__max"]),
        "__latest": pick(max, a["__latest"], b["__latest"]),
    }


def figures_by_key(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    when: str,
    partitions: int | None = None,
    rows: str | None = None,
) -> DataFrame:
    """One row per combination of ``keys`` (string columns), whatever its size.

    ``rows`` names a number of rows that an input row stands for in ``n_rows`` and ``row_share``, where copies
    were combined before; its value counts once all the same.

    Columns: the keys, ``n_rows``, ``n_items`` (distinct non-null ``order``), ``value_sum``,
    ``n_valued``, ``value_min``, ``value_max``, ``latest`` (largest ``when``), ``row_share``
    (of all rows) and ``n_parts`` (range partitions the key was spread over).

    Defined cases: null keys form their own combination; null ``order`` counts as a row but not an
    item; null ``value`` and ``when`` are ignored; repeated rows count in ``n_rows`` each; an empty
    input gives no rows; columns not named are not read, whatever they are called.
    """
    keys = list(keys)
    slim = df.select(
        *[F.col(k).cast("string").alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col(order).cast("string").alias("__order"),
        F.col(value).cast("double").alias("__value"),
        F.col(when).cast("timestamp_ntz").alias("__when"),
        (F.col(rows).cast("bigint") if rows else F.lit(1).cast("bigint")).alias("__n"),
    )
    inner = [f"__k{i}" for i in range(len(keys))]
    distinct = slim.groupBy(*inner, "__order", "__value", "__when").agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__n"), F.count(F.lit(1)).alias("__times"))
    by = [*inner, "__order", "__value", "__when"]
    ranged = distinct.repartitionByRange(partitions, *by) if partitions else distinct.repartitionByRange(*by)
    sorted_rows = ranged.withColumn("__part", F.spark_partition_id()).sortWithinPartitions(*by)
    schema = T.StructType(
        [T.StructField(k, T.StringType()) for k in inner]
        + [
            T.StructField("__rows", T.LongType()),
            T.StructField("__runs", T.LongType()),
            T.StructField("__first", T.StringType()),
            T.StructField("__last", T.StringType()),
            T.StructField("__sum", T.DoubleType()),
            T.StructField("__valued", T.LongType()),
            T.StructField("__min", T.DoubleType()),
            T.StructField("__max", T.DoubleType()),
            T.StructField("__latest", T.TimestampNTZType()),
            T.StructField("__part", T.IntegerType()),
            T.StructField("__index", T.IntegerType()),
        ]
    )
    names = [f.name for f in schema.fields]
    # A few rows per partition and key; staged, as both the total and the stitching read them.
    states = stage(sorted_rows.mapInPandas(lambda it: (s[names] for s in _fold(it, inner)), schema), "range-states")
    # Stitching sees one row per key and partition. A run cut by a bound was counted on both sides.
    along = Window.partitionBy(*inner).orderBy("__part")
    cut = F.when(F.col("__first") == F.last("__last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)), 1).otherwise(0)
    stitched = (
        states.withColumn("__cut", cut)
        .groupBy(*inner)
        .agg(
            F.sum("__rows").alias("n_rows"),
            (F.sum("__runs") - F.sum("__cut")).alias("n_items"),
            F.sum("__sum").alias("value_sum"),
            F.sum("__valued").alias("n_valued"),
            F.min("__min").alias("value_min"),
            F.max("__max").alias("value_max"),
            F.max("__latest").alias("latest"),
            F.count(F.lit(1)).alias("n_parts"),
        )
    )
    total = states.agg(F.sum("__rows")).first()[0] or 0
    return stitched.select(
        *[F.col(i).alias(k) for i, k in zip(inner, keys)],
        "n_rows", "n_items", "value_sum", "n_valued", "value_min", "value_max", "latest", "n_parts",
        (F.col("n_rows") / F.lit(float(total))).alias("row_share"),
    )
