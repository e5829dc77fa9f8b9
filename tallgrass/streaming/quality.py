"""Findings on streams. Rules are stateless, so the batch compiler's output runs unchanged in append mode."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.operators.compile import violated
from tallgrass.operators.ir import Rule
from tallgrass.operators.rules import run_rules


def stream_findings(stream: DataFrame, table: str, keys: Sequence[str], rules: Iterable[Rule]) -> DataFrame:
    """Findings of an unbounded table; rows are judged as they arrive."""
    return run_rules(stream, table, keys, rules)


def windowed_quality(stream: DataFrame, time: str, rules: Sequence[Rule], window: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """(start, end, n_rows, n_broken, score) per window of event time; rows later than ``late`` behind are left out."""
    broken = F.lit(False)
    for r in rules:
        broken = broken | violated(r.assertion, r.scope, stream.schema)
    span = F.window(F.col(time), window, slide) if slide else F.window(F.col(time), window)
    got = stream.withColumn("__broken", broken).withWatermark(time, late).groupBy(span.alias("w")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("__broken").alias("n_broken"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_rows", "n_broken", (100 * (1 - F.col("n_broken") / F.col("n_rows"))).alias("score"))


def first_deliveries(stream: DataFrame, keys: Sequence[str], time: str, late: str = "2 hours") -> DataFrame:
    """Rows whose key wasn't seen within ``late``; the state is dropped as the watermark passes."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
