"""Joining a large, possibly skewed side to a side with one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: A key is heavy if it holds more than one in HEAVY_SHARE rows, so there are fewer than HEAVY_SHARE heavy keys.
HEAVY_SHARE = 2_000
#: Rows up to which a side is broadcast after its size was counted.
BROADCAST_ROWS = 50_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if counting at most ``max_rows + 1`` rows shows that ``df`` is small."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def heavy_keys(df: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """Keys holding more than 1/HEAVY_SHARE of all rows: under HEAVY_SHARE rows whatever the input."""
    total = df.count() if total is None else total
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return counts.where(F.col("__n") > total / HEAVY_SHARE).select(key)


def lookup(big: DataFrame, small: DataFrame, key: str, heavy: DataFrame | list[Row] | None = None, how: str = "inner") -> DataFrame:
    """Join ``big`` to ``small`` (unique on ``key``), inner or left, without a task per hot key.

    Rows of heavy keys meet a broadcast copy of the few rows of ``small`` they need; all other keys hold at
    most 1/HEAVY_SHARE of the rows each and are joined by shuffle. ``heavy``, if known, has the heavy keys, as a
    frame or collected: fewer than ``2 * HEAVY_SHARE``, by construction, which is checked. Null keys match nothing.
    """
    if heavy is None:
        heavy = heavy_keys(big, key)
    keys = heavy.select(key).limit(2 * HEAVY_SHARE).collect() if isinstance(heavy, DataFrame) else heavy
    if len(keys) >= 2 * HEAVY_SHARE:
        raise ValueError(f"more than {2 * HEAVY_SHARE} heavy keys")
    if not keys:
        return big.join(small, key, how)
    few = F.broadcast(big.sparkSession.createDataFrame(keys, big.select(key).schema))
    hot = F.broadcast(small.join(few, key, "left_semi"))
    cold = big.join(few, key, "left_anti")
    return cold.join(small, key, how).unionByName(big.join(few, key, "left_semi").join(hot, key, how))
