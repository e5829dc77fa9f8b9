"""Packing texts into containers of a fixed number of tokens, by tiers of context sizes.

Every text that fits into a container stays whole; a longer one is cut into full containers and a rest.
Lengths are routed to tiers (the capacity, half of it, a quarter, ...). Tier by tier, from the longest, the
texts of a tier are packed among themselves and the gaps of these long windows are filled from the shorter
tiers, the next one first. Since only lengths matter, this is decided on the histogram of lengths, which has
at most ``capacity`` entries however many texts there are; equal containers are decided once, as a pattern
with a count. Texts then find their slot by their rank within their length, a distributed computation.
Containers are numbered by how full they are and dealt to step groups forth and back, which balances the
groups' tokens.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgrass.llm.tokens import token_count
from tallgrass.plans.staging import release, stage


#: Lengths that are planned on the driver, at most.
MAX_CAPACITY = 1 << 20


@dataclass
class Pattern:
    """``count`` containers, from number ``first``, opened in ``tier``, each holding ``slots``: (length, how many)."""

    first: int
    count: int
    slots: list[tuple[int, int]]
    tier: int = 0

    @property
    def filled(self) -> int:
        return sum(n * k for n, k in self.slots)


@dataclass
class Plan:
    capacity: int
    patterns: list[Pattern] = field(default_factory=list)

    @property
    def containers(self) -> int:
        return sum(p.count for p in self.patterns)

    @property
    def filled(self) -> int:
        return sum(p.count * p.filled for p in self.patterns)


def tiers(capacity: int) -> list[int]:
    """The context sizes: capacity, capacity/2, capacity/4, ... down to 1."""
    return [capacity >> k for k in range(capacity.bit_length())]


def tier_of(length: int, capacity: int) -> int:
    """The smallest tier that holds ``length``."""
    return min(t for t in tiers(capacity) if t >= length)


class Shelf:
    """The lengths of one tier that are left, in ascending order."""

    def __init__(self, lengths: list[int]):
        self.lengths = sorted(lengths)

    def take(self, gap: int, left: dict[int, int], slots: dict[int, int]) -> int:
        """Add to ``slots`` the longest that fit into ``gap``, each as often as it fits; what is left of the gap."""
        i = bisect_right(self.lengths, gap) - 1
        while i >= 0 and gap:
            n = self.lengths[i]
            if k := min(gap // n, left[n] - slots.get(n, 0)):
                slots[n] = slots.get(n, 0) + k
                gap -= n * k
            i = min(i - 1, bisect_right(self.lengths, gap) - 1)
        return gap


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Patterns of containers for ``histogram`` (length: how many), tier by tier from the longest.

    Each step opens as many equal containers as its lengths allow and uses one of them up, so there are at
    most as many patterns as there are uses of a length. The numbers of containers follow their fill.
    """
    if not 0 < capacity <= MAX_CAPACITY:
        raise ValueError(f"the capacity must lie between 1 and {MAX_CAPACITY}")
    left = {n: c for n, c in histogram.items() if c > 0 and 0 < n <= capacity}
    routed: dict[int, list[int]] = {t: [] for t in tiers(capacity)}
    for n in left:
        routed[tier_of(n, capacity)].append(n)
    shelves = {t: Shelf(lengths) for t, lengths in routed.items()}
    out = Plan(capacity)
    for tier, own in shelves.items():
        while own.lengths:
            slots: dict[int, int] = {}
            gap = own.take(capacity, left, slots)  # the tier among itself
            for shorter in (t for t in shelves if t < tier):  # the gap of the long window
                gap = shelves[shorter].take(gap, left, slots)
            count = min(left[n] // k for n, k in slots.items())
            out.patterns.append(Pattern(0, count, sorted(slots.items(), reverse=True), tier))
            for n, k in slots.items():
                left[n] -= k * count
                if not left[n]:
                    shelves[tier_of(n, capacity)].lengths.remove(n)
    out.patterns.sort(key=lambda p: -p.filled)
    made = 0
    for p in out.patterns:
        p.first, made = made, made + p.count
    return out


def _slot_table(p: Plan) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: the first rank, first container, texts a container, offset in it and tier, of each pattern in turn."""
    table: dict[int, list[tuple[int, ...]]] = {}
    seen: dict[int, int] = {}
    for pattern in p.patterns:
        offset = 0
        for n, k in pattern.slots:
            start = seen.get(n, 0)
            table.setdefault(n, []).append((start, pattern.first, k, offset, pattern.tier))
            seen[n] = start + k * pattern.count
            offset += n * k
    return {n: tuple(np.array(c, dtype=np.int64) for c in zip(*rows)) for n, rows in table.items()}


def pack(
    texts: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    capacity: int = 1_024,
    group_size: int = 64,
    rows_per_rank: int = 100_000,
) -> DataFrame:
    """(id, tokens, piece, piece_tokens, tier, container, container_tier, start, step_group, oversize), a row per piece.

    ``oversize`` marks texts that cannot fit; only these have more than one piece. ``tier`` is where the
    piece was routed to, ``container_tier`` the tier whose packing opened its container. Each container is a
    number from 0, the fullest first; ``start`` is the piece's first token in it. Containers are dealt to step
    groups of about ``group_size``, forth and back, so the groups' sums of tokens are no further apart than
    two containers.

    Defined cases: null and blank texts have no tokens, one piece of 0 tokens and null container, start
    and group; repeated ids with equal text are packed as often as they occur; an empty table gives no
    rows; columns not named are not read.
    """
    spark = texts.sparkSession
    counted = stage(
        texts.select(F.col(id).alias("id"), token_count(F.col(text)).cast("int").alias("tokens"), F.xxhash64(F.col(id), F.col(text)).alias("salt")),
        "lengths",
    )
    numbered = counted.withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("tokens") / capacity)).cast("int"))
    pieces = numbered.select("id", "tokens", "salt", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")).withColumn(
        "length", F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * capacity)
    )
    n = counted.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("tokens") / capacity)))).first()[0] or 0
    shares = max(1, -(-int(n) // rows_per_rank))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("salt", "piece"), F.lit(shares)).cast("int"))
    # At most capacity x shares rows; the driver gets one row per length.
    sizes = salted.where("length > 0").groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    sizes = stage(sizes, "length-counts")
    histogram = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("n")).collect()}
    made = plan(histogram, capacity)
    table = _slot_table(made)
    groups = max(1, -(-made.containers // group_size))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).select("length", "salt", "before")
    # A hot length is ranked in shares of about rows_per_rank rows each.
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece")) - 1
    ranked = salted.withColumn("within", within).join(before, ["length", "salt"], "left").withColumn("rank", F.col("before") + F.col("within"))

    @F.pandas_udf(T.StructType([T.StructField("container", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("tier", T.IntegerType())]))
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        container, start, tier = (pd.array([None] * len(length), dtype=t) for t in ("Int64", "Int32", "Int32"))
        values, ranks = length.to_numpy(), rank.to_numpy(dtype=np.float64)
        for value in np.unique(values):
            if value not in table:
                continue
            at = np.flatnonzero(values == value)
            starts, first, per, offset, opened = table[value]
            r = ranks[at].astype(np.int64)
            k = np.searchsorted(starts, r, side="right") - 1
            along = r - starts[k]
            container[at] = first[k] + along // per[k]
            start[at] = (offset[k] + along % per[k] * value).astype(np.int32)
            tier[at] = opened[k].astype(np.int32)
        return pd.DataFrame({"container": container, "start": start, "tier": tier})

    routed = F.lit(None).cast("int")
    for size in tiers(capacity):
        routed = F.when((F.col("length") > 0) & (F.col("length") <= size), size).otherwise(routed)
    lap, seat = F.floor(F.col("at.container") / groups), F.pmod(F.col("at.container"), F.lit(groups))
    placed = ranked.withColumn("at", place("length", "rank")).select(
        F.col("id").alias(id), "tokens", "piece", F.col("length").alias("piece_tokens"), routed.alias("tier"),
        "at.container", F.col("at.tier").alias("container_tier"), "at.start",
        F.when(lap % 2 == 0, seat).otherwise(groups - 1 - seat).alias("step_group"),
        (F.col("tokens") > capacity).alias("oversize"),
    )
    out = stage(placed, "packed")
    release(counted, sizes)
    return out


def fill_report(packed: DataFrame, capacity: int = 1_024) -> DataFrame:
    """One row: pieces, containers, tokens, share of the containers filled, the least number of containers
    that could hold the tokens, the fullest container, the spread of the step groups, and cut_texts, the
    texts cut although they fit."""
    placed = packed.where("container is not null")
    cut = F.count_if((F.col("tokens") <= capacity) & (F.col("piece_tokens") < F.col("tokens")))
    by_container = placed.groupBy("container", "step_group").agg(F.sum("piece_tokens").alias("filled"), F.count(F.lit(1)).alias("pieces"), cut.alias("cut"))
    by_group = by_container.groupBy("step_group").agg(F.sum("filled").alias("filled"), F.max("filled").alias("fullest"), F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"), F.sum("cut").alias("cut"))
    return by_group.agg(
        F.sum("pieces").alias("pieces"), F.sum("containers").alias("containers"), F.sum("filled").alias("tokens"),
        (F.sum("filled") / (F.sum("containers") * capacity)).alias("fill"), F.ceil(F.sum("filled") / capacity).alias("least_containers"), F.max("fullest").alias("fullest"),
        F.count(F.lit(1)).alias("step_groups"), F.min("filled").alias("least_group_tokens"), F.max("filled").alias("most_group_tokens"), F.sum("cut").alias("cut_texts"),
    )
