"""Connected components over pairs, in two ways that need no vertex's neighbours in one task.

``contract`` is randomised contraction: each round every vertex hooks to the vertex of its closed
neighbourhood that comes first in a fresh hash order, edges are relabelled and deduplicated, and the
mappings of all rounds are expanded at the end. The expected number of rounds is logarithmic in the
number of vertices, chains included.

``stars`` alternates large-star and small-star steps until every vertex points at the smallest vertex
of its component.

Both keep each step as a table in the shared folder, aggregate map-side and route hot vertices around
the shuffle (see :mod:`tallgrass.plans.lookup`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.plans.lookup import BROADCAST_ROWS, HEAVY_SHARE, lookup
from tallgrass.plans.staging import release, stage


def _edges(pairs: DataFrame, left: str, right: str) -> DataFrame:
    return (
        pairs.select(F.col(left).alias("u"), F.col(right).alias("v"))
        .where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    )


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))


def contract(pairs: DataFrame, left: str, right: str, max_rounds: int = 100) -> DataFrame:
    """(member, component): for each vertex with at least one link, the smallest vertex it is tied to.

    ``pairs`` holds links in columns ``left`` and ``right`` of one orderable type. Direction and
    repetition don't matter; a pair of a vertex with itself or with null links nothing. No links, no
    rows. Other columns are not read.
    """
    edges = stage(_edges(pairs, left, right).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    mappings: list[DataFrame] = []
    numbers: list[int] = []  # edges of each round
    n = edges.count()
    while n:
        if len(mappings) >= max_rounds:
            raise RuntimeError(f"{n} edges are left after {max_rounds} rounds")
        rank = lambda c, seed=len(mappings): F.xxhash64(F.lit(0x5DEECE66D + 7919 * seed), F.col(c))  # noqa: E731, B023
        arcs = _both_ways(edges)
        hooks = stage(
            arcs.groupBy("u").agg(F.min(F.struct(rank("v").alias("h"), F.col("v").alias("w"))).alias("best"), F.count(F.lit(1)).alias("degree"))
            .select("u", F.least(F.col("best"), F.struct(rank("u").alias("h"), F.col("u").alias("w")))["w"].alias("r"), "degree"),
            "hooks",
        )
        mapping = hooks.select("u", "r")
        if n <= BROADCAST_ROWS:  # so the mapping has at most twice as many rows
            mapped = lambda df: df.join(F.broadcast(mapping), "u")  # noqa: E731, B023
        else:
            heavy = hooks.where(F.col("degree") > 2 * n / HEAVY_SHARE).select("u").collect()  # under HEAVY_SHARE vertices
            mapped = lambda df: lookup(df, mapping, "u", heavy)  # noqa: E731, B023
        once = mapped(edges).select(F.col("r").alias("a"), F.col("v").alias("u"))
        twice = mapped(once).select("a", F.col("r").alias("b"))
        relabelled = twice.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        smaller = stage(relabelled, "edges")
        release(edges)
        mappings.append(hooks)
        numbers.append(n)
        edges, n = smaller, smaller.count()
    if not mappings:
        return edges.select(F.col("u").alias("member"), F.col("v").alias("component"))
    # Expansion from the last round to the first; a vertex that left the graph is its own root.
    root = mappings[-1].select("u", "r")
    for earlier, later_edges in zip(reversed(mappings[:-1]), reversed(numbers[1:])):
        step = earlier.select(F.col("u").alias("x"), F.col("r").alias("u"))
        known = lambda df: df.select(F.col("x").alias("u"), F.coalesce("r", "u").alias("r"))
        if later_edges <= BROADCAST_ROWS:  # the roots found so far are at most twice as many
            root = known(step.join(F.broadcast(root), "u", "left"))
        else:
            expanded = stage(known(lookup(step, root, "u", how="left")), "roots")
            release(root)
            root = expanded
    root = stage(root, "roots")
    smallest = root.groupBy("r").agg(F.min("u").alias("component"))
    out = stage(lookup(root.withColumnRenamed("r", "k"), smallest.withColumnRenamed("r", "k"), "k").select(F.col("u").alias("member"), "component"), "components")
    release(edges, root, *mappings)
    return out


def _large_star(edges: DataFrame) -> DataFrame:
    """For each vertex, link every larger neighbour to the smallest vertex of the closed neighbourhood."""
    arcs = _both_ways(edges)
    low = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return lookup(arcs.where("v > u"), low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """For each vertex, link it and every smaller neighbour to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = lookup(down, low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.unionByName(low.select("u", F.col("m").alias("v")))


def stars(pairs: DataFrame, left: str, right: str, max_rounds: int = 100) -> DataFrame:
    """(member, component) as :func:`contract`, by alternating large-star and small-star steps."""
    tidy = lambda df: df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stage(tidy(_edges(pairs, left, right)), "edges")
    for _ in range(max_rounds):
        large = stage(tidy(_large_star(edges)), "large-star")
        small = stage(tidy(_small_star(large)), "small-star")
        # Stable once no edge is new: then each vertex has one edge, to its component's smallest vertex.
        changed = small.count() != edges.count() or not small.join(edges, ["u", "v"], "left_anti").isEmpty()
        release(edges, large)
        edges = small
        if not changed:
            roots = edges.select(F.col("v").alias("member"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("member"), F.col("v").alias("component")).unionByName(roots)
    raise RuntimeError(f"not stable after {max_rounds} rounds")


def judged_links(
    decisions: DataFrame,
    left: str = "left_matnr",
    right: str = "right_matnr",
    score: str = "score",
    verdict: str = "verdict",
    decided_at: str = "decided_at",
    accept: str = "duplicate",
    least_score: float = 0.92,
    width: int = 18,
) -> DataFrame:
    """(left_id, right_id): the pairs that their latest decision ties.

    Numbers are padded with zeros to ``width``; a pair is the same in either order. Of rows decided at
    the same time the one with the largest (verdict, score) counts; a row with no time comes first of all.
    """
    pad = lambda c: F.when(F.trim(c) != "", F.lpad(F.trim(c), width, "0"))
    a, b = pad(F.col(left)), pad(F.col(right))
    rows = decisions.select(
        F.least(a, b).alias("left_id"), F.greatest(a, b).alias("right_id"),
        a.isNotNull().alias("__a"), b.isNotNull().alias("__b"),
        F.struct(F.col(decided_at).alias("at"), F.col(verdict).alias("verdict"), F.col(score).alias("score")).alias("row"),
    ).where("__a and __b and left_id <> right_id")
    latest = rows.groupBy("left_id", "right_id").agg(F.max("row").alias("row"))
    tied = (F.col("row.verdict") == accept) | (F.col("row.verdict").isNull() & (F.col("row.score") >= least_score))
    return latest.where(F.coalesce(tied, F.lit(False))).select("left_id", "right_id")
