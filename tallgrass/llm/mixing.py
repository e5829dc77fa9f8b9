"""Mixing sources to target shares of all tokens, by balanced sampling.

Each source is passed over a whole number of times plus a fraction. For the fraction every text has the
same inclusion probability; the cube method then moves the vector of probabilities along directions that
keep the expected number of texts and of tokens, until each text is in or out. The flight runs in blocks
in parallel and leaves at most two undecided texts a block; these meet in fewer blocks, round by round,
until a landing problem of a few texts a source remains.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm.tokens import token_count
from tallgrass.plans.staging import release, stage

EPS = 1e-9
MAX_SOURCES = 10_000


def fly(prob: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The flight of the cube method with two balancing constraints, the number and the total size.

    Three undecided units are held at a time; the two constraints leave one direction in which all three
    can move without changing either sum, up to the face where one of them becomes 0 or 1.
    """
    p = prob.astype(float).tolist()
    w = size.astype(float).tolist()
    held = [i for i in range(len(p)) if EPS < p[i] < 1 - EPS]
    todo = iter(held)
    trio = list(itertools.islice(todo, 3))
    while len(trio) == 3:
        i, j, k = trio
        # Null space of [[1, 1, 1], [w_i, w_j, w_k]].
        d = (w[k] - w[j], w[i] - w[k], w[j] - w[i])
        if max(map(abs, d)) < EPS:
            d = (1.0, -1.0, 0.0)
        up = min((1 - p[x]) / s if s > 0 else p[x] / -s for x, s in zip(trio, d) if abs(s) > EPS)
        for x, s in zip(trio, d):
            v = p[x] + up * s
            p[x] = 0.0 if v < EPS else 1.0 if v > 1 - EPS else v
        trio = [x for x in trio if 0 < p[x] < 1]
        trio += itertools.islice(todo, 3 - len(trio))
    return np.array(p)


def land(prob: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide the last few units: the choice whose sums come closest to what the probabilities ask for."""
    open_ = np.flatnonzero((prob > EPS) & (prob < 1 - EPS))
    out = np.round(prob)
    if len(open_):
        want_n, want_w = prob[open_].sum(), (prob[open_] * size[open_]).sum()
        scale = max(1.0, size[open_].max())
        best = min(itertools.product((0, 1), repeat=len(open_)), key=lambda s: (abs(np.dot(s, size[open_]) - want_w) / scale + 0.5 * abs(sum(s) - want_n), s))
        out[open_] = best
    return out


def _fly_block(batch: pd.DataFrame) -> pd.DataFrame:
    batch = batch.sort_values(["draw", "id_text"], kind="stable", ignore_index=True)
    return batch.assign(prob=fly(batch["prob"].to_numpy(), batch["tokens"].to_numpy())).drop(columns="salt")


def _land_block(batch: pd.DataFrame) -> pd.DataFrame:
    flown = _fly_block(batch)
    return flown.assign(prob=land(flown["prob"].to_numpy(), flown["tokens"].to_numpy()))


def mix(
    texts: DataFrame,
    targets: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: int = 17,
    block: int = 20_000,
) -> tuple[DataFrame, DataFrame]:
    """(selection, report) of a mixture in which each listed source has its target share of all tokens.

    ``selection``: (id, source, tokens, copies), the texts that are in, with how often. ``report``:
    (source, n_texts, source_tokens, target_share, need, max_repeat, passes, mixed_texts, mixed_tokens,
    reached_share), a row per target. need = target_share * T / source_tokens, T the tokens of all
    listed sources; passes is need rounded up, at most max_repeat. A source whose need exceeds
    max_repeat is passed over max_repeat times and falls short; the report says by how much.

    Defined cases: sources are compared trimmed and in lower case; texts of null or unlisted sources and
    texts without tokens are left out; a listed source without tokens has need null and 0 passes; an empty
    table gives an empty selection; repeated rows are separate texts; columns not named are not read.
    """
    wanted = targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeat").limit(MAX_SOURCES + 1)
    rows = wanted.collect()  # the list of sources, checked
    if len(rows) > MAX_SOURCES or len({r[0] for r in rows}) < len(rows):
        raise ValueError(f"targets must name at most {MAX_SOURCES} different sources")
    listed = texts.select(F.col(id).alias("id"), F.lower(F.trim(F.col(source))).alias("source"), token_count(F.col(text)).cast("long").alias("tokens"))
    sized = stage(listed.join(F.broadcast(wanted.select("source")), "source").where("tokens > 0"), "mix-sizes")
    held = {r[0]: (r[1], r[2]) for r in sized.groupBy("source").agg(F.sum("tokens"), F.count(F.lit(1))).collect()}
    total = sum(s for s, _ in held.values())
    facts = []
    for name, share, most in rows:
        tokens, n = held.get(name, (0, 0))
        need = share * total / tokens if tokens else None
        amount = min(need, float(most)) if need is not None else 0.0
        whole = int(amount)
        passes = min(int(np.ceil(need)), most) if need is not None else 0
        facts.append((name, n, tokens, share, need, most, passes, whole, amount - whole))
    spark = texts.sparkSession
    known = spark.createDataFrame(facts or [(None, 0, 0, 0.0, 0.0, 0, 0, 0, 0.0)], "source string, n_texts long, source_tokens long, target_share double, need double, max_repeat int, passes int, whole int, fraction double")
    known = known if facts else known.limit(0)
    units = sized.join(F.broadcast(known.select("source", "whole", "fraction")), "source")
    sampled = units.where(F.col("fraction") > EPS).select(
        "id", "source", "tokens", F.col("id").cast("string").alias("id_text"), F.xxhash64(F.lit(seed), "id").alias("draw"), F.col("fraction").alias("prob")
    )
    schema = sampled.schema
    decided: list[DataFrame] = []
    largest = max((held[f[0]][1] for f in facts if f[8] > EPS), default=0)
    undecided, n, used = sampled, largest, []
    while n:
        shares = max(1, -(-n // block))
        last = shares == 1
        salt = F.pmod(F.xxhash64(F.lit(seed + len(decided) + 1), "draw", "id_text"), F.lit(shares))
        # Blocks are of about `block` texts by construction; a source that holds most texts has many.
        blocks = undecided.withColumn("salt", salt).groupBy("source", "salt")
        flown = stage(blocks.applyInPandas(_land_block if last else _fly_block, schema), "flight")
        used.append(flown)
        open_ = (F.col("prob") > EPS) & (F.col("prob") < 1 - EPS)
        decided.append(flown.where(~open_))
        if last:
            break
        undecided = flown.where(open_)
        n = undecided.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    extra = None
    for part in decided:
        part = part.where(F.col("prob") > 0.5).select("id", "source", "tokens", F.lit(1).alias("copies"))
        extra = part if extra is None else extra.unionByName(part)
    base = units.where("whole > 0").select("id", "source", "tokens", F.col("whole").alias("copies"))
    parts = base if extra is None else base.unionByName(extra)
    selection = stage(parts.groupBy("id", "source", "tokens").agg(F.sum("copies").cast("int").alias("copies")), "mixture")
    mixed = selection.groupBy("source").agg(F.sum("copies").alias("mixed_texts"), F.sum(F.col("copies") * F.col("tokens")).alias("mixed_tokens"))
    everything = selection.agg(F.sum(F.col("copies") * F.col("tokens"))).first()[0] or 0
    none = F.lit(0).cast("long")
    report = known.drop("whole", "fraction").join(F.broadcast(mixed), "source", "left").withColumns({
        "mixed_texts": F.coalesce("mixed_texts", none), "mixed_tokens": F.coalesce("mixed_tokens", none),
    }).withColumn("reached_share", F.col("mixed_tokens") / F.lit(float(everything) or None))
    release(sized, *used)
    return selection.select(F.col("id").alias(id), "source", "tokens", "copies"), report


