"""Frames a steward reads: clusters, their members, uncertain pairs, what was held back, the settings in force."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.operators.ir import Rule
from tallgrass.operators.matching import Matching, member_scores
from tallgrass.plans.lookup import lookup

NO_TEXT = "(no text)"

# What the bands and settings mean to a reader.
MEANINGS = {
    "duplicate": "reaches the duplicate band and is joined into a cluster",
    "review": "lies in the review band and waits for a judgement",
    "below": "lies below the review band and counts as different records",
}


def overview(members: DataFrame, kept: DataFrame, weakest: DataFrame, table: str, mode: str = "full") -> DataFrame:
    """(cluster_id, table_name, n_records, block, weakest_link, survivor, reason, resolution, mode): a row per cluster."""
    sizes = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_records"), F.min("block").alias("block"))
    joined = sizes.join(kept, "cluster_id").join(weakest, "cluster_id", "left")
    resolution = F.when(F.col("needs_steward"), "needs_steward").otherwise("automatic")
    return joined.select("cluster_id", F.lit(table).alias("table_name"), "n_records", F.translate("block", "\u001f", "/").alias("block"), "weakest_link", "survivor", "reason", resolution.alias("resolution"), F.lit(mode).alias("mode"))


def largest(clusters: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` clusters of most records, for a report."""
    return clusters.orderBy(F.desc("n_records"), "cluster_id").limit(n)


def listing(members: DataFrame, kept: DataFrame, found: DataFrame | None, filled: DataFrame | None, m: Matching, shift: float = 0.0) -> DataFrame:
    """(cluster_id, place, member, is_survivor, score, below_band, n_mandatory, n_total, text): members, the survivor first, then by score.

    ``place`` orders the members of a cluster: 0 for the survivor, for the others how far their score lies
    below 1 (ties by name); a rank is not computed, as a cluster may hold most records. Without ``found`` and
    ``filled`` the members carry text, norm, n_mandatory and n_total.
    """
    if found is None:
        joined = member_scores(members, kept, None, m, shift, ("n_mandatory", "n_total", "text")).withColumn("text", F.coalesce("text", F.lit(NO_TEXT)))
    else:
        texts = found.select(F.col("key").alias("member"), F.coalesce("text", F.lit(NO_TEXT)).alias("text"))
        joined = member_scores(members, kept, found, m, shift).join(filled, "member", "left").join(texts, "member", "left")
    place = F.when(F.col("is_survivor"), 0.0).otherwise(1.0 + (1.0 - F.col("score")))
    return joined.select("cluster_id", place.alias("place"), "member", "is_survivor", "score", "below_band", F.coalesce("n_mandatory", F.lit(0)).alias("n_mandatory"), F.coalesce("n_total", F.lit(0)).alias("n_total"), "text")


def uncertain(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """(left_id, right_id, score, block, left_text, right_text) of the pairs in the review band."""
    texts = found.select("key", F.coalesce("text", F.lit(NO_TEXT)).alias("text"))
    side = lambda p: texts.select(F.col("key").alias(f"{p}_id"), F.col("text").alias(f"{p}_text"))
    open_ = pairs.where("band = 'review'").select("left_id", "right_id", "score", F.translate("block", "\u001f", "/").alias("block"))
    return lookup(lookup(open_, side("left"), "left_id"), side("right"), "right_id")


def spread(counts: DataFrame) -> DataFrame:
    """(band, n_pairs, meaning) of a score spread."""
    told = F.coalesce(*[F.when(F.col("band") == b, t) for b, t in MEANINGS.items()])
    return counts.select("band", "n_pairs", told.alias("meaning"))


def settings(spark: SparkSession, m: Matching, shift: float = 0.0, shares: dict[str, float] | None = None) -> DataFrame:
    """(setting, in_force, meaning): the settings of a run after its advisories."""
    low, top = m.bands(shift)
    fuzzy, semantic = m.shares
    rows = [
        ("blocking keys", ", ".join(m.block) or "(none)", "records are compared only if they agree on all of these"),
        ("duplicate band", f"{top:g}", f"set to {m.duplicate:g}, moved by {shift:g}"),
        ("review band from", f"{low:g}", f"set to {m.review_low:g}; pairs from here to the duplicate band wait for a judgement"),
        *[(f"compared field {f}", f"{s:.4g}", "the field's share of a record's score") for f, s in sorted((shares or {}).items())],
        ("fuzzy metric", m.metric, f"compares letters, weight {fuzzy:g}"),
        ("semantic weight", f"{semantic:g}", "compares vectors"),
        ("veto cap", f"{m.veto_cap:g}", "the most a pair can score whose digits or materials differ"),
        ("most pairs of a block", "no limit" if m.most_block_pairs is None else str(m.most_block_pairs), "larger blocks are held back"),
    ]
    return spark.createDataFrame(rows, "setting string, in_force string, meaning string")


def mode_note(mode: str | None, reason: str = "") -> tuple[str, str]:
    """(ok or warn, text): which comparisons ran."""
    if mode == "full":
        return "ok", "Letters and meaning were both compared."
    if not mode:
        return "warn", "The run didn't say how it compared."
    return "warn", f"Only letters were compared, so records that say the same in other words were missed. Reason: {reason or 'not recorded'}."


def approval_note(rules: Iterable[Rule]) -> str:
    """Which tables have approved rules; a table that isn't named was not checked."""
    tables = sorted({r.table for r in rules})
    return f"Tables with approved rules: {', '.join(tables)}." if tables else "No table has approved rules yet."


def advisory_note(shift: float, excluded: Iterable[str]) -> str:
    """What advisories changed in a run."""
    parts = [f"The bands were moved up by {shift:g}."] if shift else []
    if named := sorted(set(excluded)):
        parts.append(f"Records that failed {', '.join(named)} were held back.")
    return " ".join(parts) or "No advisory changed the run."


def oversized(found: DataFrame) -> DataFrame:
    """(block, n_records, n_pairs) of the blocks that were held back for their size."""
    large = found.where("reason = 'block_too_large'").groupBy(F.translate("block", "\u001f", "/").alias("block")).agg(F.count(F.lit(1)).alias("n_records"))
    return large.withColumn("n_pairs", (F.col("n_records") * (F.col("n_records") - 1) / 2).cast("bigint"))


def verdicts(judged: DataFrame) -> DataFrame:
    """(left_id, right_id, score, decision, confidence, rationale) of the pairs that were judged."""
    return judged.where("decision is not null").select("left_id", "right_id", F.round("score", 4).alias("score"), "decision", "confidence", "rationale")


# What to do about the findings of a dimension.
TO_DO = {
    "Completeness": "Fill %2$s in the %1$s affected records.", "Validity": "Correct %2$s in the %1$s affected records.",
    "Consistency": "Bring the fields %2$s of the %1$s affected records into line.", "Uniqueness": "Review the %1$s affected records for duplicates.",
}


def worded(plan: DataFrame) -> DataFrame:
    """``plan`` with ``action``, what to do, and ``rationale``, why it stands where it does."""
    field = F.when(F.col("field") == "", "the record").otherwise(F.col("field"))
    told = F.coalesce(*[F.when(F.col("dimension") == d, F.format_string(t, F.col("affected").cast("string"), field)) for d, t in TO_DO.items()], F.format_string("Review the %s affected records.", F.col("affected").cast("string")))
    why = F.concat_ws("; ", F.format_string("%s records", F.col("affected").cast("string")), F.concat(F.lit("worst severity "), F.col("severity")), F.when(F.col("rule_id") != "", F.concat(F.lit("rule "), F.col("rule_id"))))
    return plan.withColumns({"action": told, "rationale": why})


def no_checks_warning(tables: Iterable[str], rules: Iterable[Rule]) -> str:
    """A warning that names the tables no executable rule reads; empty if there are none."""
    checked = {r.table for r in rules if r.executable}
    named = sorted(set(tables) - checked)
    return f"No rule was run on {', '.join(named)}: that nothing was found there says nothing." if named else ""
