"""Scores per dimension and the evaluation of findings against labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = ["Completeness", "Validity", "Consistency", "Uniqueness"]


def scorecard(findings: DataFrame, records: int, dimensions: Sequence[str] = DIMENSIONS, own: Mapping[str, tuple[int, int]] | None = None) -> DataFrame:
    """(dimension, n_findings, affected, assessed, excluded, score) for each dimension, found or not.

    score is 100 * (1 - affected records / assessed), 100 where nothing was assessed. ``own`` gives a
    dimension its own numbers of assessed and excluded records. Scores are unrounded.
    """
    facts = [(d, *(own or {}).get(d, (records, 0))) for d in dimensions]
    listed = findings.sparkSession.createDataFrame(facts, "dimension string, assessed long, excluded long")
    hit = findings.groupBy("dimension").agg(F.count(F.lit(1)).alias("n_findings"), F.countDistinct("table_name", "record_id").alias("affected"))
    zero = F.lit(0).cast("long")
    joined = listed.join(F.broadcast(hit), "dimension", "left").withColumns({"n_findings": F.coalesce("n_findings", zero), "affected": F.coalesce("affected", zero)})
    score = F.when(F.col("assessed") > 0, 100 * (1 - F.col("affected") / F.col("assessed"))).otherwise(100.0)
    return joined.select("dimension", "n_findings", "affected", "assessed", "excluded", score.alias("score"))


def overall(scores: DataFrame) -> DataFrame:
    """The mean of the dimensions' scores; 100 for none."""
    return scores.agg(F.coalesce(F.avg("score"), F.lit(100.0)).alias("overall_score"))


def top_fields(findings: DataFrame, n: int = 8) -> DataFrame:
    """The fields with most findings; a finding on no field counts for the record."""
    label = F.concat(F.col("table_name"), F.lit("."), F.coalesce("field", F.lit("(record)")), F.lit(" ("), F.col("dimension"), F.lit(")"))
    return findings.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n_findings")).orderBy(F.desc("n_findings"), "label").limit(n)


def precision_recall(findings: DataFrame, labels: DataFrame) -> DataFrame:
    """(dimension, tp, fp, fn, precision, recall, f1) on distinct (rule, record); empty denominators give 1, f1 then 0."""
    key = ["dimension", "rule_id", "record_id"]
    found = findings.select(*key).distinct().withColumn("f", F.lit(1))
    meant = labels.select(*key).distinct().withColumn("l", F.lit(1))
    both = found.join(meant, key, "full_outer").groupBy("dimension").agg(
        F.count_if(F.col("f").isNotNull() & F.col("l").isNotNull()).alias("tp"), F.count_if(F.col("l").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn")
    )
    ratio = lambda n, d: F.when(d > 0, n / d).otherwise(1.0)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    rated = both.withColumns({"precision": p, "recall": r})
    return rated.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def _side(clusters: DataFrame, name: str) -> DataFrame:
    return clusters.select(F.col("member").alias(name), F.col("cluster_id").alias(f"{name}_cluster"))


def twin_recall(twins: DataFrame, clusters: DataFrame, records: DataFrame, key: str, block: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(*by, n_twins, n_matchable, found, recall, matchable_recall) of labelled twins (twin, source, strategy).

    A twin is matchable if it still agrees with its source on ``block``; it is found if both are in one cluster.
    """
    sides = {}
    for side in ("twin", "source"):
        code = F.concat_ws("\u001f", *[F.coalesce(F.trim(b), F.lit("")) for b in block])
        sides[side] = records.select(F.col(key).alias(side), code.alias(f"{side}_block")).dropDuplicates([side])
    t = twins.join(sides["twin"], "twin", "left").join(sides["source"], "source", "left").join(_side(clusters, "twin"), "twin", "left").join(_side(clusters, "source"), "source", "left")
    found = F.coalesce(F.col("twin_cluster") == F.col("source_cluster"), F.lit(False))
    matchable = F.coalesce(F.col("twin_block") == F.col("source_block"), F.lit(False))
    got = t.groupBy(*by).agg(F.count(F.lit(1)).alias("n_twins"), F.count_if(matchable).alias("n_matchable"), F.count_if(found).alias("found"), F.count_if(found & matchable).alias("__fm"))
    return got.select(*by, "n_twins", "n_matchable", "found", F.when(F.col("n_twins") > 0, F.col("found") / F.col("n_twins")).otherwise(0.0).alias("recall"),
                      F.when(F.col("n_matchable") > 0, F.col("__fm") / F.col("n_matchable")).otherwise(0.0).alias("matchable_recall"))


def decoy_errors(decoys: DataFrame, clusters: DataFrame) -> DataFrame:
    """(kind, n_decoys, joined, error_rate): pairs that must stay apart but share a cluster."""
    d = decoys.join(_side(clusters, "left_id"), "left_id", "left").join(_side(clusters, "right_id"), "right_id", "left")
    hit = F.count_if(F.coalesce(F.col("left_id_cluster") == F.col("right_id_cluster"), F.lit(False)))
    return d.groupBy("kind").agg(F.count(F.lit(1)).alias("n_decoys"), hit.alias("joined")).withColumn("error_rate", F.col("joined") / F.col("n_decoys"))


def unlabelled_joins(clusters: DataFrame, known_pairs: DataFrame) -> DataFrame:
    """(cluster_id, pairs, known, unlabelled): pairs within clusters by arithmetic, less those that are labelled."""
    sizes = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("k"))
    pairs = known_pairs.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id")).where("left_id <> right_id").distinct()
    inside = pairs.join(_side(clusters, "left_id"), "left_id").join(_side(clusters, "right_id"), "right_id").where(F.col("left_id_cluster") == F.col("right_id_cluster"))
    known = inside.groupBy(F.col("left_id_cluster").alias("cluster_id")).agg(F.count(F.lit(1)).alias("known"))
    n = (F.col("k") * (F.col("k") - 1) / 2).cast("bigint")
    return sizes.join(known, "cluster_id", "left").select("cluster_id", n.alias("pairs"), F.coalesce("known", F.lit(0).cast("bigint")).alias("known"), (n - F.coalesce("known", F.lit(0))).alias("unlabelled"))


def verdict_quality(verdicts: DataFrame, twins: DataFrame, decoys: DataFrame) -> DataFrame:
    """One row (judged, twins_judged, twins_confirmed, decoys_judged, decoys_rejected, unlabelled_judged) of verdicts (left_id, right_id, decision).

    A labelled twin judged ``duplicate`` and a decoy judged ``not_duplicate`` are right; other pairs can't be told.
    """
    ordered = lambda df, a, b, kind: df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.lit(True).alias(kind)).distinct()
    v = verdicts.select(F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b"), "decision")
    j = v.join(ordered(twins, "twin", "source", "is_twin"), ["a", "b"], "left").join(ordered(decoys, "left_id", "right_id", "is_decoy"), ["a", "b"], "left")
    twin, decoy = F.col("is_twin").isNotNull(), F.col("is_twin").isNull() & F.col("is_decoy").isNotNull()
    return j.agg(
        F.count(F.lit(1)).alias("judged"), F.count_if(twin).alias("twins_judged"), F.count_if(twin & (F.col("decision") == "duplicate")).alias("twins_confirmed"),
        F.count_if(decoy).alias("decoys_judged"), F.count_if(decoy & (F.col("decision") == "not_duplicate")).alias("decoys_rejected"), F.count_if(~twin & ~decoy).alias("unlabelled_judged"),
    )


def score_by_strategy(twins: DataFrame, scores: DataFrame) -> DataFrame:
    """(strategy, n, mean_score) of scored twin pairs."""
    s = scores.select(F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b"), "score")
    t = twins.select(F.least("twin", "source").alias("a"), F.greatest("twin", "source").alias("b"), "strategy")
    return t.join(s, ["a", "b"]).groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))
