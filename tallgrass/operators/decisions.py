"""What follows from findings: advisories, verdicts on uncertain pairs, ranked actions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.operators.ir import SEVERITIES
from tallgrass.plans.numbering import numbered
from tallgrass.plans.staging import stage

SPARSE_BELOW, SPARSE_SHIFT = 90.0, 0.05
MANDATORY_LIFT = 1.5


@dataclass(frozen=True)
class Advisory:
    target: str
    action: str
    shift: float = 0.0
    why: str = ""

    def __post_init__(self):
        if self.action not in ("raise_threshold", "exclude_records"):
            raise ValueError(f"unknown action {self.action!r}")
        if self.action == "raise_threshold" and not self.shift:
            raise ValueError("raise_threshold needs a shift")


@dataclass(frozen=True)
class Verdict:
    """What a judge of uncertain pairs returns."""

    decision: str
    confidence: float
    rationale: str = ""

    def __post_init__(self):
        if self.decision not in ("duplicate", "not_duplicate", "uncertain"):
            raise ValueError(f"unknown decision {self.decision!r}")
        if not 0 <= self.confidence <= 1:
            raise ValueError("a confidence lies between 0 and 1")


def sparse_fields(df: DataFrame, table: str, fields: Sequence[str], below: float = SPARSE_BELOW) -> DataFrame:
    """(target, populated_pct): fields filled (not null) in less than ``below`` percent; none for an empty table."""
    cells = F.array(*[F.struct(F.lit(f"{table}.{f}").alias("target"), F.col(f).isNotNull().cast("int").alias("x")) for f in fields])
    return df.select(F.inline(cells)).groupBy("target").agg((100 * F.avg("x")).alias("populated_pct")).where(F.col("populated_pct") < below)


def failing_fields(findings: DataFrame, least: int = 1) -> DataFrame:
    """(target, n_findings): fields with at least ``least`` validity findings."""
    v = findings.where("dimension = 'Validity'")
    return v.groupBy(F.concat_ws(".", "table_name", "field").alias("target")).agg(F.count(F.lit(1)).alias("n_findings")).where(F.col("n_findings") >= least)


def resolve(advisories: Iterable[Advisory]) -> tuple[float, list[str]]:
    """(the largest shift, the fields whose failing records are excluded)."""
    advisories = list(advisories)
    shift = max((a.shift for a in advisories if a.action == "raise_threshold"), default=0.0)
    return shift, sorted({a.target for a in advisories if a.action == "exclude_records"})


def excluded_records(findings: DataFrame, targets: Sequence[str]) -> DataFrame:
    """(record_id): records with a validity finding on exactly one of the target fields."""
    return findings.where((F.col("dimension") == "Validity") & F.concat_ws(".", "table_name", "field").isin(*targets)).select("record_id").distinct()


def queue(pairs: DataFrame, judged: DataFrame, cap: int = 500) -> DataFrame:
    """The ``cap`` highest-scored pairs that aren't judged yet; ties by pair_key. The cap is the model's budget."""
    return pairs.join(judged.select("pair_key"), "pair_key", "left_anti").orderBy(F.desc("score"), "pair_key").limit(cap)


def judge(pairs: DataFrame, judged: DataFrame, program: Callable[[dict], Verdict | tuple[str, float, str]], fingerprint: str, cap: int = 500) -> DataFrame:
    """(pair_key, decision, confidence, rationale, fingerprint): earlier verdicts and those of ``program`` on the queue's head."""
    rows = [r.asDict() for r in queue(pairs, judged, cap).collect()]  # at most `cap` rows
    fresh = []
    for r in rows:
        said = program(r)
        v = said if isinstance(said, Verdict) else Verdict(*said)
        fresh.append((r["pair_key"], v.decision, float(v.confidence), v.rationale, fingerprint))
    schema = "pair_key string, decision string, confidence double, rationale string, fingerprint string"
    return judged.unionByName(pairs.sparkSession.createDataFrame(fresh, schema))


def apply_verdicts(pairs: DataFrame, verdicts: DataFrame, fingerprint: str) -> DataFrame:
    """``pairs`` with decision, confidence and rationale; verdicts made under other settings are not applied, of several of a pair the most confident is."""
    valid = verdicts.where(F.col("fingerprint") == fingerprint).groupBy("pair_key").agg(F.max(F.struct("confidence", "decision", "rationale")).alias("v")).select("pair_key", "v.decision", "v.confidence", "v.rationale")
    return pairs.join(valid, "pair_key", "left").withColumn("is_open", F.coalesce(F.col("decision") == "uncertain", F.col("decision").isNull()))


def judged_by(pairs: DataFrame, decision: Column, confidence: Column, rationale: Column) -> DataFrame:
    """:func:`apply_verdicts` of a judge that is a rule on the pair's own columns: its verdicts are applied where they are made, none is sought by its pair."""
    said = decision.isNotNull()
    told = pairs.withColumns({"decision": decision, "confidence": F.when(said, confidence), "rationale": F.when(said, rationale)})
    return told.withColumn("is_open", F.coalesce(F.col("decision") == "uncertain", F.col("decision").isNull()))


def actions(findings: DataFrame, mandatory: Sequence[str] = ()) -> DataFrame:
    """(place, dimension, table_name, field, rule_id, affected, severity, priority, group_id): groups of findings, worst first.

    priority is the weight of the worst severity times the distinct records, half more for a mandatory field.
    """
    weight = F.coalesce(*[F.when(F.col("severity") == s, w) for s, w in SEVERITIES.items()], F.lit(0))
    group = ["dimension", "table_name", "field", "rule_id"]
    named = findings.withColumns({"field": F.coalesce("field", F.lit("")), "rule_id": F.coalesce("rule_id", F.lit(""))})
    got = named.groupBy(*group).agg(F.countDistinct("record_id").alias("affected"), F.max(weight).alias("w"))
    lift = F.when(F.concat_ws(".", "table_name", "field").isin(*mandatory), MANDATORY_LIFT).otherwise(1.0) if mandatory else F.lit(1.0)
    back = F.coalesce(*[F.when(F.col("w") == w, s) for s, w in SEVERITIES.items()])
    rated = got.withColumns({"severity": back, "priority": F.col("w") * F.col("affected") * lift, "group_id": F.substring(F.sha2(F.concat_ws("|", *group), 256), 1, 12)})
    # A row per rule and field.
    place = F.row_number().over(Window.orderBy(F.desc("priority"), *group))
    return rated.withColumn("place", place).select("place", *group, "affected", "severity", "priority", "group_id")


def attach_narrative(plan: DataFrame, narrative: DataFrame) -> DataFrame:
    """``plan`` with the text written for each group; a text written for another number of records is stale and left off."""
    texts = narrative.select("group_id", F.col("affected").alias("written_for"), "text")
    return plan.join(texts, "group_id", "left").withColumn("text", F.when(F.col("affected") == F.col("written_for"), F.col("text"))).drop("written_for")


# What to do about records that took no part in the search for duplicates.
HELD_BACK = {
    "validity_failed": "Correct the descriptions that failed a validity check; they were held out of the search for duplicates too.",
    "no_description": "Describe the records that have no description, so that they can be compared.",
    "no_blocking_key": "Fill the blocking fields of the records that lack them.",
    "block_too_large": "Add a blocking key or raise the limit of pairs: these records were never compared.",
}


def describe(advisory: Advisory) -> str:
    """An advisory in a sentence."""
    what = f"raise the bands by {advisory.shift:g}" if advisory.action == "raise_threshold" else "hold back the records that failed"
    return f"{advisory.target}: {what}" + (f" ({advisory.why})" if advisory.why else "")


def merge(*lists: Iterable[Advisory]) -> dict[str, list[Advisory]]:
    """The advisories of several branches by target, each once, in the order they came."""
    out: dict[str, list[Advisory]] = {}
    for a in (a for one in lists for a in one):
        if a not in out.setdefault(a.target, []):
            out[a.target].append(a)
    return out


def uniqueness_actions(held: DataFrame, table: str, mode: str, assessed: int) -> DataFrame:
    """Entries of the plan that no finding tells: (dimension, table_name, field, rule_id, affected, severity, priority, action).

    Records that were held back weigh as High each, by reason; a run that compared letters only weighs as
    Medium for every record it assessed.
    """
    action = F.coalesce(*[F.when(F.col("reason") == r, t) for r, t in HELD_BACK.items()], F.concat(F.lit("Review the records held back: "), F.col("reason")))
    fixed = [F.lit("Uniqueness").alias("dimension"), F.lit(table).alias("table_name"), F.lit("").alias("field")]
    out = held.where("n_records > 0").select(
        *fixed, F.col("reason").alias("rule_id"), F.col("n_records").alias("affected"), F.lit("High").alias("severity"), (F.col("n_records") * float(SEVERITIES["High"])).alias("priority"), action.alias("action")
    )
    if mode != "fuzzy_only":
        return out
    row = [(float(SEVERITIES["Medium"] * max(1, assessed)), assessed)]
    only = held.sparkSession.createDataFrame(row, "priority double, affected long")
    return out.unionByName(only.select(*fixed, F.lit("fuzzy_only").alias("rule_id"), "affected", F.lit("Medium").alias("severity"), "priority", F.lit("Make the vectors and run again: only letters were compared.").alias("action")))


def plan(findings: DataFrame, held: DataFrame, table: str, mode: str, assessed: int, mandatory: Sequence[str] = ()) -> DataFrame:
    """:func:`actions` and :func:`uniqueness_actions` ranked together; a list of groups, not of records."""
    group = ["dimension", "table_name", "field", "rule_id"]
    rows = actions(findings, mandatory).select(*group, "affected", "severity", "priority").unionByName(uniqueness_actions(held, table, mode, assessed).select(*group, "affected", "severity", "priority"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("priority"), *group)))


def load_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Verdicts of a JSON lines file or folder; no rows where it is absent or can't be read as such."""
    schema = "pair_key string, decision string, confidence double, rationale string, fingerprint string"
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("pair_key is not null and decision is not null")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def load_plan(path: str) -> dict:
    """A stored plan; empty where the file is absent or no JSON object. A plan is a short list."""
    import json
    from pathlib import Path

    try:
        got = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return {}
    return got if isinstance(got, dict) else {}


def verdict_clusters(judged: DataFrame, filled: DataFrame | None = None) -> DataFrame:
    """(cluster_id, left_id, right_id, survivor, other, reason, score, confidence, rationale): the confirmed pairs of :func:`apply_verdicts`.

    Each is a cluster of its own that a steward decides; the more complete record is to survive, the left one
    of equals. Without ``filled`` the pairs carry n_mandatory and n_total of their records in ``left_kept`` and
    ``right_kept``.
    """
    rows = judged.where("decision = 'duplicate'")
    if filled is None:
        full = lambda p: F.struct(*[F.coalesce(f"{p}_kept.{c}", F.lit(0)).alias(a) for c, a in (("n_mandatory", "a"), ("n_total", "b"))])
        both = stage(rows.select("left_id", "right_id", "score", "confidence", "rationale", full("left").alias("__l"), full("right").alias("__r")), "confirmed")
        return _named(both)
    side = lambda p: filled.select(F.col("member").alias(f"{p}_id"), F.struct(F.col("n_mandatory").alias("a"), F.col("n_total").alias("b")).alias(f"{p}_full"))
    none = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))
    both = rows.join(side("left"), "left_id", "left").join(side("right"), "right_id", "left")
    l, r = F.coalesce("left_full", none), F.coalesce("right_full", none)  # noqa: E741
    return _named(both.withColumns({"__l": l, "__r": r}))


def _named(both: DataFrame) -> DataFrame:
    both = numbered(both, "left_id", "right_id")
    right = F.col("__r") > F.col("__l")
    number = F.col("number").cast("string")
    return both.select(
        F.concat(F.lit("CL-LLM-"), F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit("0"))).alias("cluster_id"), "left_id", "right_id", F.when(right, F.col("right_id")).otherwise(F.col("left_id")).alias("survivor"),
        F.when(right, F.col("left_id")).otherwise(F.col("right_id")).alias("other"), F.when(F.col("__l") == F.col("__r"), "none").otherwise("completeness").alias("reason"), "score", "confidence", "rationale",
    )


def verdict_findings(confirmed: DataFrame, table: str, key: str) -> DataFrame:
    """A medium finding per confirmed pair, on the record that doesn't survive, with the judge's confidence."""
    none = F.lit(None).cast("string")
    return confirmed.select(
        F.lit("Uniqueness").alias("dimension"), F.lit(table).alias("table_name"), F.concat(F.lit(f"{key}="), F.col("other")).alias("record_id"), none.alias("field"), none.alias("rule_id"),
        F.concat(F.lit("judged a duplicate of "), F.col("survivor"), F.lit(": "), F.coalesce("rationale", F.lit(""))).alias("issue"), F.lit("Medium").alias("severity"), "confidence", none.alias("observed_value"),
        F.lit(None).cast("array<string>").alias("expected"), F.create_map(F.lit("cluster_id"), F.col("cluster_id"), F.lit("survivor"), F.col("survivor"), F.lit("source"), F.lit("adjudicator")).alias("metadata"),
    )
