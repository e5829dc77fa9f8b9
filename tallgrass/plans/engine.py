"""The whole assessment: rules, advisories, duplicates, scorecard, ranked actions, as lazy frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.operators import decisions, matching, rules, scorecard
from tallgrass.operators.ir import Rule
from tallgrass.plans.staging import stage


@dataclass
class Subject:
    """The table searched for duplicates, and where its wording comes from."""

    table: str
    key: str
    text_table: str
    text: str
    language: tuple[str, str] | None = None
    fields: tuple[str, ...] = ()
    mandatory: tuple[str, ...] = ()


@dataclass
class Assessment:
    findings: DataFrame
    scores: DataFrame
    actions: DataFrame
    pairs: DataFrame | None
    members: DataFrame | None
    kept: DataFrame | None
    held: DataFrame | None
    shift: float


def assess(
    tables: Mapping[str, DataFrame],
    keys: Mapping[str, Sequence[str]],
    ruleset: Sequence[Rule],
    subject: Subject | None = None,
    settings: matching.Matching | None = None,
    mandatory: Sequence[str] = (),
) -> Assessment:
    """Run everything over whole tables.

    Findings are written once and read by all that follows. Only two advisory lists (a row per field), the
    number of records and the numbers of compared and held-back records come to the driver.
    """
    found = stage(rules.run_ruleset(tables, keys, ruleset), "findings")
    records = sum(tables[t].count() for t in dict.fromkeys(r.table for r in ruleset) if t in tables)
    own, pairs, members, kept, held, shift = {}, None, None, None, None, 0.0
    if subject and subject.table in tables and subject.text_table in tables:
        settings = settings or matching.Matching()
        advisories = [decisions.Advisory(r["target"], "exclude_records") for r in decisions.failing_fields(found).where(F.col("target").isin(*[f"{subject.table}.{b}" for b in settings.block])).collect()]
        sparse = decisions.sparse_fields(tables[subject.text_table], subject.text_table, [subject.text]).collect()
        advisories += [decisions.Advisory(r["target"], "raise_threshold", decisions.SPARSE_SHIFT) for r in sparse]
        shift, targets = decisions.resolve(advisories)
        language = F.col(subject.language[0]) == subject.language[1] if subject.language else None
        texts = matching.one_text(tables[subject.text_table], subject.key, subject.text, language)
        latest = matching.latest_delivery(tables[subject.table], subject.key, "load_no", "loaded_at")
        subjects = latest.join(texts, subject.key, "left")
        out = decisions.excluded_records(found, targets).select(F.regexp_replace(rules.subject_key(F.col("record_id"), [subject.key]), f"^{subject.key}=", "").alias("key")).distinct() if targets else None
        cands = stage(matching.candidates(subjects, subject.key, "text", settings, out), "candidates")
        pairs = stage(matching.banded(matching.class_pairs(cands, settings), settings, shift), "pairs")
        members = stage(matching.clusters(cands, pairs, copies=True), "members")
        filled = matching.completeness(latest, subject.key, subject.fields or tuple(tables[subject.table].columns), subject.mandatory)
        kept = stage(matching.survivors(members, filled, cands), "kept")
        held = matching.held_back(cands)
        numbers = cands.agg(F.count_if(F.col("reason").isNull()), F.count_if(F.col("reason").isNotNull())).first()
        own["Uniqueness"] = (numbers[0], numbers[1])
        found = found.unionByName(matching.duplicate_findings(members, kept, subject.table, subject.key))
    return Assessment(found, scorecard.scorecard(found, records, own=own), decisions.actions(found, mandatory), pairs, members, kept, held, shift)
