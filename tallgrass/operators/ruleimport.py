"""Rules from a workbook's rows, rule templates from a bank's files, and what an import brought in."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.operators.ir import ARCHETYPES, LABELS, Comparison, Rule
from tallgrass.operators.rulebank import TEMPLATE, classify_expression, listed_values
from tallgrass.operators.schema import Schema

# The sheet of the rule workbook and the places of its columns, counted from 0.
SHEET = "Consolidated"
COLUMNS = {"name": 15, "new_name": 16, "doc": 17, "label": 18, "table": 21, "field": 22, "lookup": 24, "expression": 26}
NO_LOOKUP = ("", ".")


@dataclass(frozen=True)
class Imported:
    rules: tuple[Rule, ...]
    notes: dict[str, str]
    deferred: tuple[dict[str, str], ...]


def workbook_rows(sheet_rows: Iterable[Sequence[Any]]) -> list[dict[str, str | None]]:
    """The named cells of a workbook's rows (without the header); blank cells are None."""
    out = []
    for row in sheet_rows:
        cell = lambda k: str(row[k]).strip() or None if k < len(row) and row[k] is not None else None  # noqa: E731, B023
        out.append({n: cell(k) for n, k in COLUMNS.items()})
    return out


def single_field(text: str | None) -> str | None:
    """The one field that a cell names; None for none or several."""
    names = re.split(r"[\s,]+", text.strip(" ,\n")) if text else []
    return names[0] if len(names) == 1 and names[0] else None


def classified(spark: SparkSession, rows: Sequence[Mapping[str, str | None]]) -> DataFrame:
    """The rows with ``archetype`` and ``listed``, the values of an IN list."""
    schema = "n int, " + ", ".join(f"{c} string" for c in COLUMNS)
    df = spark.createDataFrame([(i, *[r.get(c) for c in COLUMNS]) for i, r in enumerate(rows)], schema)
    return df.withColumns({"archetype": classify_expression(F.col("expression"), F.col("lookup")), "listed": listed_values(F.coalesce("expression", F.lit("")))})


def import_rules(spark: SparkSession, rows: Sequence[Mapping[str, str | None]], schemas: Mapping[str, Schema]) -> Imported:
    """Rules of the tables of ``schemas``; what can't be built on one field is deferred, with the reason.

    A rule on a field its schema doesn't declare, or on a list that isn't known, is kept but not executable.
    Workbook rows are a list of rules, not data.
    """
    rules: list[Rule] = []
    notes: dict[str, str] = {}
    deferred: list[dict[str, str]] = []
    for r in classified(spark, rows).orderBy("n").collect():
        if r["table"] not in schemas:
            continue
        s, name = schemas[r["table"]], r["new_name"] or r["name"] or "UNNAMED_RULE"
        kind, field = r["archetype"], single_field(r["field"])
        if kind in ("cross_field", "format_regex", "other") or field is None:
            why = "names no single field" if kind not in ("cross_field", "format_regex", "other") else f"{kind} expressions are written by hand"
            deferred.append({"table": r["table"], "name": name, "reason": why})
            continue
        declared = s.field(field)
        note, domain, severity = None if declared else "the field isn't declared", (), "Medium"
        if kind == "not_null":
            test = Comparison(field, "is_not_null")
            severity = "High" if declared and declared.mandatory else severity
        else:
            domain = tuple(r["listed"]) if kind == "domain_in" else s.domain(field)
            test = Comparison(field, "in", domain)
            if not domain:
                note = "the listed values can't be read" if kind == "domain_in" else "the field has no list of its own; take it from the reference table"
        rule_id = f"IS_{r['table']}_{field}_{kind}".upper()
        rules.append(Rule(rule_id, r["table"], kind, test, name=name, severity=severity, label=r["label"], domain=domain, executable=note is None))
        if note:
            notes[rule_id] = note
    return Imported(tuple(rules), notes, tuple(deferred))


def import_report(spark: SparkSession, got: Imported) -> DataFrame:
    """(table_name, archetype, dimension, imported, executable, dormant) of the rules that came in."""
    counts = Counter((r.table, r.archetype, r.dimension, r.executable) for r in got.rules)
    rows = [(*k[:3], n, n if k[3] else 0, 0 if k[3] else n) for k, n in counts.items()]
    df = spark.createDataFrame(rows, "table_name string, archetype string, dimension string, imported long, executable long, dormant long")
    return df.groupBy("table_name", "archetype", "dimension").agg(*[F.sum(c).alias(c) for c in ("imported", "executable", "dormant")])


def save_rules(got: Imported, folder: str | Path) -> None:
    """A YAML file of rules per table, and a JSON report."""
    import yaml

    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    by_table: dict[str, list[Rule]] = {}
    for r in got.rules:
        by_table.setdefault(r.table, []).append(r)
    for table, rules in by_table.items():
        listed = [
            {"rule_id": r.rule_id, "table": r.table, "archetype": r.archetype, "name": r.name, "severity": r.severity, "label": r.label, "executable": r.executable, "domain": list(r.domain),
             "assertion": {"field": r.assertion.field, "op": r.assertion.op, "value": list(r.assertion.value or ()) or None}}
            for r in rules
        ]
        (folder / f"{table.lower()}_rules.yaml").write_text(yaml.safe_dump({"table": table, "rule_count": len(listed), "rules": listed}, sort_keys=False, allow_unicode=True))
    (folder / "_import_report.json").write_text(json.dumps({"imported": len(got.rules), "dormant": got.notes, "deferred": list(got.deferred)}, indent=2))


def dimension_of(label: str | None, archetype: str) -> str:
    """A rule's dimension: by its archetype, else by the workbook's label, else Validity."""
    return ARCHETYPES.get(archetype) or LABELS.get(label or "", "Validity")


def load_bank(spark: SparkSession, folder: str | Path, roles_file: str = "field_roles.yaml") -> tuple[DataFrame, list[str]]:
    """(templates, role names) of a folder of YAML files; every file but the roles' holds a list ``templates``.

    Rates must lie in [0, 1], strengths and distinct ranges must make sense; the first fault is raised.
    """
    import yaml

    folder, names = Path(folder), [c.strip().split()[0] for c in TEMPLATE.split(",")]
    roles_path = folder / roles_file
    roles = sorted((yaml.safe_load(roles_path.read_text()) or {}).get("roles", [])) if roles_path.exists() else []
    rows = []
    for path in sorted(folder.glob("*.yaml")):
        if path.name == roles_file:
            continue
        for t in (yaml.safe_load(path.read_text()) or {}).get("templates", []):
            if t.get("strength", "weak") not in ("strong", "moderate", "weak"):
                raise ValueError(f"{t['template_id']}: unknown strength {t['strength']!r}")
            if any(not 0 <= t[k] <= 1 for k in ("population_min", "reference_match_min") if t.get(k) is not None):
                raise ValueError(f"{t['template_id']}: a rate lies outside [0, 1]")
            if t.get("field_role") and roles and t["field_role"] not in roles:
                raise ValueError(f"{t['template_id']}: unknown role {t['field_role']!r}")
            rows.append(tuple({"target_table": "ANY", "strength": "weak", **t}.get(n) for n in names))
    return spark.createDataFrame(rows, TEMPLATE), roles
