"""Rules and the small typed predicate tree they are written in."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

COMPARISONS = ("is_null", "is_not_null", "in", "not_in", "eq", "ne", "matches", "gt", "ge", "lt", "le")
UNKNOWN = "unknown"
BOOLEANS = ("and", "or", "not", "implies")
ARCHETYPES = {"not_null": "Completeness", "domain_in": "Validity", "reference_exists": "Validity", "format_regex": "Validity", "cross_field": "Consistency"}
LABELS = {"Completeness": "Completeness", "Consistency": "Validity", "Conformity": "Validity", "Accuracy": "Validity"}
SEVERITIES = {"Critical": 4, "High": 3, "Medium": 2, "Low": 1}


@dataclass(frozen=True)
class Comparison:
    field: str
    op: str
    value: Any = None

    def __post_init__(self):
        if self.op not in (*COMPARISONS, UNKNOWN):
            raise ValueError(f"unknown comparison {self.op!r}")
        if self.op in ("in", "not_in"):
            object.__setattr__(self, "value", tuple(self.value or ()))


@dataclass(frozen=True)
class Bool:
    op: str
    args: tuple[Comparison | Bool, ...]

    def __post_init__(self):
        object.__setattr__(self, "args", tuple(self.args))
        if self.op not in BOOLEANS:
            raise ValueError(f"unknown operator {self.op!r}")
        least, most = {"not": (1, 1), "implies": (2, 2)}.get(self.op, (1, None))
        if len(self.args) < least or most is not None and len(self.args) > most:
            raise ValueError(f"{self.op} takes {least}{'' if most == least else ' or more'} arguments, got {len(self.args)}")


Predicate = Comparison | Bool


def fields_of(p: Predicate | None) -> list[str]:
    """Field names in order of appearance, each once."""
    if p is None:
        return []
    if isinstance(p, Comparison):
        return [p.field]
    return list(dict.fromkeys(f for a in p.args for f in fields_of(a)))


def predicate(raw: Mapping[str, Any], strict: bool = True) -> Predicate:
    """A predicate from nested mappings with ``field``/``op``/``value`` or ``op``/``args``.

    A comparison that isn't known is an error; where rules of others are read that needn't be, ``strict`` off
    makes it unknown for every row, so that it breaks no record.
    """
    if "args" in raw:
        return Bool(raw["op"], tuple(predicate(a, strict) for a in raw["args"]))
    if not strict and raw["op"] not in COMPARISONS:
        return Comparison(raw["field"], UNKNOWN)
    return Comparison(raw["field"], raw["op"], raw.get("value"))


@dataclass(frozen=True)
class Rule:
    rule_id: str
    table: str
    archetype: str
    assertion: Predicate
    scope: Predicate | None = None
    name: str = ""
    severity: str = "Medium"
    label: str | None = None
    domain: tuple[str, ...] = ()
    executable: bool = True
    fields: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if self.severity not in SEVERITIES:
            raise ValueError(f"unknown severity {self.severity!r}")
        if not self.fields:
            object.__setattr__(self, "fields", tuple(fields_of(self.assertion)))

    @property
    def dimension(self) -> str:
        """What the shape of the rule tests decides; only an unknown shape falls back to its label, then to Validity."""
        return ARCHETYPES.get(self.archetype) or LABELS.get(self.label or "", "Validity")

    @property
    def field_name(self) -> str:
        return ",".join(self.fields)


def rule(raw: Mapping[str, Any], strict: bool = True) -> Rule:
    return Rule(
        rule_id=raw["rule_id"], table=raw["table"], archetype=raw.get("archetype", "other"), assertion=predicate(raw["assertion"], strict),
        scope=predicate(raw["scope"], strict) if raw.get("scope") else None, name=raw.get("name", ""), severity=raw.get("severity", "Medium"),
        label=raw.get("label"), domain=tuple(raw.get("domain") or ()), executable=bool(raw.get("executable", True)), fields=tuple(raw.get("fields") or ()),
    )


def load_rules(folder: str | Path, strict: bool = True) -> list[Rule]:
    """Rules of all YAML files of a folder that have a list ``rules``, by file name."""
    import yaml

    out = []
    for path in sorted(Path(folder).glob("*.yaml")):
        out += [rule(r, strict) for r in (yaml.safe_load(path.read_text()) or {}).get("rules", [])]
    return out


def repeated_ids(rules: Iterable[Rule]) -> list[str]:
    seen: dict[str, int] = {}
    for r in rules:
        seen[r.rule_id] = seen.get(r.rule_id, 0) + 1
    return sorted(k for k, n in seen.items() if n > 1)
