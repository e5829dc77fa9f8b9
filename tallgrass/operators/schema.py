"""Declared schemas: fields with roles and types, keys, and how duplicates are looked for.

A schema is a list of fields, not data: it lives on the driver as dataclasses, is read from YAML or from a
declared table, and is written back. A draft can be made from the profile of a table nobody has declared yet.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.functions import values
from tallgrass.operators import profile as profiles
from tallgrass.operators.matching import Matching

# The semantic types of fields.
TYPES = ("key", "client", "lang", "code", "flag", "text", "quantity", "integer", "date")


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "text"
    role: str = "unknown"
    mandatory: bool = False
    domain: tuple[str, ...] = ()
    populated_pct: float | None = None
    description: str = ""
    pattern: str | None = None

    def __post_init__(self):
        if self.type not in TYPES:
            raise ValueError(f"{self.name}: unknown type {self.type!r}; known: {', '.join(TYPES)}")


@dataclass(frozen=True)
class Compared:
    """A field whose wording is compared: ``field`` or ``table.field``, with its weight."""

    field: str
    weight: float = 1.0

    def __post_init__(self):
        if self.weight <= 0:
            raise ValueError(f"{self.field}: a compared field's weight must be above 0")


@dataclass(frozen=True)
class Uniqueness:
    compare: tuple[Compared, ...]
    settings: Matching

    def shares(self) -> dict[str, float]:
        """The weights of the compared fields, brought to a sum of 1."""
        total = sum(c.weight for c in self.compare)
        return {c.field: c.weight / total for c in self.compare}


@dataclass(frozen=True)
class Schema:
    table: str
    key: tuple[str, ...]
    fields: tuple[Field, ...]
    uniqueness: Uniqueness | None = None
    no_date: tuple[str, ...] = tuple(values.NO_DATE)
    description: str = ""

    def __post_init__(self):
        names = [f.name for f in self.fields]
        if len(set(names)) < len(names):
            raise ValueError(f"{self.table}: a field is declared twice")
        if lacking := [k for k in self.key if k not in names]:
            raise ValueError(f"{self.table}: key fields {lacking} aren't declared")

    def field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def domain(self, name: str) -> tuple[str, ...]:
        f = self.field(name)
        return f.domain if f else ()

    @property
    def mandatory(self) -> list[str]:
        return [f.name for f in self.fields if f.mandatory]

    def missing(self, name: str) -> Column:
        """Whether a field's value says nothing: null, blank or a stand-in for no date."""
        return values.missing_or_blank(F.col(name), self.no_date)

    def typed(self, df: DataFrame) -> DataFrame:
        """``df`` with quantities and integers of text as numbers and dates of text as dates; other columns as they are."""
        text = {c for c, t in df.dtypes if t == "string"}
        as_type = {"quantity": values.quantity, "integer": lambda c: F.trim(c).try_cast("double"), "date": lambda c: values.day(c, self.no_date)}
        return df.withColumns({f.name: as_type[f.type](F.col(f.name)) for f in self.fields if f.name in text and f.type in as_type} or {"__none": F.lit(None)}).drop("__none")


def resolve_compared(table: str, field: str) -> tuple[str, str]:
    """(table, field) of ``table.field``, or of a field of ``table`` itself."""
    named, dot, rest = field.partition(".")
    return (named, rest) if dot else (table, named)


def _uniqueness(raw: Mapping[str, Any]) -> Uniqueness:
    if "blocking_key" in raw:
        raise ValueError("blocking_key is no longer read; write a list blocking_keys")
    compare = tuple(Compared(c) if isinstance(c, str) else Compared(c["field"], float(c.get("weight", 1.0))) for c in raw.get("compare_fields") or [])
    fuzzy, semantic = (raw.get("methods") or {}).get("fuzzy") or {}, (raw.get("methods") or {}).get("semantic") or {}
    bands, veto = raw.get("bands") or {}, raw.get("attribute_veto") or {}
    most = raw.get("max_block_pairs")
    how = {
        "block": tuple(raw.get("blocking_keys") or ()), "metric": fuzzy.get("metric", "jaro_winkler"), "fuzzy_weight": float(fuzzy.get("weight", 1.0)), "semantic_weight": float(semantic.get("weight", 0.0)),
        "duplicate": float(bands.get("duplicate", 0.92)), "review_low": float(bands.get("review_low", 0.80)), "most_block_pairs": int(most) if most is not None else None,
        "veto_cap": float(veto.get("cap", 0.75)) if veto.get("enabled", True) else 1.0,
    }
    if veto.get("material_words") is not None:
        how["materials"] = tuple(veto["material_words"])
    return Uniqueness(compare, Matching(**how))


def schema(raw: Mapping[str, Any]) -> Schema:
    """A schema from nested mappings as its YAML file holds them."""
    fields = tuple(
        Field(n, f.get("type", "text"), f.get("role", "unknown"), bool(f.get("mandatory", False)), tuple(str(v) for v in f.get("domain") or ()), f.get("observed_population_pct"), f.get("description", ""), f.get("pattern"))
        for n, f in (raw.get("fields") or {}).items()
    )
    no_date = tuple((raw.get("formatting") or {}).get("null_date_sentinels") or values.NO_DATE)
    return Schema(raw["table"], tuple(raw.get("primary_key") or ()), fields, _uniqueness(raw["uniqueness"]) if raw.get("uniqueness") else None, no_date, raw.get("description", ""))


def load_schema(path: str | Path) -> Schema:
    import yaml

    return schema(yaml.safe_load(Path(path).read_text()))


def load_schemas(folder: str | Path, tables: Iterable[str] | None = None) -> dict[str, Schema]:
    """Schemas of a folder's YAML files by table: all of them, or those of ``tables``, which must be there."""
    found = {s.table: s for s in (load_schema(p) for p in sorted(Path(folder).glob("*.yaml")))}
    if tables is None:
        return found
    if lacking := sorted(set(tables) - set(found)):
        raise FileNotFoundError(f"no schema of {', '.join(lacking)}")
    return {t: found[t] for t in tables}


def to_mapping(s: Schema) -> dict[str, Any]:
    """The inverse of :func:`schema`."""
    out: dict[str, Any] = {"table": s.table, "description": s.description, "primary_key": list(s.key), "formatting": {"null_date_sentinels": list(s.no_date)}}
    if s.uniqueness:
        m = s.uniqueness.settings
        out["uniqueness"] = {
            "blocking_keys": list(m.block), "compare_fields": [{"field": c.field, "weight": c.weight} for c in s.uniqueness.compare],
            "methods": {"fuzzy": {"metric": m.metric, "weight": m.fuzzy_weight}, "semantic": {"weight": m.semantic_weight}}, "bands": {"duplicate": m.duplicate, "review_low": m.review_low},
            "max_block_pairs": m.most_block_pairs, "attribute_veto": {"enabled": True, "cap": m.veto_cap, "material_words": list(m.materials)},
        }
    out["fields"] = {f.name: {"type": f.type, "role": f.role, "mandatory": f.mandatory, "domain": list(f.domain), "observed_population_pct": f.populated_pct, "description": f.description, "pattern": f.pattern} for f in s.fields}
    return out


def save_schema(s: Schema, path: str | Path) -> None:
    import yaml

    Path(path).write_text(yaml.safe_dump(to_mapping(s), sort_keys=False, allow_unicode=True))


def from_spec(spec: DataFrame, keys: Mapping[str, Sequence[str]], bound: int = 20_000) -> dict[str, Schema]:
    """Schemas of a table of declared fields (tab_name, field_name, field_type, mandatory, format_re); its size is checked."""
    rows = spec.select("tab_name", "field_name", "field_type", "mandatory", "format_re").limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} declared fields")
    by_table: dict[str, list[Field]] = {}
    for r in rows:
        kind = r["field_type"] if r["field_type"] in TYPES else "text"
        by_table.setdefault(r["tab_name"], []).append(Field(r["field_name"], kind, kind, bool(r["mandatory"]), pattern=r["format_re"]))
    return {t: Schema(t, tuple(keys.get(t, ())), tuple(sorted(fs, key=lambda f: f.name))) for t, fs in by_table.items()}


def catalogue(spark: SparkSession, schemas: Iterable[Schema]) -> DataFrame:
    """(table_name, field_name, role, type, is_key, mandatory, n_domain): a row per declared field."""
    rows = [(s.table, f.name, f.role, f.type, f.name in s.key, f.mandatory, len(f.domain)) for s in schemas for f in s.fields]
    return spark.createDataFrame(rows, "table_name string, field_name string, role string, type string, is_key boolean, mandatory boolean, n_domain int")


def build(df: DataFrame, base: Schema, categories: int = profiles.CATEGORIES) -> Schema:
    """``base`` with what ``df`` shows of its fields: populated shares, and the domains of codes and flags of few values."""
    fields = [f.name for f in base.fields if f.name in df.columns]
    seen = {r["field_name"]: r for r in profiles.profile(df, fields, categories).collect()}  # a row per field
    coded = [f.name for f in base.fields if f.name in fields and f.type in ("code", "flag", "lang")]
    listed = {r["field_name"]: tuple(r["domain"]) for r in profiles.inferred_domains(df, coded, categories).collect()} if coded else {}
    return replace(base, fields=tuple(replace(f, populated_pct=seen[f.name]["populated_pct"], domain=f.domain or listed.get(f.name, ())) if f.name in seen else f for f in base.fields))


def rank_keys(candidates: Iterable[Sequence[str]], columns: Sequence[str]) -> list[tuple[str, ...]]:
    """Candidate keys, best first: those whose right-most column comes earliest, then the shorter, then by name."""
    place = {c: i for i, c in enumerate(columns)}
    return sorted((tuple(c) for c in candidates), key=lambda c: (max(place[x] for x in c), len(c), c))


def scaffold(df: DataFrame, table: str, roles: Mapping[str, str] | None = None, arity: int = 3) -> Schema:
    """A draft schema of a table nobody has declared: types from the profile, the best candidate key, full fields mandatory.

    A draft for a steward to edit; a field that is populated in every row is proposed as mandatory.
    """
    seen = {r["field_name"]: r for r in profiles.profile(df).collect()}  # a row per column
    keys = rank_keys(profiles.key_candidates(df, arity=arity), df.columns)
    key = keys[0] if keys else ()
    listed = {r["field_name"]: tuple(r["domain"]) for r in profiles.inferred_domains(df).collect()}
    kind = {"key": "key", "constant": "code", "categorical": "code", "numeric_text": "code", "free_text": "text"}
    fields = []
    for c in df.columns:
        p = seen[c]
        k = "key" if c in key else kind[p["type_hint"]] if p["type_hint"] != "key" else "text"
        fields.append(Field(c, k, (roles or {}).get(c, "key" if c in key else "unknown"), p["populated_count"] == p["n_rows"] > 0, listed.get(c, ()) if k == "code" else (), p["populated_pct"]))
    return Schema(table, key, tuple(fields))
