"""Retrieval of rule templates for observed fields, and the confidence of a suggestion."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.operators.ir import Comparison, Rule
from tallgrass.operators.reference import plain
from tallgrass.plans.lookup import broadcast_if_small

TEMPLATE = (
    "template_id string, target_table string, target_field string, field_role string, strength string, population_min double, reference_match_min double, "
    "distinct_min long, distinct_max long, type_hint string, max_value_length int"
)
OBSERVATION = "table_name string, field_name string, role_candidates array<string>, population double, reference_match_rate double, distinct_count long, type_hint string, max_value_length int, populated_count long"

# The rate below which a template is excluded, and the weights of prior, support and coverage.
RATE_FLOOR = 0.80
WEIGHTS = (0.4, 0.4, 0.2)

# How the profiler's hints are called in templates, how strong a prior is, and how well so many values cover a field.
HINTS = {"categorical": "categorical_string", "constant": "categorical_string", "key": "identifier", "numeric_text": "numeric", "free_text": "free_text"}
STRENGTHS = {"strong": 1.0, "moderate": 0.6, "weak": 0.3}
COVERAGE = [(1000, 1.0), (200, 0.8), (50, 0.6), (10, 0.4)]


def _case(column: Column, pairs, default) -> Column:
    out = None
    for k, v in pairs:
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out.otherwise(default)


def hint_name(hint: Column) -> Column:
    return _case(hint, HINTS.items(), F.lit(None).cast("string"))


def prior(strength: Column) -> Column:
    return _case(strength, STRENGTHS.items(), 0.3)


def coverage(populated: Column) -> Column:
    out = None
    for least, score in COVERAGE:
        out = F.when(populated >= least, score) if out is None else out.when(populated >= least, score)
    return out.otherwise(0.2)


def confidence(s_prior: Column, s_support: Column, s_coverage: Column, weights: tuple[float, float, float] = WEIGHTS) -> Column:
    total = weights[0] * s_prior + weights[1] * s_support + weights[2] * s_coverage
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4)


def retrieve(observations: DataFrame, templates: DataFrame, floor: float = RATE_FLOOR) -> DataFrame:
    """(table_name, field_name, template_id, bound_by, match_score, place): templates that fit each field, best first.

    A template binds by explicit field, else by role, else to the whole table. A rate it asks for that was
    observed below ``floor`` excludes it; what wasn't observed never does. Equal scores rank by descending id.
    Observations and templates are lists of fields and rules, not data.
    """
    o, t = observations.alias("o"), broadcast_if_small(templates).alias("t")
    c = F.col
    bound = (
        F.when(c("t.target_field").isNotNull(), F.when(c("t.target_field") == c("o.field_name"), "field"))
        .when(c("t.field_role").isNotNull(), F.when(F.array_contains(c("o.role_candidates"), c("t.field_role")), "role"))
        .otherwise("table")
    )
    passes = lambda need, seen: need.isNull() | seen.isNull() | (seen >= floor)
    fits = (c("t.target_table") == "ANY") | (c("t.target_table") == c("o.table_name"))
    gates = passes(c("t.population_min"), c("o.population")) & passes(c("t.reference_match_min"), c("o.reference_match_rate"))
    joined = o.join(t, fits & bound.isNotNull() & gates)
    # The points of each sign.
    add = lambda when, points: F.when(F.coalesce(when, F.lit(False)), points).otherwise(0.0)
    d, low, high = c("o.distinct_count"), c("t.distinct_min"), c("t.distinct_max")
    inside = (low.isNull() | (d >= low)) & (high.isNull() | (d <= high))
    band = F.when(d.isNull() | (low.isNull() & high.isNull()), 0.0).when(inside, 0.10).otherwise(-0.05)
    score = (
        0.5 + add(c("o.population") >= c("t.population_min"), 0.10) + add(c("o.reference_match_rate") >= c("t.reference_match_min"), 0.20) + band
        + add(c("t.type_hint") == c("o.type_hint"), 0.05) + add(c("o.max_value_length") <= c("t.max_value_length"), 0.05)
    )
    from pyspark.sql import Window

    found = joined.select(c("o.table_name"), c("o.field_name"), c("t.template_id"), bound.alias("bound_by"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("match_score"),
                          c("t.strength").alias("strength"), c("o.populated_count").alias("populated_count"))
    place = F.row_number().over(Window.partitionBy("table_name", "field_name").orderBy(F.desc("match_score"), F.desc("template_id")))
    return found.withColumn("place", place)


def suggest(observations: DataFrame, templates: DataFrame, infer: Callable[[dict], dict | None] | None = None, most_fields: int = 10_000) -> tuple[DataFrame, list[dict]]:
    """(bank matches with their confidence, inferred suggestions for fields no template fits)."""
    got = retrieve(observations, templates)
    rated = got.withColumn("confidence", confidence(prior(F.col("strength")), F.col("match_score"), coverage(F.coalesce("populated_count", F.lit(0)))))
    open_ = observations.join(got.select("table_name", "field_name").distinct(), ["table_name", "field_name"], "left_anti")
    inferred = [x for x in (infer(r.asDict()) for r in open_.limit(most_fields).collect()) if x] if infer else []  # a list of fields
    return rated, inferred


def observe(profile: DataFrame, table: str, roles: DataFrame) -> DataFrame:
    """Observations from a profile (see ``profile.profile``) and (field_name, role) pairs; a field without role is unknown."""
    listed = roles.groupBy("field_name").agg(F.array_sort(F.collect_set("role")).alias("role_candidates"))  # a few roles a field
    return profile.join(F.broadcast(listed), "field_name", "left").select(
        F.lit(table).alias("table_name"), "field_name", F.coalesce("role_candidates", F.array(F.lit("unknown"))).alias("role_candidates"), (F.col("populated_pct") / 100).alias("population"),
        F.lit(None).cast("double").alias("reference_match_rate"), F.col("distinct_count"), hint_name(F.col("type_hint")).alias("type_hint"),
        F.col("max_length").cast("int").alias("max_value_length"), F.col("populated_count"),
    )


def reference_evidence(df: DataFrame, listed: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """(field_name, list_name, n_values, n_matched, reference_match_rate): how well each field fits its reference list.

    ``fields`` names the list of each field. One scan for all fields; a list that isn't loaded gives no rate.
    """
    cells = F.array(*[F.struct(F.lit(f).alias("field_name"), F.lit(t).alias("list_name"), plain(F.col(f)).alias("value")) for f, t in fields.items()])
    counts = df.select(F.inline(cells)).where("value <> ''").groupBy("field_name", "list_name", "value").agg(F.count(F.lit(1)).alias("n"))
    known = listed.select(F.col("table_name").alias("list_name"), "value", F.lit(True).alias("hit")).distinct()
    loaded = listed.select(F.col("table_name").alias("list_name"), F.lit(True).alias("loaded")).distinct()
    got = counts.join(known, ["list_name", "value"], "left").groupBy("field_name", "list_name").agg(F.sum("n").alias("n_values"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("n_matched"))
    rate = F.when(F.col("loaded"), F.col("n_matched") / F.col("n_values"))
    return got.join(F.broadcast(loaded), "list_name", "left").select("field_name", "list_name", "n_values", "n_matched", rate.alias("reference_match_rate"))  # a row per list


def with_evidence(observations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Observations with the reference rates that were measured; a list of fields."""
    rates = evidence.select("field_name", F.col("reference_match_rate").alias("__rate"))
    return observations.join(F.broadcast(rates), "field_name", "left").withColumn("reference_match_rate", F.coalesce("__rate", "reference_match_rate")).select(observations.columns)


def interpret(observations: DataFrame, program: Callable[[dict], Sequence[str]], known: Sequence[str], most_fields: int = 10_000) -> DataFrame:
    """Observations whose role candidates ``program`` names, field by field; a role that isn't ``known`` is dropped, none is unknown."""
    rows = [r.asDict() for r in observations.limit(most_fields).collect()]  # a list of fields
    for r in rows:
        r["role_candidates"] = [x for x in program(r) if x in known] or ["unknown"]
    return observations.sparkSession.createDataFrame([tuple(r[c] for c in observations.columns) for r in rows], observations.schema)


def assemble_rule(template: Mapping[str, Any], table: str, field: str, domain: Sequence[str] = ()) -> Rule:
    """The rule that a bank's template, or an inferred suggestion, makes of a field: executable if it has all it needs."""
    kind = template.get("archetype", "not_null")
    if kind == "not_null":
        test, ready = Comparison(field, "is_not_null"), True
    elif kind in ("domain_in", "reference_exists"):
        test, ready = Comparison(field, "in", tuple(domain)), bool(domain)
    elif kind == "format_regex":
        test, ready = Comparison(field, "matches", template.get("pattern", "")), bool(template.get("pattern"))
    else:
        raise ValueError(f"a {kind} rule can't be made of one field")
    return Rule(f"{template['template_id']}_{table}_{field}".upper(), table, kind, test, name=template.get("name", ""), severity=template.get("severity", "Medium"), domain=tuple(domain), executable=ready)


def derive_templates(catalogue: DataFrame) -> DataFrame:
    """Templates from a rule list (rule_id, table_name, field_name, archetype, n_domain): what each rule asks of a field."""
    n, kind = F.col("n_domain"), F.col("archetype")
    # The shares and the most values that rules of each kind ask for.
    listed = kind.isin("domain_in", "reference_exists")
    return catalogue.select(
        F.col("rule_id").alias("template_id"), F.col("table_name").alias("target_table"), F.col("field_name").alias("target_field"), F.lit(None).cast("string").alias("field_role"),
        F.lit("moderate").alias("strength"), F.when(kind == "not_null", 0.98).when(kind == "domain_in", 0.90).alias("population_min"),
        F.when(kind == "reference_exists", 0.90).alias("reference_match_min"), F.when(listed, F.lit(1)).cast("long").alias("distinct_min"),
        F.when(listed & (n > 0), F.greatest(3 * n, n + 5)).cast("long").alias("distinct_max"), F.when(listed, "categorical_string").alias("type_hint"), F.lit(None).cast("int").alias("max_value_length"),
    )


def classify_expression(text: Column, lookup: Column | None = None) -> Column:
    """The archetype of a rule written as an expression, with the reference table it names, if any.

    Fixed values: the marks of each kind, in the order in which they decide.
    """
    text = F.coalesce(text, F.lit(""))
    params = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\$P_I_\w+)"), F.lit(1))))
    listed = F.coalesce(~F.trim(lookup).isin("", "."), F.lit(False)) if lookup is not None else F.lit(False)
    return (
        F.when(params > 1, "cross_field").when(F.contains(text, F.lit("exists(")) | listed, "reference_exists").when(text.rlike(r"(?i)\bIN\b\s*\([^)]*\)"), "domain_in")
        .when(F.contains(F.upper(text), F.lit("IS NOT NULL")), "not_null").when(F.contains(text, F.lit("match_regex")) | F.contains(text, F.lit("match_pattern")), "format_regex")
        .when(F.trim(text) != "", "cross_field").otherwise("other")
    )


def listed_values(text: Column) -> Column:
    """The quoted values of the first IN list of an expression."""
    return F.regexp_extract_all(F.regexp_extract(text, r"(?i)\bIN\b\s*\(([^)]*)\)", 1), F.lit(r"'([^']*)'"), F.lit(1))
