"""Findings: which records break which rules.

All rules of a table are tested in one scan. Each row yields the numbers of the rules it breaks; only
broken rows are unfolded, and what is fixed per rule is looked up from the rule list afterwards, so the
scanned projection stays small whatever the number of rules.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.operators.compile import violated
from tallgrass.operators.ir import Rule

FINDING = ["dimension", "table_name", "record_id", "field", "rule_id", "issue", "severity", "confidence", "observed_value", "expected", "metadata"]
_RULE = "n int, dimension string, field string, rule_id string, rule_name string, archetype string, severity string, single boolean, expected array<string>"


def record_id(keys: Sequence[str]) -> Column:
    """A business key as K1=v1|K2=v2; a null part is written None."""
    return F.concat_ws("|", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("None"))) for k in keys])


def subject_key(record: Column, keys: Sequence[str]) -> Column:
    """The parts of a business key that belong to ``keys``; the key as it is if none does."""
    parts = F.filter(F.split(record, r"\|"), lambda x: F.substring_index(x, "=", 1).isin(*keys))
    return F.when(F.size(parts) > 0, F.array_join(parts, "|")).otherwise(record)


def _expected(r: Rule) -> list[str]:
    return list(r.domain) if r.archetype in ("domain_in", "reference_exists") else ["non-null"] if r.archetype == "not_null" else []


def run_rules(df: DataFrame, table: str, keys: Sequence[str], rules: Iterable[Rule]) -> DataFrame:
    """Findings of all executable ``rules`` for ``table``; a rule one of whose fields is lacking finds nothing.

    Repeated rule ids and repeated rows give repeated findings. The order of rows is not defined.
    """
    spark, have = df.sparkSession, set(df.columns)
    usable = [r for r in rules if r.table == table and r.executable and set(r.fields) <= have]
    listed = spark.createDataFrame(
        [(i, r.dimension, r.field_name, r.rule_id, r.name or r.rule_id, r.archetype, r.severity, len(r.fields) == 1, _expected(r)) for i, r in enumerate(usable)], _RULE
    )
    if not usable:
        broken = df.select(F.lit(0).alias("n"), F.lit("").alias("record_id"), F.lit(None).cast("string").alias("value"), F.create_map().cast("map<string,string>").alias("metadata")).limit(0)
    else:
        hits = F.filter(F.array(*[F.when(violated(r.assertion, r.scope, df.schema), F.lit(i)) for i, r in enumerate(usable)]), lambda x: x.isNotNull())
        text = lambda c: F.col(f"`{c}`").cast("string")
        of = {c: i for i, c in enumerate(dict.fromkeys(f for r in usable for f in r.fields))}
        rows = df.select(record_id(keys).alias("record_id"), F.array(*[text(c) for c in of]).alias("values"), hits.alias("hits")).where(F.size("hits") > 0)
        names = spark.createDataFrame([(i, [of[f] for f in r.fields], list(r.fields)) for i, r in enumerate(usable)], "n int, places array<int>, names array<string>")
        # Both joined lists have a row per rule.
        broken = (
            rows.select("record_id", "values", F.explode("hits").alias("n")).join(F.broadcast(names), "n")
            .select("n", "record_id", F.get("values", F.col("places")[0]).alias("value"),
                    F.map_from_arrays("names", F.transform("places", lambda i: F.get("values", i))).alias("metadata"))
        )
    quoted = F.when(F.col("value").isNull(), "None").otherwise(F.concat(F.lit("'"), F.col("value"), F.lit("'")))
    issue = (
        F.when(F.col("archetype") == "not_null", F.concat(F.lit("mandatory field "), F.element_at(F.split("field", ","), 1), F.lit(" is empty")))
        .when(F.col("archetype").isin("domain_in", "reference_exists"), F.concat(F.element_at(F.split("field", ","), 1), F.lit("="), quoted, F.lit(" is outside the permitted domain")))
        .when(F.col("archetype") == "cross_field", F.concat(F.lit("cross-field rule '"), F.col("rule_name"), F.lit("' not satisfied")))
        .otherwise(F.concat(F.lit("rule '"), F.col("rule_name"), F.lit("' violated")))
    )
    return broken.join(F.broadcast(listed), "n").select(
        "dimension", F.lit(table).alias("table_name"), "record_id", "field", "rule_id", issue.alias("issue"), "severity",
        F.lit(1.0).alias("confidence"), F.when(F.col("single"), F.col("value")).alias("observed_value"),
        F.when(F.size("expected") > 0, F.col("expected")).alias("expected"), "metadata",
    )


def select_rules(rules: Iterable[Rule], dimension: str) -> list[Rule]:
    """The executable rules of one dimension: what the agent of that dimension runs."""
    return [r for r in rules if r.executable and r.dimension == dimension]


def run_ruleset(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]], rules: Iterable[Rule]) -> DataFrame:
    """Findings over all tables that have rules; a table without frame or key is passed over."""
    rules = list(rules)
    out = None
    for table in dict.fromkeys(r.table for r in rules):
        if table in tables and table in keys:
            part = run_rules(tables[table], table, keys[table], rules)
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no rule has a table")
    return out


def by_table(findings: DataFrame) -> DataFrame:
    return findings.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_findings"))


def by_field(findings: DataFrame) -> DataFrame:
    return findings.groupBy("table_name", "field").agg(F.count(F.lit(1)).alias("n_findings"))


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n_findings"))




def examples(findings: DataFrame, each: int = 3) -> DataFrame:
    """The first findings of each dimension, by rule and record."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("dimension").orderBy("rule_id", "record_id"))
    return findings.withColumn("place", place).where(F.col("place") <= each)
