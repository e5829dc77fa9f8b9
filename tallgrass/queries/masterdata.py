"""Queries of the general problems on the master-data tables: skewed groups, units, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.functions import values
from tallgrass.operators import skewgroups, units, valuecounts
from tallgrass.plans.staging import stage
from tallgrass.queries.tables import table

# The columns of the tables, as declared.
FIELDS = {
    "mara": "mandt matnr ersda laeda ernam aenam lvorm mtart mbrsh matkl bismt meins bstme magrv raube tragr spart brgew ntgew gewei volum voleh wrkst".split(),
    "makt": "mandt matnr spras maktx maktg".split(),
    "marc": "mandt matnr werks pstat lvorm mmsta mmstd maabc ekgrp dismm dispo disls beskz sobsl minbe eisbe bstmi bstma bstfe mabst mtvfp perkz prctr ladgr stawn plifz webaz fhori xchpf".split(),
}


def _code(column: str) -> Column:
    return F.upper(F.trim(column)).alias(column)


def p3_figures(spark: SparkSession, folder: str) -> DataFrame:
    """Per combination: rows, materials, their net weights in grams, the latest day on which one was changed, share of all rows."""
    grams = p4_net_grams(spark, folder).select("matnr", F.col("grams").cast("double").alias("grams"))
    changed = values.calendar_day(F.col("laeda"), F.col("loaded_at"))
    # A material counts once in each combination it was delivered in, however often it was.
    once = table(spark, folder, "mara").select(_code("mtart"), _code("meins"), "matnr", changed.alias("changed")).groupBy("mtart", "meins", "matnr").agg(F.count(F.lit(1)).alias("n"), F.max("changed").alias("changed"))
    found = skewgroups.figures_by_key(once.join(grams, "matnr", "left"), ["mtart", "meins"], "matnr", "grams", "changed", rows="n")
    return found.select(
        "mtart", "meins", "n_rows", F.col("n_items").alias("n_materials"), F.round("value_sum", 1).alias("grams_sum"), F.col("n_valued").alias("n_weighed"),
        F.round("value_max", 6).alias("grams_max"), F.col("latest").cast("date").cast("string").alias("latest_change"), F.round("row_share", 9).alias("row_share"),
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    mara = table(spark, folder, "mara").select(_code("mtart"), _code("meins"), "matnr", F.lit(None).alias("value"), F.lit(None).alias("day"))
    return skewgroups.figures_by_key(mara, ["mtart", "meins"], "matnr", "value", "day").where("row_share > 0.05").select("mtart", "meins")


def p4_net_grams(spark: SparkSession, folder: str) -> DataFrame:
    return units.net_grams(table(spark, folder, "mara"), table(spark, folder, "makt"), table(spark, folder, "t006"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_net_grams(spark, folder).where("gewei is distinct from 'KG' and net_g > 0").select("matnr", "net_g")


def p4_converted(spark: SparkSession, folder: str) -> DataFrame:
    """Gross weights in kilograms and volumes in litres, each number with its own unit and target."""
    graph = units.UnitGraph(units.edges_from_units(table(spark, folder, "t006")))
    cell = lambda field, number, unit, target: F.struct(F.lit(field).alias("field"), units.amount(F.col(number)).alias("amount"), F.col(unit).alias("unit"), F.lit(target).alias("target"))
    cells = F.inline(F.array(cell("brgew", "brgew", "gewei", "KG"), cell("volum", "volum", "voleh", "L")))
    # Copies of a material agree in what is converted.
    once = table(spark, folder, "mara").select("matnr", "brgew", "gewei", "volum", "voleh").distinct().select("matnr", cells)
    got = units.convert(once, graph, "amount", "unit", "target")
    return got.select("matnr", "field", "unit", F.round(F.col("converted").cast("double"), 9).alias("converted"))


def _annotated(store: valuecounts.ValueCounts, fields: list) -> DataFrame:
    # Written once: the departures read the state several times, each a few of its columns.
    return stage(valuecounts.annotate(store.state(), fields), "value-counts")


def _state(spark: SparkSession, folder: str) -> DataFrame:
    fields = valuecounts.fields_of(table(spark, folder, "field_spec"))
    store = valuecounts.ValueCounts.kept(spark, *[f"{folder}/{t}.parquet" for t in [*FIELDS, "field_spec"]])
    return _annotated(valuecounts.bring_up_to_date(store, {t: table(spark, folder, t) for t in FIELDS}, fields), fields)


def p5_redelivered(spark: SparkSession, folder: str) -> DataFrame:
    """The profile after each load was delivered twice: what arrived within a day of its first row, then all of it."""
    fields = valuecounts.fields_of(table(spark, folder, "field_spec"))
    whole = {t: table(spark, folder, t) for t in FIELDS}
    prompt = {}
    for t, df in whole.items():
        began = df.groupBy("load_no").agg(F.min("loaded_at").alias("began"))  # a row per load
        prompt[t] = df.join(began, "load_no").where(F.col("loaded_at") <= F.col("began") + F.expr("interval 1 day")).select(df.columns)
    store = valuecounts.bring_up_to_date(valuecounts.ValueCounts.create(spark), prompt, fields)
    store = valuecounts.bring_up_to_date(store, whole, fields, again=True)
    return _rounded(valuecounts.profile(_annotated(store, fields), False), ["tab_name", "field_name"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return valuecounts.departures(_state(spark, folder))


def _rounded(got: DataFrame, by: list[str]) -> DataFrame:
    return got.select(*by, "n_rows", "populated_pct", "distinct_count", F.round("entropy", 6).alias("entropy"), "min_length", "max_length", "min_value", "max_value", "violations", "repeated_rows")


def _profile(spark: SparkSession, folder: str, per_load: bool) -> DataFrame:
    return _rounded(valuecounts.profile(_state(spark, folder), per_load), ["tab_name", "field_name"] + (["load_no"] if per_load else []))


def p5_profile(spark: SparkSession, folder: str) -> DataFrame:
    return _profile(spark, folder, False)


def p5_profile_by_load(spark: SparkSession, folder: str) -> DataFrame:
    return _profile(spark, folder, True)


AMOUNT_SQL = r"""try_cast(replace(replace(nullif(regexp_extract({c}, '^\s*(\d{{1,3}}(?:\.\d{{3}})+(?:,\d+)?|\d+(?:,\d+)?)\s*([^\d\s].*?)?\s*$', 1), ''), '.', ''), ',', '.') AS decimal(15,6))"""

# Written apart from the operator's list, so that the comparison would show a spelling that it lacks.
SPELLINGS_SQL = {
    "MG": ["mg", "mgm", "milligram", "milligrams", "milligramm"], "G": ["g", "gr", "grm", "gm", "gms", "gram", "grams", "gramm", "gramme", "grammes"],
    "KG": ["kg", "kgm", "kgs", "kilo", "kilos", "kilogram", "kilograms", "kilogramm", "kilogramme"], "TO": ["to", "t", "ton", "tons", "tonne", "tonnes", "tonnen"],
    "LB": ["lb", "lbs", "lbm", "pound", "pounds"], "OZ": ["oz", "ozs", "ounce", "ounces", "unze", "unzen"],
}


def _p4_sql(found: bool) -> str:
    names = sorted((n, c) for c, ns in SPELLINGS_SQL.items() for n in ns)
    alias = ", ".join(f"('{n}', '{c}')" for n, c in names)
    alternatives = "|".join(n for n, _ in sorted(names, key=lambda x: (-len(x[0]), x[0])))
    text = rf"(?i)(?:^|[^\pL\d.,])(?:(\d+)\s*[x×*]\s*)?(\d+(?:[.,]\d+)?)[\s ]*({alternatives})(?:[^\pL\d]|$)"
    name = r"lower(regexp_replace({c}, '^[\s. ]+|[\s. ]+$', '', 'g'))"
    behind = r"""regexp_extract(ntgew, '^\s*(\d{1,3}(?:\.\d{3})+(?:,\d+)?|\d+(?:,\d+)?)\s*([^\d\s].*?)?\s*$', 2)"""
    last = "SELECT matnr, net_g FROM out WHERE gewei IS DISTINCT FROM 'KG' AND net_g > 0" if found else "SELECT matnr, gewei, source_unit, told_by, round(grams::double, 9) AS grams, net_g::double AS net_g FROM out"
    return f"""
WITH alias(name, code) AS (VALUES {alias}),
unit AS (SELECT lower(msehi) AS name, factor, base_unit FROM t006
         UNION SELECT a.name, t.factor, t.base_unit FROM alias a JOIN t006 t ON t.msehi = a.code),
one AS (SELECT DISTINCT matnr, gewei, ntgew, meins FROM mara WHERE matnr IS NOT NULL),
m AS (SELECT matnr, gewei, {AMOUNT_SQL.format(c="ntgew")} AS n, {name.format(c="gewei")} AS g, {name.format(c=behind)} AS u, {name.format(c="meins")} AS b FROM one),
said AS (SELECT matnr, min(maktx) AS maktx FROM makt WHERE spras = 'E' AND regexp_matches(maktx, '{text}') GROUP BY matnr),
told AS (
  SELECT m.matnr, gewei,
    CASE WHEN ug.name IS NOT NULL THEN g WHEN uu.name IS NOT NULL THEN u WHEN said.maktx IS NOT NULL THEN lower(regexp_extract(said.maktx, '{text}', 3)) WHEN ub.base_unit = 'KG' THEN b END AS source_unit,
    CASE WHEN ug.name IS NOT NULL THEN 'gewei' WHEN uu.name IS NOT NULL THEN 'ntgew' WHEN said.maktx IS NOT NULL THEN 'text' WHEN ub.base_unit = 'KG' THEN 'meins' END AS told_by,
    CASE WHEN ug.name IS NULL AND uu.name IS NULL AND said.maktx IS NOT NULL
         THEN (replace(regexp_extract(said.maktx, '{text}', 2), ',', '.')::decimal(12,6) * coalesce(nullif(regexp_extract(said.maktx, '{text}', 1), ''), '1')::decimal(6,0))::decimal(15,6)
         WHEN ug.name IS NULL AND uu.name IS NULL AND ub.base_unit IS DISTINCT FROM 'KG' THEN NULL ELSE n END AS amount
  FROM m LEFT JOIN unit ug ON ug.name = g LEFT JOIN unit uu ON uu.name = u LEFT JOIN unit ub ON ub.name = b LEFT JOIN said USING (matnr)),
out AS (SELECT matnr, gewei, source_unit, told_by, CASE WHEN base_unit = 'KG' THEN amount * (factor * 1000)::decimal(20,12) END AS grams,
        CASE WHEN base_unit = 'KG' THEN round(amount * (factor * 1000)::decimal(20,12), 0)::bigint END AS net_g
        FROM told LEFT JOIN unit ON unit.name = source_unit)
{last}"""


def _day_sql(c: str) -> str:
    t, d = f"trim({c}, ' ')", "\\d{1,2}"
    return (
        f"CASE WHEN regexp_full_match({t}, '{d}/{d}/\\d{{4}}') THEN try_strptime({t}, '%m/%d/%Y')::date WHEN regexp_full_match({t}, '{d}\\.{d}\\.\\d{{4}}') THEN try_strptime({t}, '%d.%m.%Y')::date "
        f"WHEN regexp_full_match({t}, '\\d{{4}}-{d}-{d}') THEN try_strptime({t}, '%Y-%m-%d')::date WHEN regexp_full_match({t}, '\\d{{8}}') THEN try_strptime({t}, '%Y%m%d')::date "
        f"WHEN regexp_full_match({t}, '\\d{{4}}/{d}/{d}') THEN try_strptime({t}, '%Y/%m/%d')::date END"
    )


P3_SQL = f"""
WITH m AS (SELECT upper(trim(mtart, ' ')) AS mtart, upper(trim(meins, ' ')) AS meins, matnr, {_day_sql("laeda")} AS day, loaded_at::date AS arrived FROM mara),
g AS ({_p4_sql(False)}),
o AS (SELECT mtart, meins, matnr, count(*) AS n, max(day) FILTER (day <= arrived) AS day FROM m GROUP BY ALL)
SELECT mtart, meins, sum(n)::bigint AS n_rows, count(o.matnr) AS n_materials, round(coalesce(sum(grams), 0), 1) AS grams_sum, count(grams) AS n_weighed, round(max(grams), 6) AS grams_max,
  max(day)::varchar AS latest_change, round(sum(n) / (SELECT count(*) FROM m), 9) AS row_share FROM o LEFT JOIN g ON g.matnr = o.matnr GROUP BY mtart, meins"""
P3_FOUND_SQL = "SELECT upper(trim(mtart, ' ')) AS mtart, upper(trim(meins, ' ')) AS meins FROM mara GROUP BY ALL HAVING count(*) > 0.05 * (SELECT count(*) FROM mara)"
P4_CONVERTED_SQL = f"""
WITH alias(name, code) AS (VALUES {", ".join(f"('{n}', '{c}')" for c, ns in SPELLINGS_SQL.items() for n in ns)}),
unit AS (SELECT lower(msehi) AS name, factor, base_unit FROM t006 UNION SELECT a.name, t.factor, t.base_unit FROM alias a JOIN t006 t ON t.msehi = a.code),
one AS (SELECT DISTINCT matnr, brgew, gewei, volum, voleh FROM mara),
c AS (SELECT matnr, 'brgew' AS field, {AMOUNT_SQL.format(c="brgew")} AS amount, gewei AS unit, 'KG' AS target FROM one UNION ALL SELECT matnr, 'volum', {AMOUNT_SQL.format(c="volum")}, voleh, 'L' FROM one)
SELECT matnr, field, c.unit AS unit, round(CASE WHEN base_unit = target THEN amount::double * factor END, 9) AS converted FROM c LEFT JOIN unit u ON u.name = lower(regexp_replace(c.unit, '^[\\s. ]+|[\\s. ]+$', '', 'g'))"""


def _cells_sql() -> str:
    """All cells of all tables as (tab_name, field_name, load_no, value)."""
    parts = []
    for tab, fields in FIELDS.items():
        key = {"mara": ["matnr"], "makt": ["matnr", "spras"], "marc": ["matnr", "werks"]}[tab]
        cells = ", ".join(f"struct_pack(field_name := '{f}', value := {f}::varchar)" for f in fields)
        joined = " || chr(31) || ".join(f"coalesce({k}, chr(1))" for k in key)
        parts.append(f"SELECT '{tab}' AS tab_name, load_no, unnest([{cells}, struct_pack(field_name := 'primary_key', value := {joined})], recursive := true) FROM {tab}")
    return " UNION ALL ".join(f"({p})" for p in parts)


COUNTS_SQL = f"""
cell AS ({_cells_sql()}),
counts AS (SELECT tab_name, field_name, load_no, value, count(*) AS n FROM cell GROUP BY ALL),
v AS (SELECT c.*, coalesce(trim(value, ' ') <> '', false) AS pop, regexp_full_match(value, f.format_re) AS fits, coalesce(f.tracked, false) AS tracked,
      CASE WHEN f.field_type = 'quantity' AND regexp_full_match(value, '-?\\d{{1,3}}(\\.\\d{{3}})*,\\d{{3}}') THEN replace(replace(value, '.', ''), ',', '.')::double
           WHEN f.field_type = 'integer' AND regexp_full_match(value, '[0-9]{{1,3}}') THEN value::double END AS number
      FROM counts c LEFT JOIN field_spec f USING (tab_name, field_name))"""


def _profile_sql(per_load: bool) -> str:
    by = "tab_name, field_name, load_no" if per_load else "tab_name, field_name"
    return f"""
WITH {COUNTS_SQL},
w AS (SELECT {by}, value, pop, fits, sum(n) AS n FROM v GROUP BY ALL),
t AS (SELECT {by}, sum(n) AS n_rows, coalesce(sum(n) FILTER (pop), 0) AS filled, count(*) FILTER (pop) AS d, sum(n * log2(n)) FILTER (pop) AS nlogn,
  coalesce(min(length(value)) FILTER (pop), 0) AS min_length, coalesce(max(length(value)) FILTER (pop), 0) AS max_length,
  min(value) FILTER (pop AND field_name <> 'primary_key') AS min_value, max(value) FILTER (pop AND field_name <> 'primary_key') AS max_value,
  coalesce(sum(n) FILTER (pop AND NOT fits), 0) AS violations, coalesce(sum(n) FILTER (field_name = 'primary_key' AND n > 1), 0) AS repeated_rows
  FROM w GROUP BY {by})
SELECT {by}, n_rows::bigint AS n_rows, round(100.0 * filled::double / n_rows, 2) AS populated_pct, d AS distinct_count,
  round(CASE WHEN filled > 0 THEN log2(filled) - nlogn / filled ELSE 0.0 END, 6) + 0.0 AS entropy, min_length, max_length, min_value, max_value,
  violations::bigint AS violations, repeated_rows::bigint AS repeated_rows FROM t"""


P5_SQL = f"""
WITH {COUNTS_SQL},
l AS (SELECT tab_name, field_name, load_no, sum(n) AS rows, coalesce(sum(n) FILTER (pop), 0) AS filled, coalesce(sum(n) FILTER (pop AND NOT fits), 0) AS bad
      FROM v WHERE field_name <> 'primary_key' GROUP BY ALL),
s AS (SELECT *, sum(rows) OVER fw - rows AS orows, sum(filled) OVER fw - filled AS ofilled FROM l WINDOW fw AS (PARTITION BY tab_name, field_name)),
c AS (SELECT tab_name, field_name, load_no, value, sum(n) AS n FROM v WHERE tracked AND pop GROUP BY ALL),
tot AS (SELECT tab_name, field_name, value, sum(n) AS total FROM c GROUP BY ALL),
grid AS (SELECT s.tab_name, s.field_name, s.load_no, tot.value, coalesce(c.n, 0) / s.filled AS p, (tot.total - coalesce(c.n, 0)) / s.ofilled AS q
         FROM s JOIN tot USING (tab_name, field_name) LEFT JOIN c USING (tab_name, field_name, load_no, value) WHERE s.filled >= 20 AND s.ofilled >= 20),
x AS (SELECT tab_name, field_name, load_no, number FROM v, generate_series(1, n) WHERE number > 0),
med AS (SELECT a.tab_name, a.field_name, a.load_no, (SELECT median(number) FROM x WHERE x.tab_name = a.tab_name AND x.field_name = a.field_name AND x.load_no = a.load_no) AS here,
        (SELECT median(number) FROM x WHERE x.tab_name = a.tab_name AND x.field_name = a.field_name AND x.load_no <> a.load_no) AS there,
        (SELECT count(*) FROM x WHERE x.tab_name = a.tab_name AND x.field_name = a.field_name AND x.load_no <> a.load_no) AS others, a.k
        FROM (SELECT tab_name, field_name, load_no, count(*) AS k FROM x GROUP BY ALL) a)
SELECT tab_name, field_name, load_no, 'null_rate' AS issue FROM s WHERE orows > 0 AND abs(filled::double / rows - ofilled::double / orows) > 0.15
UNION ALL SELECT tab_name, field_name, load_no, 'pattern' FROM s WHERE filled >= 20 AND bad::double / filled > 0.10
UNION ALL SELECT tab_name, field_name, load_no, 'values' FROM grid GROUP BY ALL HAVING sum(abs(p - q)) / 2 > 0.30
UNION ALL SELECT tab_name, field_name, load_no, 'range' FROM med WHERE k >= 20 AND others >= 20 AND (here / there > 5 OR here / there < 0.2)
UNION ALL SELECT DISTINCT tab_name, field_name, load_no, 'dup_key' FROM counts WHERE field_name = 'primary_key' AND n > 1"""

QUERIES = {
    "p3_found": (p3_found, P3_FOUND_SQL),
    "p3_figures": (p3_figures, P3_SQL),
    "p4_found": (p4_found, _p4_sql(True)),
    "p4_net_grams": (lambda s, d: p4_net_grams(s, d).withColumns({"grams": F.round("grams", 9), "net_g": F.col("net_g").cast("double")}), _p4_sql(False)),
    "p4_converted": (p4_converted, P4_CONVERTED_SQL),
    "p5_found": (p5_found, P5_SQL),
    "p5_profile": (p5_profile, _profile_sql(False)),
    "p5_redelivered": (p5_redelivered, _profile_sql(False)),
    "p5_profile_by_load": (p5_profile_by_load, _profile_sql(True)),
}
