"""Labelled test data: generated tables, and defects injected as set operations.

Every draw is a hash of the seed, the row's key and a purpose, so a row's values don't depend on how the
data is partitioned, and every expression can be recomputed.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.functions.values import quantity_text
from tallgrass.operators import profile as profiles
from tallgrass.operators.compile import violated
from tallgrass.operators.ir import Bool, Comparison, Rule
from tallgrass.operators.rules import record_id
from tallgrass.operators.schema import Field, Schema
from tallgrass.plans.numbering import numbered
from tallgrass.plans.staging import stage

# The share of rows that each scenario spoils, the decoys it plants, and the plants of a material.
RATES = {"healthy": 0.015, "degraded": 0.06, "critical": 0.17}
DECOYS = {"healthy": 0, "degraded": 28, "critical": 28}
PLANTS = ["A110", "A120", "B205", "B210", "C301", "C330"]
PLANT_NUMBERS = [(0.819, 1), (0.993, 2), (0.998, 3), (1.0, 6)]
FIRST_TWIN = 900_000_000


def draw(seed: int, purpose: str, *keys: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(purpose), *keys), F.lit(1 << 52)) / F.lit(float(1 << 52))


def pick(values: Sequence[str], seed: int, purpose: str, *keys: Column) -> Column:
    """One of ``values``, each as likely."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(draw(seed, purpose, *keys) * len(values)) + 1).cast("int"))


@dataclass(frozen=True)
class Calibration:
    """How often a field is filled, and its frequent values with their weights."""

    rates: Mapping[str, float] = field(default_factory=dict)
    weights: Mapping[str, Sequence[tuple[str, float]]] = field(default_factory=dict)

    def rate(self, f: Field) -> float:
        return self.rates.get(f.name, 1.0 if f.populated_pct is None else f.populated_pct / 100)


def calibrate(df: DataFrame, fields: Sequence[str], n: int = 20) -> Calibration:
    """A calibration from a table: populated shares and the ``n`` most frequent values of each field."""
    rates = {r["field_name"]: r["populated_pct"] / 100 for r in profiles.profile(df, fields).collect()}  # a row per field
    weights: dict[str, list[tuple[str, float]]] = {}
    for r in profiles.top_values(df, fields, n).orderBy("field_name", "place").collect():  # n rows per field
        weights.setdefault(r["field_name"], []).append((r["value"], float(r["n"])))
    return Calibration(rates, weights)


def _weighted(choices: Sequence[tuple[str, float]], d: Column) -> Column:
    total, up_to, out = sum(w for _, w in choices), 0.0, None
    for value, weight in choices[:-1]:
        up_to += weight / total
        out = F.when(d < up_to, value) if out is None else out.when(d < up_to, value)
    return F.lit(choices[-1][0]) if out is None else out.otherwise(choices[-1][0])


def field_value(f: Field, cal: Calibration, seed: int, *keys: Column) -> Column:
    """A value of a field by its type, in the project's notations; a mandatory field is always filled, others as often as was seen."""
    d = draw(seed, f.name, *keys)
    if f.name in cal.weights and f.type not in ("text", "date", "key"):
        value = _weighted(cal.weights[f.name], d)
    elif f.domain:
        value = pick(f.domain, seed, f.name, *keys)
    else:
        value = {
            "client": F.lit("100"), "lang": F.lit("E"), "code": F.concat(F.lit("C"), F.lpad(F.floor(d * 40).cast("string"), 2, "0")), "flag": F.lit("X"), "quantity": quantity_text(F.floor(d * 1000)),
            "integer": F.floor(d * 60).cast("string"), "date": F.date_format(F.date_add(F.lit("2010-01-01").cast("date"), F.floor(d * 4000).cast("int")), "MM/dd/yyyy"),
        }.get(f.type, F.concat(F.lit("T"), F.lpad(F.floor(d * 100_000).cast("string"), 5, "0")))
    return value if f.mandatory else F.when(draw(seed, f"{f.name}?", *keys) < cal.rate(f), value)


def distinct_text(number: Column, words: Sequence[Sequence[str]]) -> Column:
    """Wordings told apart by construction: the number in mixed radix over ``words`` and a running size, instead of drawing and comparing with all earlier texts."""
    rest, parts = number, []
    for group in words:
        parts.append(F.element_at(F.array(*[F.lit(w) for w in group]), (F.pmod(rest, F.lit(len(group))) + 1).cast("int")))
        rest = F.floor(rest / len(group))
    return F.concat_ws(" ", *parts, F.format_string("%dx%d", rest + 1, rest + 7))


def plants(seed: int, *keys: Column) -> Column:
    """One to six plants of a material."""
    d = draw(seed, "plants", *keys)
    many = None
    for most, n in PLANT_NUMBERS:
        many = F.when(d < most, n) if many is None else many.when(d < most, n)
    shuffled = F.array_sort(F.array(*[F.struct(draw(seed, f"plant{p}", *keys).alias("d"), F.lit(p).alias("werks")) for p in PLANTS]))
    return F.transform(F.slice(shuffled, F.lit(1), many.otherwise(PLANT_NUMBERS[-1][1])), lambda p: p["werks"])


def generate(spark: SparkSession, n: int, seed: int, schemas: Mapping[str, Schema], words: Sequence[Sequence[str]], calibrations: Mapping[str, Calibration] | None = None) -> dict[str, DataFrame]:
    """{mara, makt, marc} with all fields that ``schemas`` declare: ``n`` materials, a text each, one to six plants each."""
    ids = spark.range(n).withColumn("matnr", F.lpad((F.col("id") + 10_000_000).cast("string"), 18, "0"))
    bases = {
        "mara": ids,
        "makt": ids.withColumns({"spras": F.lit("E"), "maktx": distinct_text(F.col("id"), words)}).withColumn("maktg", F.upper("maktx")),
        "marc": ids.withColumn("werks", F.explode(plants(seed, F.col("matnr")))),
    }
    out = {}
    for table, s in schemas.items():
        base, cal = bases[table], (calibrations or {}).get(table, Calibration())
        key = [F.col(k) for k in s.key]
        out[table] = base.select(*[F.col(f.name) if f.name in base.columns else field_value(f, cal, seed, *key).alias(f.name) for f in s.fields])
    return out


def materials(spark: SparkSession, n: int, seed: int, types: Sequence[str], units: Sequence[str], words: Sequence[Sequence[str]]) -> dict[str, DataFrame]:
    """{mara, makt, marc} of few fields: :func:`generate` for tests and trials."""
    f = lambda name, kind="code", **how: Field(name, kind, **how)
    groups = tuple(f"G{i:03d}" for i in range(40))
    schemas = {
        "mara": Schema("mara", ("matnr",), (f("matnr", "key"), f("mtart", domain=tuple(types), mandatory=True), f("meins", domain=tuple(units), mandatory=True), f("matkl", domain=groups, populated_pct=96.0), f("ntgew", "quantity"), f("ersda", "date"))),
        "makt": Schema("makt", ("matnr", "spras"), (f("matnr", "key"), f("spras", "lang"), f("maktx", "text"))),
        "marc": Schema("marc", ("matnr", "werks"), (f("matnr", "key"), f("werks"))),
    }
    return generate(spark, n, seed, schemas, words)


def exactly(df: DataFrame, rate: float, seed: int, purpose: str, *keys: Column, n: int | None = None) -> DataFrame:
    """round(n * rate) rows, those with the smallest draws: numbered by range, so no task sees them all."""
    total = df.count() if n is None else n
    drawn = df.withColumns({"__draw": F.xxhash64(F.lit(seed), F.lit(purpose), *keys), "__tie": F.struct(*keys)})
    return numbered(drawn, "__draw", "__tie", into="__number").where(F.col("__number") <= round(total * rate)).drop("__draw", "__tie", "__number")


def conform(df: DataFrame, rules: Iterable[Rule], fills: Mapping[str, str]) -> DataFrame:
    """``df`` with values that make single-field rules pass: nulls and values out of the domain are replaced by ``fills``."""
    out = df
    for r in rules:
        if len(r.fields) == 1 and r.fields[0] in fills and r.fields[0] in df.columns:
            f = r.fields[0]
            out = out.withColumn(f, F.when(F.col(f).isNull() | violated(r.assertion, r.scope, out.schema), fills[f]).otherwise(F.col(f)))
    return out


# ---- rules over several fields


def is_dnf(r: Rule) -> bool:
    """Whether the assertion is an OR of comparisons and ANDs of comparisons."""
    a = r.assertion
    flat = lambda x: isinstance(x, Comparison) or x.op == "and" and all(isinstance(y, Comparison) for y in x.args)
    return isinstance(a, Bool) and a.op == "or" and all(flat(x) for x in a.args)


def clauses(r: Rule) -> list[tuple[Comparison, ...]]:
    """The clauses of a rule in disjunctive form; one that holds makes the rule pass."""
    return [(x,) if isinstance(x, Comparison) else x.args for x in r.assertion.args]


def pivot(r: Rule) -> str | None:
    """The first field of the first clause that every clause has: changing it alone can make all of them false."""
    every = set.intersection(*({c.field for c in clause} for clause in clauses(r)))
    return next((c.field for c in clauses(r)[0] if c.field in every), None)


def safe_clause(r: Rule, s: Schema | None) -> tuple[Comparison, ...]:
    """The clause that is best satisfied: a lone is_null, else the first that keeps to the fields' domains, else the first."""

    def within(c: Comparison) -> bool:
        domain = s.domain(c.field) if s else ()
        wanted = {c.value} if c.op == "eq" else set(c.value) if c.op == "in" else set()
        return not domain or wanted <= set(domain)

    listed = clauses(r)
    alone = next((c for c in listed if len(c) == 1 and c[0].op == "is_null"), None)
    return alone or next((c for c in listed if all(map(within, c))), listed[0])


def satisfied(c: Comparison, df: DataFrame) -> Column:
    """The field of ``c`` with a value that makes it true, where one can be told; a value that does already stays."""
    f = F.col(c.field)
    value = {"in": c.value[0] if c.op == "in" and c.value else None, "eq": c.value, "is_null": None, "is_not_null": "0,000", "ge": c.value, "le": c.value}
    if c.op not in value or c.op in ("in", "eq", "ge", "le") and value[c.op] is None:
        return f
    return F.when(violated(c, None, df.schema) | f.isNull(), F.lit(value[c.op]).cast("string")).otherwise(f) if c.op != "is_null" else F.lit(None).cast("string")


def conform_cross(df: DataFrame, r: Rule, s: Schema | None = None) -> DataFrame:
    """``df`` with the rows that break ``r`` changed so that it holds: a clause of a disjunction, or what an implication asks for."""
    if is_dnf(r):
        wanted = safe_clause(r, s)
    elif isinstance(r.assertion, Bool) and r.assertion.op == "implies" and isinstance(r.assertion.args[1], Comparison):
        wanted = (r.assertion.args[1],)
    else:
        return df
    broken = violated(r.assertion, r.scope, df.schema)
    keys = set(s.key) if s else set()
    changes = {c.field: F.when(broken, satisfied(c, df)).otherwise(F.col(c.field)) for c in wanted if c.field not in keys}
    return df.withColumns(changes) if changes else df


# What is put where a value must lie outside of every domain.
STRANGERS = ["ZZ", "QX", "99", "??"]
INCONSISTENT = "__INCONSISTENT__"


def stranger(domain: Sequence[str], seed: int, purpose: str, *keys: Column) -> Column:
    """A value that ``domain`` doesn't have."""
    free = [v for v in STRANGERS if v not in set(domain)] or [max(domain, key=len) + "_"]
    return pick(free, seed, purpose, *keys)


def breaking_changes(r: Rule, s: Schema | None, seed: int = 0) -> dict[str, str | None] | None:
    """The changes that are meant to break a rule over several fields; None where none can be told.

    A disjunction is broken by its pivot, with a value of the field's domain that no clause names if there is
    one; an implication by a true first part and a false second.
    """
    if is_dnf(r):
        f = pivot(r)
        if f is None:
            return None
        named = {v for clause in clauses(r) for c in clause if c.field == f for v in (c.value if c.op == "in" else (c.value,) if c.op == "eq" else ())}
        return {f: next((v for v in (s.domain(f) if s else ()) if v not in named), INCONSISTENT)}
    if not (isinstance(r.assertion, Bool) and r.assertion.op == "implies" and all(isinstance(a, Comparison) for a in r.assertion.args)):
        return None
    first, then = r.assertion.args
    changes: dict[str, str | None] = {}
    if first.op in ("in", "eq") and first.value:
        changes[first.field] = first.value[0] if first.op == "in" else first.value
    changes[then.field] = None if then.op == "is_not_null" else next((v for v in STRANGERS if v not in (then.value or ())), INCONSISTENT) if then.op == "in" else INCONSISTENT
    return changes


def break_cross_field(df: DataFrame, r: Rule, keys: Sequence[str], changes: Mapping[str, str | None], rate: float, seed: int, taken: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(dirtied, labels) for a rule over several fields: hashed rows get ``changes``; a row that the rule then
    doesn't find broken, or of which a field is in ``taken`` (record_id, field), stays as it was and has no label."""
    if any(f in keys for f in changes):
        raise ValueError("keys are never changed")
    hit = draw(seed, r.rule_id, *[F.col(x) for x in keys]) < rate
    rows = df.withColumn("__id", record_id(keys))
    if taken is not None:
        used = taken.where(F.col("field").isin(*r.fields)).select(F.col("record_id").alias("__id"), F.lit(True).alias("__taken")).distinct()
        rows = rows.join(used, "__id", "left")
        hit = hit & F.col("__taken").isNull()
    tried = rows.withColumns({f"__o_{f}": F.col(f) for f in changes}).withColumns({f: F.when(hit, F.lit(v).cast("string")).otherwise(F.col(f)) for f, v in changes.items()})
    done = tried.withColumn("__done", hit & violated(r.assertion, r.scope, tried.schema))
    text = lambda p: F.concat_ws(";", *[F.concat(F.lit(f"{f}="), F.coalesce(F.col(f"{p}{f}"), F.lit("None"))) for f in changes])
    labels = done.where("__done").select(
        F.lit(r.table).alias("table_name"), F.col("__id").alias("record_id"), F.lit(r.dimension).alias("dimension"), F.lit(r.rule_id).alias("rule_id"), F.lit(",".join(changes)).alias("field"),
        text("__o_").alias("original_value"), text("").alias("corrupted_value"),
    )
    return done.withColumns({f: F.when(F.col("__done"), F.col(f)).otherwise(F.col(f"__o_{f}")) for f in changes}).select(*df.columns), labels


def reconcile(df: DataFrame, rules: Iterable[Rule], keys: Sequence[str], labels: DataFrame) -> DataFrame:
    """``labels`` and, for each rule over several fields, every broken row that isn't labelled: a defect of one kind may break such a rule by the way."""
    out = labels
    for r in rules:
        broken = df.where(violated(r.assertion, r.scope, df.schema)).select(
            F.lit(r.table).alias("table_name"), record_id(keys).alias("record_id"), F.lit(r.dimension).alias("dimension"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.field_name).alias("field"),
            F.lit(None).cast("string").alias("original_value"), F.lit("broken by another defect").alias("corrupted_value"),
        )
        out = out.unionByName(broken.join(labels.select("rule_id", "record_id"), ["rule_id", "record_id"], "left_anti").select(*labels.columns))
    return out


def inject(df: DataFrame, table: str, keys: Sequence[str], rules: Iterable[Rule], rate: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(dirtied, labels): one defect per cell at most, never in a key.

    Not-null rules lose the value, domain rules get a stranger to the domain. Each cell is claimed by one
    rule, the first by hash, in one projection; a label is kept only where the compiled rule finds the
    changed row broken.
    """
    rules = [r for r in rules if r.table == table and r.executable and len(r.fields) == 1 and r.fields[0] not in keys and r.archetype in ("not_null", "domain_in", "reference_exists")]
    k = [F.col(x) for x in keys]
    out, made = df, []
    by_field: dict[str, list[Rule]] = {}
    for r in rules:
        by_field.setdefault(r.fields[0], []).append(r)
    for f, owners in by_field.items():
        d = draw(seed, f"{table}.{f}", *k)
        claim = F.lit(None).cast("int")
        for i, _ in reversed(list(enumerate(owners))):
            claim = F.when((d >= i * rate) & (d < (i + 1) * rate), i).otherwise(claim)
        spoiled = F.lit(None).cast("string")
        for i, r in enumerate(owners):
            if r.archetype != "not_null":
                listed = r.domain or tuple(r.assertion.value or ()) if isinstance(r.assertion, Comparison) else r.domain
                spoiled = F.when(claim == i, stranger(listed, seed, f"stranger.{f}", *k)).otherwise(spoiled)
        out = out.withColumns({f"__c_{f}": claim, f"__o_{f}": F.col(f), f: F.when(claim.isNotNull(), spoiled).otherwise(F.col(f))})
        made += [(f, i, r) for i, r in enumerate(owners)]
    if not made:
        return df, df.sparkSession.createDataFrame([], LABEL)
    label = F.array(*[
        F.when((F.col(f"__c_{f}") == i) & violated(r.assertion, r.scope, out.schema),
               F.struct(F.lit(r.dimension).alias("dimension"), F.lit(r.rule_id).alias("rule_id"), F.lit(f).alias("field"), F.col(f"__o_{f}").cast("string").alias("original_value"), F.col(f).cast("string").alias("corrupted_value")))
        for f, i, r in made
    ])
    labels = out.select(F.lit(table).alias("table_name"), record_id(keys).alias("record_id"), F.inline(F.filter(label, lambda x: x.isNotNull())))
    return out.select(*df.columns), labels


LABEL = "table_name string, record_id string, dimension string, rule_id string, field string, original_value string, corrupted_value string"

# Short forms of words, and units with what stands for them, in the order in which they are tried.
SHORT_FORMS = [
    ("stainless steel", "ss"), ("carbon steel", "cs"), ("cast steel", "cast"), ("precision", "prec"), ("heavy duty", "hd"), ("high speed", "hs"),
    ("industrial", "ind"), ("reinforced", "reinf"), ("aluminium", "al"), ("modular", "mod"), ("standard", "std"), ("compact", "comp"),
]
UNIT_WORDS = [("inches", "in"), ("inch", "in"), ("millimeters", "mm"), ("millimetres", "mm"), ("millimeter", "mm"), ("centimeters", "cm")]
UNIT_SYMBOLS = [("inches", '"'), ("inch", '"'), ("degrees", "deg")]


def _first_of(text: Column, swaps: Sequence[tuple[str, str, bool]], otherwise: Column) -> Column:
    """``text`` with the first place of the first form found replaced; a form marked True must stand alone as a word."""
    out = None
    low = F.lower(text)
    for form, by, alone in swaps:
        at = F.instr(F.concat(F.lit(" "), low, F.lit(" ")), f" {form} ") if alone else F.instr(low, form)
        new = F.concat(F.substring(text, F.lit(1), at - 1), F.lit(by), F.substring(text, at + len(form), F.length(text)))
        out = F.when(at > 0, new) if out is None else out.when(at > 0, new)
    return out.otherwise(otherwise)


def perturbed(text: Column, strategy: str, seed: int = 0) -> Column:
    """A near copy by one of STRATEGIES; null stays null, and an empty text stays empty but for upper and trail_space."""
    words, size = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), F.length(text)
    sub = lambda a, n: F.substring(text, a, n)
    at = (F.floor(draw(seed, "swap", text) * (size - 1)) + 1).cast("int")
    k = F.size(words)
    both = [x for long, short in SHORT_FORMS for x in ((long, short, False), (short, long, True))]
    ways = {
        "upper": F.upper(text),
        "trail_space": F.concat(text, F.lit("  ")),
        "punct": F.regexp_replace(text, "^([^ ]*) ", "$1 - "),
        "swap": F.when(size >= 4, F.concat(sub(F.lit(1), at - 1), sub(at + 1, F.lit(1)), sub(at, F.lit(1)), sub(at + 2, size))).otherwise(text),
        "abbrev": _first_of(text, both, F.regexp_replace(text, "^([^ ]*) ", "$1  ")),
        # The last but one word goes to the front.
        "word_order": F.when(k >= 3, F.array_join(F.concat(F.slice(words, k - 1, F.lit(1)), F.slice(words, F.lit(1), k - 2), F.slice(words, k, F.lit(1))), " ")).otherwise(text),
        "unit_word": _first_of(text, [(a, b, False) for a, b in UNIT_WORDS], F.concat(text, F.lit(" mm"))),
        "unit_symbol": _first_of(text, [(a, b, False) for a, b in UNIT_SYMBOLS], F.concat(text, F.lit('"'))),
    }
    if strategy not in ways:
        raise ValueError(f"unknown strategy {strategy!r}")
    return F.when((text == "") & F.lit(strategy not in ("upper", "trail_space")), text).otherwise(ways[strategy])


STRATEGIES = ["upper", "trail_space", "punct", "swap", "abbrev", "word_order", "unit_word", "unit_symbol"]


def twins(tables: Mapping[str, DataFrame], rate: float, seed: int, subject: str = "mara", key: str = "matnr", text_table: str = "makt", text: str = "maktx") -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables with twins, labels twin/source/strategy): near copies under new numbers, with their rows in all tables; the wording of the text table is varied."""
    chosen = exactly(tables[subject].select(key).distinct(), rate, seed, "twin", F.col(key))
    pairs = numbered(chosen, key).select(F.col(key).alias("source"), F.lpad((F.col("number") - 1 + FIRST_TWIN).cast("string"), 18, "0").alias("twin"), pick(STRATEGIES, seed, "strategy", F.col(key)).alias("strategy"))
    pairs = stage(pairs, "twins")
    varied = F.col(text)
    for s in STRATEGIES:
        varied = F.when(F.col("strategy") == s, perturbed(F.col(text), s, seed)).otherwise(varied)
    out = {}
    for name, df in tables.items():
        copies = pairs.join(df, F.col("source") == F.col(key)).withColumn(key, F.col("twin"))
        copies = copies.withColumn(text, varied) if name == text_table else copies
        out[name] = df.unionByName(copies.select(*df.columns))
    return out, pairs


# Confusable wordings of different items, by kind.
DECOY_KINDS = [
    ("part_number", "Bearing 6203 Deep Groove", "Bearing 6204 Deep Groove"), ("size_number", "Ball Bearing Steel 5", "Ball Bearing Steel 10"), ("size_code", "Hex Bolt Stainless M8", "Hex Bolt Stainless M10"),
    ("grade_word", "Ball Bearing Steel 10", "Ball Bearing Carbon Steel 10"), ("grade_code", "Ball Bearing Steel 304", "Ball Bearing Steel 316"), ("direction", "Coupling Precision Left Hand", "Coupling Precision Right Hand"),
]


def plant_decoys(subjects: DataFrame, texts: DataFrame, count: int, seed: int, key: str = "matnr", text: str = "maktx", block: Sequence[str] = ("mtart", "meins")) -> tuple[DataFrame, DataFrame]:
    """(texts, decoys kind/left_id/right_id): ``count`` pairs of different records of one block get confusable wordings.

    Records follow each other by block and draw, and neighbours of one block make a pair; twins and records
    without a text are left alone. The chosen pairs are as few as ``count``.
    """
    blank = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    able = texts.groupBy(key).agg(F.bool_or(blank).alias("blank")).where("not blank").select(key)
    is_twin = F.col(key) >= F.lit(str(FIRST_TWIN).rjust(18, "0"))
    rows = subjects.where(~is_twin).select(F.col(key).alias("id"), F.concat_ws("\u001f", *[F.coalesce(F.trim(b), F.lit("")) for b in block]).alias("b")).distinct().join(able.withColumnRenamed(key, "id"), "id")
    placed = numbered(rows.withColumn("d", F.xxhash64(F.lit(seed), "id")), "b", "d", "id").withColumn("pair", F.floor((F.col("number") + 1) / 2))
    pairs = placed.groupBy("pair", "b").agg(F.min("id").alias("left_id"), F.max("id").alias("right_id")).where("left_id <> right_id")
    chosen = pairs.orderBy(F.xxhash64(F.lit(seed), "left_id"), "left_id").limit(count)
    k = F.pmod(F.row_number().over(_by("left_id")) - 1, F.lit(len(DECOY_KINDS)))
    listed = F.array(*[F.struct(F.lit(a).alias("kind"), F.lit(b).alias("left_text"), F.lit(c).alias("right_text")) for a, b, c in DECOY_KINDS])
    decoys = stage(chosen.withColumn("w", F.element_at(listed, (k + 1).cast("int"))).select("w.kind", "left_id", "right_id", "w.left_text", "w.right_text"), "decoys")
    new = decoys.select(F.inline(F.array(F.struct(F.col("left_id").alias(key), F.col("left_text").alias("__new")), F.struct(F.col("right_id").alias(key), F.col("right_text").alias("__new")))))
    changed = texts.join(F.broadcast(new), key, "left").withColumn(text, F.coalesce("__new", text))  # two rows a decoy
    return changed.select(*texts.columns), decoys


def _by(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column)  # the few chosen decoys


@dataclass
class Injected:
    tables: dict[str, DataFrame]
    labels: DataFrame
    twins: DataFrame
    decoys: DataFrame
    manifest: DataFrame


def inject_all(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]], rules: Sequence[Rule], scenario: str = "degraded", seed: int = 42, fills: Mapping[str, str] | None = None, schemas: Mapping[str, Schema] | None = None, decoys: int | None = None) -> Injected:
    """Everything in its order: conform, twins, completeness and validity, consistency, reconciliation, decoys.

    Rows have unique keys. Each step is written before the next reads it.
    """
    rate, schemas = RATES[scenario], schemas or {}
    single = [r for r in rules if r.executable and len(r.fields) == 1]
    cross = [r for r in rules if r.executable and len(r.fields) > 1]
    out = dict(tables)
    for t in out:
        out[t] = conform(out[t], [r for r in single if r.table == t], fills or {})
        for r in (r for r in cross if r.table == t):
            out[t] = conform_cross(out[t], r, schemas.get(t))
        out[t] = stage(out[t], f"conformed-{t}")
    out, made = twins(out, rate, seed)
    labels = None
    for t in out:
        out[t], found = inject(out[t], t, keys[t], single, rate, seed)
        out[t], found = stage(out[t], f"spoiled-{t}"), stage(found, "labels")
        for r in (r for r in cross if r.table == t):
            changes = breaking_changes(r, schemas.get(t), seed)
            if changes and not any(f in keys[t] for f in changes):
                out[t], more = break_cross_field(out[t], r, keys[t], changes, rate, seed, found)
                out[t], found = stage(out[t], f"spoiled-{t}"), stage(found.unionByName(more), "labels")
        found = reconcile(out[t], [r for r in cross if r.table == t], keys[t], found)
        labels = found if labels is None else labels.unionByName(found)
    out["makt"], planted = plant_decoys(out["mara"], out["makt"], DECOYS[scenario] if decoys is None else decoys, seed)
    labels = stage(labels, "labels")
    return Injected(out, labels, made, planted, manifest(labels, made, planted, scenario, seed))


def manifest(labels: DataFrame, made: DataFrame, planted: DataFrame, scenario: str, seed: int) -> DataFrame:
    """(scenario, seed, kind, n): how many labels of each dimension, twins and decoys were made."""
    count = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    rows = labels.groupBy(F.col("dimension").alias("kind")).agg(F.count(F.lit(1)).alias("n")).unionByName(count(made, "Uniqueness")).unionByName(count(planted, "decoys"))
    return rows.select(F.lit(scenario).alias("scenario"), F.lit(seed).alias("seed"), "kind", "n")
