"""Column profiles from maintained value counts.

A :class:`ValueCounts` store keeps, per table, field, load and value, how many rows hold that value.
Each load is applied as signed deltas: what it adds, and with a minus what an earlier delivery of the
same load had put there. Profiles, entropies and departures are exact functions of the maintained
counts, so a new load costs one scan of its own rows and never a rescan of older loads. A store lives on
in its folder; one that holds all loads of its tables is only read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrass.plans.staging import fingerprint, new_path, release, shared_dir, stage

KEY_FIELD = "primary_key"
SCHEMA = "tab_name string, field_name string, load_no int, value string, n bigint"
QUANTITY_RE = r"-?\d{1,3}(\.\d{3})*,\d{3}"
INTEGER_RE = r"[0-9]{1,3}"


def whole(value: Column, pattern: str) -> Column:
    """Whether the whole value, as recorded, matches ``pattern``."""
    return value.rlike(rf"\A(?:{pattern})\z")


def populated(value: Column) -> Column:
    return F.coalesce(F.trim(value) != "", F.lit(False))


def count_values(df: DataFrame, tab_name: str, fields: Sequence[str], key: Sequence[str] = (), load: str = "load_no") -> DataFrame:
    """Value counts of one table in one scan: the cells are unfolded and combined before the shuffle.

    The key is counted as a further field, its parts separated by U+001F and nulls written as U+0000.
    """
    cells = [F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields]
    if key:
        parts = [F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in key]
        cells.append(F.struct(F.lit(KEY_FIELD).alias("field_name"), F.concat_ws("\u001f", *parts).alias("value")))
    if not cells:
        raise ValueError("no field to count")
    return (
        df.select(F.col(load).cast("int").alias("load_no"), F.inline(F.array(*cells)))
        .groupBy("field_name", "load_no", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(tab_name).alias("tab_name"), "field_name", "load_no", "value", "n")
    )


@dataclass
class ValueCounts:
    """A store of signed deltas below ``path``: a folder per delta, in it one per table and load.

    A delta counts once it is written whole: it is written aside and then gets the next number of its table, so
    of two writers that saw the same state only one succeeds. Counts of a load that has one delta are read as
    they are; only where a load was delivered again its deltas are summed.
    """

    spark: SparkSession
    path: str

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None) -> ValueCounts:
        """The store at ``path``, kept from earlier or new; without a path a new one in the session's shared folder."""
        return cls(spark, path or new_path(spark, "value-counts"))

    @classmethod
    def kept(cls, spark: SparkSession, *sources: str) -> ValueCounts:
        """The store of tables at the paths ``sources`` as they are now, kept in the shared folder from query to query."""
        return cls(spark, f"{shared_dir(spark)}/tallgrass/kept-value-counts-{fingerprint(spark, *sources)}")

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path, path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _deltas_of(self, tab_name: str) -> int:
        path, fs = self._files()
        return len(fs.globStatus(path(f"{self.path}/delta-{tab_name}-*")) or [])

    def _commit(self, counts: DataFrame, tab_name: str, number: int) -> bool:
        """Write a delta as number ``number`` of its table; False, and nothing written, if there is one."""
        path, fs = self._files()
        aside, target = path(f"{self.path}/writing-{uuid.uuid4().hex}"), path(f"{self.path}/delta-{tab_name}-{number:06d}")
        counts.select("tab_name", "load_no", "field_name", "value", "n").write.partitionBy("tab_name", "load_no").parquet(aside.toString())
        if fs.exists(target):
            fs.delete(aside, True)
            return False
        return bool(fs.rename(aside, target))

    def _folders(self) -> list[tuple[str, str, int | None]]:
        """(delta folder, table, load) of what was written whole."""
        path, fs = self._files()
        whole = {str(x.getPath().getParent().toString()) for x in fs.globStatus(path(f"{self.path}/delta-*/_SUCCESS")) or []}
        out = []
        for x in fs.globStatus(path(f"{self.path}/delta-*/tab_name=*/load_no=*")) or []:
            delta, tab, load = str(x.getPath().toString()).rsplit("/", 2)
            if delta in whole:
                load = load.removeprefix("load_no=")
                out.append((delta, tab.removeprefix("tab_name="), int(load) if load.lstrip("-").isdigit() else None))
        return out

    def loads(self, tab_name: str) -> set[int | None]:
        """The loads of a table that the store holds."""
        return {load for _, tab, load in self._folders() if tab == tab_name}

    def _read(self, folders: list[str]) -> DataFrame:
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        parts = [self.spark.read.schema(SCHEMA).parquet(f).select(columns) for f in folders]  # a delta per call of `apply`
        out = parts[0] if parts else self.spark.createDataFrame([], SCHEMA)
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def deltas(self) -> DataFrame:
        return self._read(sorted({f for f, _, _ in self._folders()}))

    def state(self) -> DataFrame:
        """The maintained counts: the sum of all deltas, without what was taken back."""
        times = Counter((tab, load) for _, tab, load in self._folders())
        again = sorted(f"{tab}|{load}" for (tab, load), n in times.items() if n > 1)
        deltas = self.deltas()
        if not again:
            return deltas
        # Few: one per table and load; the test needs their names alone, so only their folders are read.
        name = F.concat_ws("|", "tab_name", F.coalesce(F.col("load_no").cast("string"), F.lit("None")))
        summed = deltas.where(name.isin(*again)).groupBy("tab_name", "field_name", "load_no", "value").agg(F.sum("n").alias("n")).where("n <> 0")
        return deltas.where(~name.isin(*again)).unionByName(summed)

    def apply(self, counts: DataFrame, tab_name: str, loads: Sequence[int | None] | None = None) -> bool:
        """Bring ``loads`` of a table (None: all) to ``counts``, as delivered now.

        What the store doesn't hold is added; of loads it holds, the difference to the earlier delivery is
        written, with a minus for what is gone. False, and nothing changed, if another writer came first.
        """
        number = self._deltas_of(tab_name)
        mine = counts.where(F.col("tab_name") == tab_name)
        held = self.loads(tab_name)
        if loads is not None:
            wanted = F.coalesce(F.col("load_no").cast("string"), F.lit("None")).isin(*[str(x) for x in loads])
            mine, held = mine.where(wanted), held & set(loads)
        if held:
            before = self.state().where(F.col("tab_name") == tab_name)
            before = before if loads is None else before.where(wanted)
            mine = mine.unionByName(before.withColumn("n", -F.col("n"))).groupBy("tab_name", "field_name", "load_no", "value").agg(F.sum("n").alias("n")).where("n <> 0")
        return self._commit(mine, tab_name, number)

    def compact(self) -> ValueCounts:
        """The same state in a new folder, a single delta of each table without counts that cancel out."""
        smaller, state = ValueCounts.create(self.spark), self.state()
        for tab in sorted({tab for _, tab, _ in self._folders()}):
            smaller._commit(state.where(F.col("tab_name") == tab), tab, 0)
        return smaller


@dataclass(frozen=True)
class Field:
    tab_name: str
    field_name: str
    field_type: str
    format_re: str | None
    tracked: bool


def fields_of(spec: DataFrame, bound: int = 20_000) -> list[Field]:
    """The declared fields; a schema, not data, and its size is checked."""
    rows = spec.select("tab_name", "field_name", "field_type", "format_re", "tracked").limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} declared fields")
    return sorted((Field(*r[:4], bool(r[4])) for r in rows), key=lambda f: (f.tab_name, f.field_name))


def _by_field(fields: Sequence[Field], test) -> Column:
    """A case over (tab_name, field_name) with one constant expression per field."""
    expr = F.lit(None)
    groups: dict[object, list[Field]] = {}
    for f in fields:
        groups.setdefault(test(f)[0], []).append(f)
    case = None
    for what, members in groups.items():
        if what is None:
            continue
        hit = F.concat_ws(".", "tab_name", "field_name").isin(*[f"{f.tab_name}.{f.field_name}" for f in members])
        value = test(members[0])[1]
        case = F.when(hit, value) if case is None else case.when(hit, value)
    return expr if case is None else case


def annotate(state: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """State rows with what each distinct value is: populated, in its format, a number.

    Done on distinct values, not cells: a code that fills a column of a billion rows is tested once a load.
    """
    v = F.col("value")
    matches = _by_field(fields, lambda f: (f.format_re, whole(v, f.format_re)) if f.format_re else (None, None))
    plain = F.replace(F.replace(v, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    numeric = {"quantity": F.when(whole(v, QUANTITY_RE), plain.try_cast("double")), "integer": F.when(whole(v, INTEGER_RE), v.try_cast("double"))}
    number = _by_field(fields, lambda f: (f.field_type, numeric[f.field_type]) if f.field_type in numeric else (None, None))
    tracked = [f"{f.tab_name}.{f.field_name}" for f in fields if f.tracked]
    return state.withColumns({
        "is_populated": populated(v),
        "fits": matches.cast("boolean"),
        "number": number.cast("double"),
        "is_tracked": F.concat_ws(".", "tab_name", "field_name").isin(*tracked) if tracked else F.lit(False),
    })


def profile(state: DataFrame, per_load: bool) -> DataFrame:
    """Exact profile of every field, overall or per load, from maintained counts (see :func:`annotate`).

    Columns: n_rows, populated_pct (2 decimals), distinct_count and entropy (of populated values, in
    bits), min_length, max_length, min_value, max_value (as text), min_number, max_number, violations
    (populated rows out of format), is_unique and repeated_rows (of the key field).

    A field that is never populated has distinct_count 0, entropy 0, lengths 0 and null ranges.
    """
    by = ["tab_name", "field_name"] + (["load_no"] if per_load else [])
    values = state.groupBy(*by, "value", "is_populated", "fits", "number").agg(F.sum("n").alias("n"))
    n, pop = F.col("n"), F.col("is_populated")
    full = F.when(pop, n)
    size = F.length("value")
    is_key = F.col("field_name") == KEY_FIELD
    grouped = values.groupBy(*by).agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(full), F.lit(0)).alias("n_populated"),
        F.count(full).alias("distinct_count"),
        F.sum(F.when(pop, n * F.log2(n.cast("double")))).alias("__nlogn"),
        F.min(F.when(pop, size)).alias("min_length"),
        F.max(F.when(pop, size)).alias("max_length"),
        F.min(F.when(pop & ~is_key, F.col("value"))).alias("min_value"),
        F.max(F.when(pop & ~is_key, F.col("value"))).alias("max_value"),
        F.min("number").alias("min_number"),
        F.max("number").alias("max_number"),
        F.coalesce(F.sum(F.when(pop & ~F.col("fits"), n)), F.lit(0)).alias("violations"),
        F.coalesce(F.sum(F.when(is_key & (n > 1), n)), F.lit(0)).alias("repeated_rows"),
    )
    total = F.col("n_populated").cast("double")
    return grouped.select(
        *by, "n_rows", "n_populated",
        F.round(100 * total / F.col("n_rows"), 2).alias("populated_pct"),
        "distinct_count",
        F.when(total > 0, F.log2(total) - F.col("__nlogn") / total).otherwise(F.lit(0.0)).alias("entropy"),
        F.coalesce("min_length", F.lit(0)).alias("min_length"), F.coalesce("max_length", F.lit(0)).alias("max_length"),
        "min_value", "max_value", "min_number", "max_number", "violations",
        F.when(is_key, F.col("repeated_rows") == 0).alias("is_unique"), "repeated_rows",
    )


def _medians(numbers: DataFrame, by: list[str], load: str = "load_no") -> DataFrame:
    """(*by, load, total, median, others_total, others_median): weighted medians (mean of the middle two) of each load and of all other loads together.

    ``numbers`` has a row (*by, load, number, n) per number above 0. Ranks are first placed among logarithmic
    buckets, of which a field has a few thousand at most whatever the data; only the numbers of the buckets
    that hold middle ranks are then ranked one by one.
    """
    # A monotone bucket of the positive double: 64 to a power of two.
    bucketed = numbers.withColumn("__b", F.floor(F.log2("number") * 64))
    per = bucketed.groupBy(*by, load, "__b").agg(F.sum("n").alias("__own"))
    everywhere = per.groupBy(*by, "__b").agg(F.sum("__own").alias("__all"))
    grid = per.select(*by, load).distinct().join(everywhere, by).join(per, [*by, load, "__b"], "left")
    grid = grid.withColumn("__own", F.coalesce("__own", F.lit(0))).withColumn("__rest", F.col("__all") - F.col("__own"))
    up_to, whole = Window.partitionBy(*by, load).orderBy("__b"), Window.partitionBy(*by, load)
    side = lambda kind, n: F.struct(F.lit(kind).alias("kind"), (F.sum(n).over(up_to) - F.col(n)).alias("before"), F.col(n).alias("n"), F.sum(n).over(whole).alias("total"))
    both = grid.select(*by, load, "__b", F.array(side("own", "__own"), side("rest", "__rest")).alias("__s")).select(*by, load, "__b", F.inline("__s"))
    low, high = F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2)
    holds = lambda r: (r > F.col("before")) & (r <= F.col("before") + F.col("n"))
    middle = both.where(holds(low) | holds(high)).select(*by, load, "__b", "kind", "before", "total")
    inside = bucketed.withColumnRenamed(load, "__from").join(middle, [*by, "__b"]).where((F.col("kind") == "own") == (F.col("__from") == F.col(load)))
    values = inside.groupBy(*by, load, "kind", "__b", "before", "total", "number").agg(F.sum("n").alias("n"))
    ranked = values.withColumn("__to", F.col("before") + F.sum("n").over(Window.partitionBy(*by, load, "kind", "__b").orderBy("number")))
    at = lambda kind, r: F.min(F.when((F.col("kind") == kind) & (F.col("__to") >= r), F.col("number")))
    total = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("total")))
    # Of two middle buckets the lower one's rows may all lie below the upper rank; the least over both is right.
    return ranked.groupBy(*by, load).agg(
        total("own").alias("total"), ((at("own", low) + at("own", high)) / 2).alias("median"),
        total("rest").alias("others_total"), ((at("rest", low) + at("rest", high)) / 2).alias("others_median"),
    )


@dataclass(frozen=True)
class Limits:
    null_rate: float = 0.15
    pattern: float = 0.10
    values: float = 0.30
    range_factor: float = 5.0
    least: int = 20


def departures(state: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(tab_name, field_name, load_no, issue): loads in which a field departs from its format or the other loads.

    ``state`` is annotated (see :func:`annotate`). issue is null_rate, pattern, values, range or dup_key.
    A field of a single load has no other loads and so departs only by pattern or dup_key.
    """
    n, pop = F.col("n"), F.col("is_populated")
    plain = state.where(F.col("field_name") != KEY_FIELD)
    by = ["tab_name", "field_name"]
    loads = plain.groupBy(*by, "load_no").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(pop, n)), F.lit(0)).alias("full"),
        F.coalesce(F.sum(F.when(pop & ~F.col("fits"), n)), F.lit(0)).alias("bad"),
    )
    overall = Window.partitionBy(*by)  # one row per load and field
    shares = stage(loads.withColumns({
        "others": F.sum("rows").over(overall) - F.col("rows"),
        "others_full": F.sum("full").over(overall) - F.col("full"),
    }), "load-shares")
    share = F.col("full") / F.col("rows")
    null_rate = (F.col("others") > 0) & (F.abs(share - F.col("others_full") / F.col("others")) > limits.null_rate)
    pattern = (F.col("full") >= limits.least) & (F.col("bad") / F.col("full") > limits.pattern)
    issues = F.filter(F.array(F.when(null_rate, "null_rate"), F.when(pattern, "pattern")), lambda x: x.isNotNull())
    told = shares.select(*by, "load_no", F.explode(issues).alias("issue"))

    coded = plain.where(F.col("is_tracked") & pop).select(*by, "load_no", "value", "n").withColumn("all", F.sum("n").over(Window.partitionBy(*by, "value")))
    enough = shares.where((F.col("full") >= limits.least) & (F.col("others_full") >= limits.least)).select(*by, "load_no", "full", "others_full")
    p, q = n / F.col("full"), (F.col("all") - n) / F.col("others_full")
    # Values that the load lacks add what is left of the others' shares.
    distance = (F.sum(F.abs(p - q)) + F.lit(1.0) - F.sum(q)) / 2
    values = coded.join(enough, [*by, "load_no"]).groupBy(*by, "load_no").agg(distance.alias("distance")).where(F.col("distance") > limits.values)

    numbers = stage(plain.where(F.col("number") > 0).groupBy(*by, "load_no", "number").agg(F.sum("n").alias("n")), "numbers")
    ratio = F.col("median") / F.col("others_median")
    ranges = _medians(numbers, by).where(
        (F.col("total") >= limits.least) & (F.col("others_total") >= limits.least) & ((ratio > limits.range_factor) | (ratio < 1 / limits.range_factor))
    )
    dup_key = state.where((F.col("field_name") == KEY_FIELD) & (n > 1)).select(*by, "load_no").distinct()

    out = told
    for issue, df in (("values", values), ("range", ranges), ("dup_key", dup_key)):
        out = out.unionByName(df.select(*by, "load_no", F.lit(issue).alias("issue")))
    found = stage(out, "departures")
    release(shares, numbers)
    return found


#: The keys of the project's tables.
KEYS: Mapping[str, Sequence[str]] = {"mara": ("matnr",), "makt": ("matnr", "spras"), "marc": ("matnr", "werks")}


def bring_up_to_date(store: ValueCounts, tables: Mapping[str, DataFrame], fields: Sequence[Field], keys: Mapping[str, Sequence[str]] = KEYS, again: bool = False) -> ValueCounts:
    """``store`` with all loads of ``tables`` that have declared fields; each table is scanned once, if at all.

    A table of which the store holds loads is left alone, unless it is delivered ``again``: then its loads
    get what has changed. If another writer counts the same files at the same time, its counts serve as well.
    """
    for tab, df in tables.items():
        declared = [f.field_name for f in fields if f.tab_name == tab and f.field_name in df.columns]
        if declared and (again or not store.loads(tab)):
            done = store.apply(count_values(df, tab, declared, keys.get(tab, ())), tab)
            if again and not done:
                raise RuntimeError(f"{tab} was changed by another writer meanwhile")
    return store
