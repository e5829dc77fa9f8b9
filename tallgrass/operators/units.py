"""Unit conversion over a graph of affine edges.

Nodes are unit names, edges say ``target = source * factor + offset``. Before any data is read the
shortest composition from every unit to the canonical unit of its dimension is computed, and every
edge is checked against the compositions, so contradictory cycles are found. The data then meets
one equi-join on the source unit. The graph holds units, not rows, and its size is checked.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_UNITS = 100_000

# Spellings of the units of mass, by the official code they stand for.
MASS_SPELLINGS = {
    "MG": ["mg", "mgm", "milligram", "milligrams", "milligramm"],
    "G": ["g", "gr", "grm", "gm", "gms", "gram", "grams", "gramm", "gramme", "grammes"],
    "KG": ["kg", "kgm", "kgs", "kilo", "kilos", "kilogram", "kilograms", "kilogramm", "kilogramme"],
    "TO": ["to", "t", "ton", "tons", "tonne", "tonnes", "tonnen"],
    "LB": ["lb", "lbs", "lbm", "pound", "pounds"],
    "OZ": ["oz", "ozs", "ounce", "ounces", "unze", "unzen"],
}


@dataclass(frozen=True)
class Edge:
    source: str
    target: str
    factor: Fraction
    offset: Fraction = Fraction(0)


class UnitGraph:
    """Shortest affine compositions between units, with a check that all cycles agree."""

    def __init__(self, edges: Iterable[Edge], tolerance: float = 1e-9):
        self.edges = list(edges)
        if len(self.edges) > MAX_UNITS:
            raise ValueError(f"{len(self.edges)} conversions exceed the bound of {MAX_UNITS}")
        self.tolerance = tolerance
        self.out: dict[str, list[Edge]] = {}
        for e in self.edges:
            if e.factor == 0:
                raise ValueError(f"a factor of 0 from {e.source} to {e.target} can't be inverted")
            self.out.setdefault(e.source, []).append(e)
            self.out.setdefault(e.target, []).append(Edge(e.target, e.source, 1 / e.factor, -e.offset / e.factor))

    def to(self, target: str) -> dict[str, tuple[Fraction, Fraction, int]]:
        """For every unit connected to ``target``: factor, offset and number of edges of the shortest composition."""
        found = {target: (Fraction(1), Fraction(0), 0)} if target in self.out else {}
        queue = deque(found)
        while queue:
            unit = queue.popleft()
            factor, offset, steps = found[unit]
            for e in sorted(self.out[unit], key=lambda e: e.target):
                if e.target not in found:
                    # e runs unit -> neighbour; its inverse runs neighbour -> unit, then on to the target.
                    inverse, shift = 1 / e.factor, -e.offset / e.factor
                    found[e.target] = (inverse * factor, shift * factor + offset, steps + 1)
                    queue.append(e.target)
        return found

    def conflicts(self) -> list[tuple[str, str]]:
        """Edges that disagree with the shortest compositions, that is, cycles that don't return to the start."""
        to_root: dict[str, tuple[Fraction, Fraction, int]] = {}
        for root in sorted(self.out):
            if root not in to_root:
                to_root |= self.to(root)
        bad = []
        for e in self.edges:
            (fs, os, _), (ft, ot, _) = to_root[e.source], to_root[e.target]
            for x in (Fraction(0), Fraction(1)):
                direct, around = fs * x + os, ft * (e.factor * x + e.offset) + ot
                if abs(direct - around) > self.tolerance * max(1, abs(direct)):
                    bad.append((e.source, e.target))
                    break
        return bad

    def table(self, spark: SparkSession, targets: Sequence[str]) -> DataFrame:
        """(source_unit, canonical_unit, factor, shift, steps): a row per unit and target it reaches, at most MAX_UNITS of them."""
        rows = [(unit, t, f"{float(f):.15f}", f"{float(o):.15f}", n) for t in dict.fromkeys(targets) for unit, (f, o, n) in sorted(self.to(t).items())]
        if len(rows) > MAX_UNITS:
            raise ValueError(f"{len(rows)} compositions exceed the bound of {MAX_UNITS}")
        df = spark.createDataFrame(rows or [("", "", "0", "0", 0)], "source_unit string, canonical_unit string, factor string, shift string, steps int")
        df = df.withColumns({c: F.col(c).cast("decimal(20,12)") for c in ("factor", "shift")})
        return df if rows else df.limit(0)


def convert(df: DataFrame, graph: UnitGraph, amount: str, unit: str, target: str, into: str = "converted") -> DataFrame:
    """``df`` with ``into``: the number ``amount`` in the unit named by ``unit``, brought to the unit named by ``target``.

    Both units may differ from row to row; conversions are looked up in one equi-join on the two. A unit that
    is unknown or of another dimension than the target gives null, as does a null number.
    """
    wanted = [r[0] for r in df.select(unit_name(F.col(target))).distinct().limit(MAX_UNITS + 1).collect()]  # units, whose number is checked
    if len(wanted) > MAX_UNITS:
        raise ValueError(f"more than {MAX_UNITS} target units")
    table = graph.table(df.sparkSession, [t for t in wanted if t is not None]).select(F.col("source_unit").alias("__su"), F.col("canonical_unit").alias("__cu"), "factor", "shift")
    renamed = table.withColumnsRenamed({"factor": "__factor", "shift": "__shift"})
    keyed = df.withColumns({"__su": unit_name(F.col(unit)), "__cu": unit_name(F.col(target))})
    joined = keyed.join(F.broadcast(renamed), ["__su", "__cu"], "left")  # at most MAX_UNITS rows
    return joined.withColumn(into, F.col(amount) * F.col("__factor") + F.col("__shift")).drop("__su", "__cu", "__factor", "__shift")


def edges_from_units(units: DataFrame, spellings: dict[str, list[str]] | None = None) -> list[Edge]:
    """Edges of a table of official units (msehi, factor, base_unit) and of the spellings of each.

    Names are kept as :func:`unit_name` writes them. The table is a list of units; its size is checked.
    """
    rows = units.select("msehi", "factor", "base_unit").limit(MAX_UNITS + 1).collect()
    if len(rows) > MAX_UNITS:
        raise ValueError(f"more than {MAX_UNITS} units")
    edges, official = [], set()
    for code, factor, base in rows:
        if code is None or base is None or not factor:
            continue
        official.add(code.strip().lower())
        edges.append(Edge(code.strip().lower(), base.strip().lower(), Fraction(str(factor))))
    for code, names in (MASS_SPELLINGS if spellings is None else spellings).items():
        for name in names:
            if code.lower() in official and name not in official:
                edges.append(Edge(name, code.lower(), Fraction(1)))
    return edges


def unit_name(text: Column) -> Column:
    """The form in which unit names are compared: no blanks or dots around it, lower case."""
    return F.lower(F.regexp_replace(text, r"^[\s. ]+|[\s. ]+$", ""))


# The project's notation: dots between thousands, a decimal comma. A plain number is read too.
AMOUNT = r"^\s*(\d{1,3}(?:\.\d{3})+(?:,\d+)?|\d+(?:,\d+)?)\s*([^\d\s].*?)?\s*$"


def amount(text: Column) -> Column:
    """The number of a quantity text as decimal(15,6); null if there is none or it doesn't fit."""
    plain = F.replace(F.replace(F.regexp_extract(text, AMOUNT, 1), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(plain != "", plain.try_cast("decimal(15,6)"))


def amount_unit(text: Column) -> Column:
    """What is written behind the number of a quantity text, as a unit name; '' if nothing is."""
    return unit_name(F.regexp_extract(text, AMOUNT, 2))


def stated_weight(text: Column, names: Iterable[str]) -> tuple[Column, Column]:
    """(amount, unit name) of the first weight stated in a wording; a count times a weight is multiplied out.

    In wordings dot and comma are both read as the decimal sign: sizes of goods are written either way.
    """
    units = "|".join(sorted((re.escape(n) for n in names), key=lambda n: (-len(n), n)))
    pattern = rf"(?i)(?<![\p{{L}}\d.,])(?:(\d+)\s*[x×*]\s*)?(\d+(?:[.,]\d+)?)[\s ]*({units})(?![\p{{L}}\d])"
    count = F.regexp_extract(text, pattern, 1)
    number = F.replace(F.regexp_extract(text, pattern, 2), F.lit(","), F.lit(".")).try_cast("decimal(12,6)")
    times = F.when(count == "", F.lit(1).cast("decimal(6,0)")).otherwise(count.try_cast("decimal(6,0)"))
    return (number * times).try_cast("decimal(15,6)"), F.lower(F.regexp_extract(text, pattern, 3))


def net_grams(
    materials: DataFrame,
    texts: DataFrame,
    units: DataFrame,
    spellings: dict[str, list[str]] | None = None,
    language: str = "E",
) -> DataFrame:
    """Net weight of every material in grams: (matnr, gewei, source_unit, told_by, grams, net_g).

    ``told_by`` says what told the unit: ``gewei``, ``ntgew`` (written behind the number), ``text``
    (the weight stated in the wording, instead of ntgew), ``meins``, or null where nothing does.
    ``net_g`` is rounded half up; it is null unless the weight can be told.

    Defined cases: a material delivered several times counts once; a null matnr is no material; a
    gewei that names a unit of another dimension leaves the weight untold; null, blank or malformed
    ntgew tells nothing; an empty table gives no rows; other columns are not read. If several texts
    of one material and language differ, the alphabetically first counts.
    """
    spark = materials.sparkSession
    graph = UnitGraph(edges_from_units(units, spellings))
    if bad := graph.conflicts():
        raise ValueError(f"conversions disagree: {bad[:5]}")
    mass = sorted(graph.to("g"))
    conversions = graph.table(spark, ["g"])
    names = spark.createDataFrame([(u,) for u in sorted(graph.out)] or [("",)], "source_unit string").join(conversions, "source_unit", "left")
    # A row per unit, at most MAX_UNITS: whether a text names a unit, and if of mass, its grams.
    named_by = lambda df, text, p: df.join(F.broadcast(names.select(F.col("source_unit").alias(text), F.lit(True).alias(f"{p}unit"), F.col("factor").alias(f"{p}factor"), F.col("shift").alias(f"{p}shift"))), text, "left")
    m = (
        materials.select("matnr", "gewei", "ntgew", "meins")
        .where(F.col("matnr").isNotNull())
        .groupBy("matnr")
        .agg(F.min(F.struct("gewei", "ntgew", "meins")).alias("r"))
        .select("matnr", "r.*")
        .withColumns({"__g": unit_name(F.col("gewei")), "__n": amount(F.col("ntgew")), "__u": amount_unit(F.col("ntgew")), "__m": unit_name(F.col("meins"))})
    )
    m = named_by(named_by(m, "__g", "__g_"), "__u", "__u_")
    named, written = F.col("__g_unit").isNotNull(), F.col("__u_unit").isNotNull()
    pick = lambda c: F.when(named, F.col(f"__g_{c}")).otherwise(F.col(f"__u_{c}")).alias(c)
    told = m.where(named | written).select(
        "matnr", "gewei", F.col("__n").alias("__amount"),
        F.when(named, F.col("__g")).otherwise(F.col("__u")).alias("source_unit"),
        F.when(named, "gewei").otherwise("ntgew").alias("told_by"), pick("factor"), pick("shift"),
    )
    # Only the materials whose codes say nothing are joined to their wording.
    said, said_unit = stated_weight(F.col("maktx"), mass)
    wording = (
        texts.where(F.col("spras") == language)
        .select("matnr", said.alias("__said"), said_unit.alias("__said_unit"), "maktx")
        .where(F.col("__said").isNotNull() & (F.col("__said_unit") != ""))
        .groupBy("matnr")
        .agg(F.min(F.struct("maktx", "__said", "__said_unit")).alias("t"))
        .select("matnr", "t.__said", "t.__said_unit")
    )
    rest = named_by(named_by(m.where(~(named | written)).join(wording, "matnr", "left"), "__said_unit", "__s_"), "__m", "__m_")
    stated, in_meins = F.col("__said").isNotNull(), F.col("__m_factor").isNotNull()
    either = lambda a, b: F.when(stated, a).when(in_meins, b)
    rest = rest.select(
        "matnr", "gewei", either(F.col("__said"), F.col("__n")).alias("__amount"), either(F.col("__said_unit"), F.col("__m")).alias("source_unit"),
        either(F.lit("text"), F.lit("meins")).alias("told_by"), either(F.col("__s_factor"), F.col("__m_factor")).alias("factor"), either(F.col("__s_shift"), F.col("__m_shift")).alias("shift"),
    )
    grams = F.col("__amount") * F.col("factor") + F.col("shift")
    return (
        told.unionByName(rest)
        .select(
            "matnr", "gewei", "source_unit", "told_by",
            grams.cast("double").alias("grams"),
            F.round(grams, 0).cast("bigint").alias("net_g"),
        )
    )
