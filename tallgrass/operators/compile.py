"""Predicates as Catalyst expressions with exact three-valued logic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgrass.functions.values import quantity
from tallgrass.operators import ir
from tallgrass.operators.ir import Comparison, Predicate

UNKNOWN = lambda: F.lit(None).cast("boolean")


def number(column: Column, kind: T.DataType) -> Column:
    """A number for ordered comparison: texts in the project's notation, typed columns as they are; NaN is unknown."""
    if isinstance(kind, T.StringType):
        return quantity(column)
    value = column.cast("double")
    return F.when(~F.isnan(value), value)


def _equal(column: Column, kind: T.DataType, value) -> Column:
    if isinstance(kind, T.StringType):
        return column == F.lit(str(value))
    literal = F.lit(str(value)).try_cast(kind)
    # A value that the type can't hold equals nothing.
    return F.coalesce(column == literal, F.lit(False))


def _compare(p: Comparison, schema: T.StructType) -> Column:
    if p.field not in schema.names or p.op == ir.UNKNOWN:
        return UNKNOWN()
    c, kind = F.col(f"`{p.field}`"), schema[p.field].dataType
    if p.op == "is_null":
        return c.isNull()
    if p.op == "is_not_null":
        return c.isNotNull()
    if p.op in ("gt", "ge", "lt", "le"):
        left, right = number(c, kind), F.lit(float(p.value))
        return {"gt": left > right, "ge": left >= right, "lt": left < right, "le": left <= right}[p.op]
    if p.op in ("in", "not_in"):
        # Nulls in the list are dropped and an empty list is false, not unknown, for a known value.
        hit = reduce(lambda a, b: a | b, (_equal(c, kind, v) for v in p.value if v is not None), F.lit(False))
        if isinstance(kind, T.StringType) and p.value:
            hit = c.isin(*[str(v) for v in p.value if v is not None]) if any(v is not None for v in p.value) else F.lit(False)
    elif p.op in ("eq", "ne"):
        hit = UNKNOWN() if p.value is None else _equal(c, kind, p.value)
    else:
        hit = c.cast("string").rlike(f"^(?:{p.value})")  # anchored at the start only
    return F.when(c.isNotNull(), ~hit if p.op in ("not_in", "ne") else hit)


def to_column(p: Predicate, schema: T.StructType) -> Column:
    """True, false or unknown per row. A field that the table lacks makes its comparison unknown."""
    if isinstance(p, Comparison):
        return _compare(p, schema)
    args = [to_column(a, schema) for a in p.args]
    if p.op == "not":
        return ~args[0]
    if p.op == "implies":
        return ~args[0] | args[1]
    return reduce(lambda a, b: a & b if p.op == "and" else a | b, args)


def violated(assertion: Predicate, scope: Predicate | None, schema: T.StructType) -> Column:
    """In scope, and the assertion known to be false. Never null."""
    broken = ~to_column(assertion, schema)
    if scope is not None:
        broken = to_column(scope, schema) & broken
    return F.coalesce(broken, F.lit(False))


