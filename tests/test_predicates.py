"""Every comparison against value, null and '', and the connectives' truth tables."""

import itertools

import pytest
from pyspark.sql import functions as F

from tallgrass.operators.compile import to_column, violated
from tallgrass.operators.ir import Bool, Comparison, Rule, fields_of, load_rules, predicate, repeated_ids

C = Comparison


@pytest.mark.parametrize(
    ("p", "want"),
    [
        (C("x", "is_null"), (False, True, False)),
        (C("x", "is_not_null"), (True, False, True)),
        (C("x", "in", ["a"]), (True, None, False)),
        (C("x", "in", ["b", None]), (False, None, False)),
        (C("x", "in", []), (False, None, False)),
        (C("x", "not_in", []), (True, None, True)),
        (C("x", "not_in", ["a"]), (False, None, True)),
        (C("x", "eq", "a"), (True, None, False)),
        (C("x", "ne", "a"), (False, None, True)),
        (C("x", "eq", 1), (False, None, False)),
        (C("x", "matches", "a|b"), (True, None, False)),
        (C("x", "gt", 0), (None, None, None)),
        (C("y", "is_null"), (None, None, None)),
    ],
)
def test_comparisons(spark, p, want):
    df = spark.createDataFrame([(0, "a"), (1, None), (2, "")], "i int, x string")
    got = [r[0] for r in df.orderBy("i").select(to_column(p, df.schema)).collect()]
    assert tuple(got) == want


def test_numbers_of_texts_and_columns(spark):
    df = spark.createDataFrame([("1.234,5", 1234.5), ("nan", float("nan")), ("x", None), ("", 2.0)], "t string, d double")
    for field, want in (("t", [True, None, None, None]), ("d", [True, None, None, False])):
        assert [r[0] for r in df.select(to_column(C(field, "ge", 1000), df.schema)).collect()] == want


def test_typed_columns_compare_by_value(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "i int")
    assert [r[0] for r in df.select(to_column(C("i", "in", [1, "zz"]), df.schema)).collect()] == [True, False, None]
    assert [r[0] for r in df.select(to_column(C("i", "ne", "zz"), df.schema)).collect()] == [True, True, None]


def test_matches_is_anchored_at_the_start_only(spark):
    df = spark.createDataFrame([("ab",), ("ba",), ("abc",)], "x string")
    assert [r[0] for r in df.select(to_column(C("x", "matches", "ab"), df.schema)).collect()] == [True, False, True]


def kleene(op, a, b):
    if op == "and":
        return False if a is False or b is False else None if a is None or b is None else True
    if op == "or":
        return True if a is True or b is True else None if a is None or b is None else False
    return kleene("or", None if a is None else not a, b)


@pytest.mark.parametrize("op", ["and", "or", "implies"])
def test_connectives(spark, op):
    values = {"t": True, "f": False, None: None}
    data = list(itertools.product(values, values))
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "i int, a string, b string")
    p = Bool(op, [C("a", "eq", "t"), C("b", "eq", "t")])
    got = [r[0] for r in df.orderBy("i").select(to_column(p, df.schema)).collect()]
    assert got == [kleene(op, values[a], values[b]) for a, b in data]


def test_not_and_violation_are_never_null(spark):
    df = spark.createDataFrame([("a", "x"), (None, "x"), ("b", None)], "a string, s string")
    p = Bool("not", [C("a", "eq", "a")])
    got = [r[0] for r in df.select(violated(p, C("s", "is_not_null"), df.schema)).collect()]
    assert got == [True, False, False]
    assert [r[0] for r in df.select(violated(C("zz", "is_not_null"), None, df.schema)).collect()] == [False] * 3


def test_tree_validation_and_loading(tmp_path):
    with pytest.raises(ValueError):
        C("x", "like")
    with pytest.raises(ValueError):
        Bool("not", [C("x", "is_null"), C("y", "is_null")])
    with pytest.raises(ValueError):
        Rule("R", "t", "other", C("x", "is_null"), severity="Awful")
    raw = {"op": "or", "args": [{"field": "x", "op": "in", "value": ["a"]}, {"field": "y", "op": "is_null"}]}
    assert fields_of(predicate(raw)) == ["x", "y"]
    (tmp_path / "r.yaml").write_text("rules:\n- {rule_id: A, table: t, archetype: not_null, assertion: {field: x, op: is_not_null}}\n- {rule_id: A, table: t, label: Accuracy, assertion: {field: x, op: is_null}}\n")
    (tmp_path / "other.yaml").write_text("x: 1\n")
    got = load_rules(tmp_path)
    assert [r.dimension for r in got] == ["Completeness", "Validity"] and repeated_ids(got) == ["A"]


def test_a_column_may_hold_odd_names(spark):
    df = spark.createDataFrame([("a",)], ["we.ird"])
    assert df.select(to_column(C("we.ird", "eq", "a"), df.schema).alias("ok")).where(F.col("ok")).count() == 1
