import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallgrass.functions import similarity, text, values


def test_quantities_and_days(spark):
    df = spark.createDataFrame([("1.000,000", "1/4/2020"), ("-5,5", "02/30/2020"), ("nan", "00/00/0000"), ("1_000", "2020-01-01"), (None, None), (" 7 ", " 12/31/2021 "), ("", "")], "q string, d string")
    got = df.select(values.quantity(F.col("q")), values.day(F.col("d"))).collect()
    assert [r[0] for r in got] == [1000.0, -5.5, None, None, None, 7.0, None]
    assert [r[1] for r in got] == [datetime.date(2020, 1, 4), None, None, None, None, datetime.date(2021, 12, 31), None]
    assert spark.range(1).select(values.quantity_text(F.lit(1234.5))).first()[0] == "1.234,500"


def test_four_meanings_of_missing(spark):
    df = spark.createDataFrame([(None,), ("",), (" ",), ("nan",), ("None",), ("00/00/0000",), ("a",)], "x string")
    count = lambda f: df.where(f(F.col("x"))).count()
    assert [count(f) for f in (values.missing_strict, values.missing_or_blank, values.missing_text, values.missing_entry)] == [1, 4, 5, 4]


def test_normalise(spark):
    df = spark.createDataFrame([("Hex - Bolt  M8",), ("Écrou, Ø½",), (None,), (" NaN ",), ("a_b",)], "x string")
    assert [r[0] for r in df.select(text.normalise(F.col("x"))).collect()] == ["hex bolt m8", "ecrou ø1 2", "", "", "a_b"]


def test_signatures_and_disagreement(spark):
    df = spark.createDataFrame([("bearing 6203", "bearing 6204"), ("pump steel 12", "pump brass 12"), ("pump stainless steel", "pump steel"), ("a", "b 1"), ("steel steel", "steel")], "a string, b string")
    assert [r[0] for r in df.select(text.disagreement(F.col("a"), F.col("b"))).collect()] == ["digits", "material", "material", "", ""]


@pytest.mark.parametrize(
    ("name", "a", "b", "want"),
    [
        ("jaro_winkler", "hex bolt m8 stainless steel", "bolt m8 stainless", 0.7981),
        ("token_sort_ratio", "motor reinforced bronze 209", "motor reinforced bronze 79", 0.9434),
        ("token_sort_ratio", "bolt steel 12", "bolt brass 12", 0.6923),
        ("token_sort_ratio", "bearing 6203", "bearing 6204", 0.9167),
        ("token_sort_ratio", "hex bolt m8 6203", "m8 hex bolt 6203", 1.0),
        ("token_set_ratio", "hex bolt", "hex bolt m8", 1.0),
        ("ratio", "", "", 1.0),
    ],
)
def test_anchors(name, a, b, want):
    assert round(similarity.METRICS[name](a, b), 4) == want


@settings(max_examples=60, deadline=None)
@given(st.text("abcä 1", max_size=14), st.text("abcä 1", max_size=14))
def test_lcs_against_the_table(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert similarity.lcs_length(a, b) == table[-1][-1]
    for f in similarity.METRICS.values():
        assert 0 <= f(a, b) <= 1 and abs(f(a, b) - f(b, a)) < 0.2


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.text("abcä 1", max_size=20), st.text("abcä 1", max_size=70)), max_size=12))
def test_batches_equal_single_scores(pairs):
    left, right = [a for a, _ in pairs] + ["x" * 64, "x" * 65, "", "ab" * 32], [b for _, b in pairs] + ["x" * 64, "x" * 64, "", "ba" * 32]
    for name, one in similarity.METRICS.items():
        assert similarity.scores(name, left, right).tolist() == pytest.approx([one(a, b) for a, b in zip(left, right)], abs=1e-12)
    assert similarity.scores("ratio", [], []).tolist() == []


def test_arrow_metric_and_cosine(spark):
    df = spark.createDataFrame([("ab", "ab", [1.0, 0.0], [0.0, 2.0]), (None, "a", [0.0, 0.0], [1.0, 1.0]), ("ab", "ac", [1.0, 1.0], [2.0, 2.0])], "a string, b string, x array<float>, y array<float>")
    got = df.select(similarity.metric("ratio")("a", "b"), similarity.cosine(F.col("x"), F.col("y"))).collect()
    assert [r[0] for r in got] == [1.0, None, 0.5]
    assert [round(r[1], 6) for r in got] == [0.0, 0.0, 1.0]
    with pytest.raises(ValueError):
        similarity.metric("soundex")
    similarity.register(spark)
    assert spark.sql("select token_sort_ratio('b a', 'a b')").first()[0] == 1.0


def test_batches_of_any_length_equal_single_pairs():
    import random

    rnd = random.Random(1)
    text = lambda: "".join(rnd.choice("abc dé") for _ in range(rnd.choice([0, 1, 5, 63, 64, 65, 127, 128, 129, 400])))
    left = [text() for _ in range(200)]
    right = [x[:-2] + "x" if i % 3 else text() for i, x in enumerate(left)]
    for name, one in similarity.METRICS.items():
        assert similarity.scores(name, left, right).tolist() == [one(a, b) for a, b in zip(left, right)]
        assert len(similarity.scores(name, [], [])) == 0
