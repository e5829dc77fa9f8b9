import datetime
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallgrass.llm import components as cc
from tallgrass.llm import survivors as sv


def union_find(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


WAYS = {"contract": cc.contract, "stars": cc.stars}


def run(spark, way, pairs):
    df = spark.createDataFrame(pairs, "a string, b string").withColumns({"u": F.lit(1), "r": F.lit(2), "component": F.lit(3)})
    return {r["member"]: r["component"] for r in WAYS[way](df, "a", "b").collect()}


@pytest.mark.parametrize("way", WAYS)
def test_chain_star_clique_and_noise(spark, way):
    rnd = random.Random(1)
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)]
    star = [("s000", f"s{i:03d}") for i in range(1, 300)]
    clique = [(f"k{i}", f"k{j}") for i in range(8) for j in range(8)]
    odd = [("x", "x"), ("y", None), (None, None), ("p", "q"), ("q", "p"), ("p", "q")]
    pairs = chain + star + clique + odd
    rnd.shuffle(pairs)
    got = run(spark, way, pairs)
    assert got == union_find(pairs) and "x" not in got and "y" not in got


def test_large_rounds_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(cc, "BROADCAST_ROWS", 3)
    rnd = random.Random(2)
    pairs = [(f"s{i % 7}", f"v{rnd.randint(0, 400)}") for i in range(300)] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(40)]
    assert run(spark, "contract", pairs) == union_find(pairs)


@pytest.mark.parametrize("way", WAYS)
def test_nothing(spark, way):
    assert run(spark, way, []) == {} and run(spark, way, [("a", "a"), (None, "b")]) == {}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcdefghij"), st.sampled_from("abcdefghij")), max_size=12))
def test_random_graphs(spark, pairs):
    want = union_find(pairs)
    assert run(spark, "contract", pairs) == want and run(spark, "stars", pairs) == want


def test_judged_links(spark):
    at = lambda d: datetime.datetime(2024, 1, d)
    rows = [
        ("000000000000000001", "2", 0.5, "duplicate", at(1)), ("2", "1", 0.99, "rejected", at(2)), ("3", "4", 0.92, None, at(1)), ("3", "5", 0.919, None, at(1)), ("6", "7", 0.1, "duplicate", at(1)),
        ("7", "6", 0.99, None, None), ("8", "8", 1.0, "duplicate", at(1)), ("9", None, 1.0, "duplicate", at(1)), (" ", "9", 1.0, "duplicate", at(1)), ("3", "6", 0.95, "review", at(1)), ("6", "7", 0.1, "duplicate", at(1)), ("4", "9", None, None, at(1)),
    ]
    df = spark.createDataFrame(rows, "left_matnr string, right_matnr string, score double, verdict string, decided_at timestamp_ntz")
    got = sorted((int(r[0]), int(r[1])) for r in cc.judged_links(df).collect())
    assert got == [(3, 4), (6, 7)] and all(len(r[0]) == 18 for r in cc.judged_links(df).collect())


def record(matnr, known=0, laeda=None, ersda=None, at=datetime.datetime(2024, 6, 1), **fields):
    base = dict.fromkeys(sv.COMPLETENESS_FIELDS)
    for f in sv.COMPLETENESS_FIELDS[:known]:
        base[f] = "v"
    return (matnr, laeda, ersda, at, *[fields.get(f, base[f]) for f in sv.COMPLETENESS_FIELDS])


SCHEMA = "matnr string, laeda string, ersda string, loaded_at timestamp_ntz, " + ", ".join(f"{f} string" for f in sv.COMPLETENESS_FIELDS)


def survive(spark, members, records):
    m = spark.createDataFrame(members, "group_no long, matnr string").withColumns({"n_known": F.lit(9), "b": F.lit(1)})
    return {r["group_no"]: r["matnr"] for r in sv.survivors(m, spark.createDataFrame(records, SCHEMA)).collect()}


def test_ranks_in_order(spark):
    records = [
        record("a", 3), record("b", 5), record("c", 5, laeda="01/02/2020"), record("d", 5, laeda="03.01.2020"), record("e", 5, laeda="20200103", ersda="2019-05-01"), record("f", 5, laeda="2020-01-03", ersda="4/30/2019"),
        record("g", 9, matkl="n.a.", bismt=" ", raube="?", tragr="TBD", spart="NULL"), record("h", 5, laeda="01/03/2030"), record("i", 5, laeda="02/30/2023"), record("b", 5), record("z", 1),
    ]
    members = [(1, "a"), (1, "b"), (2, "b"), (2, "c"), (2, "h"), (2, "i"), (3, "c"), (3, "d"), (4, "d"), (4, "e"), (4, "f"), (5, "g"), (5, "b"), (6, "zz"), (6, "yy"), (None, "a"), (7, None), (8, "b"), (8, "h"), (8, "i"), (8, "b"), (9, "zz"), (9, "z")]
    assert survive(spark, members, records) == {1: "b", 2: "c", 3: "d", 4: "f", 5: "b", 6: "yy", 8: "b", 9: "z"}
    assert survive(spark, [], records) == {} and survive(spark, [(1, "q")], []) == {1: "q"}


def test_a_hot_group_is_pruned_before_the_shuffle(spark, capsys):
    records = [record(f"m{i:04d}", i % 9) for i in range(500)]
    assert survive(spark, [(1, f"m{i:04d}") for i in range(500)], records) == {1: "m0008"}
    m = spark.createDataFrame([(1, "a")], "group_no long, matnr string")
    sv.survivors(m, spark.createDataFrame(records, SCHEMA)).explain()
    assert "row_number(), 1, Partial" in capsys.readouterr().out


def test_records_built_field_by_field(spark):
    records = [record("a", 0, matkl="A1", spart="00"), record("b", 0, matkl="?", bismt="B1", raube="R1", tragr="T"), record("c")]
    m = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "c")], "group_no long, matnr string")
    got = {r["group_no"]: r for r in sv.built_records(m, spark.createDataFrame(records, SCHEMA)).collect()}
    assert (got[1]["matnr"], got[1]["matkl"], got[1]["bismt"], got[1]["spart"], got[1]["aenam"]) == ("b", "A1", "B1", "00", None)
    assert got[2]["matnr"] == "c" and got[2]["matkl"] is None


def test_trust_ranks_after_completeness_and_before_dates(spark):
    fields = "matnr string, matkl string, bismt string, laeda string, ersda string, loaded_at timestamp"
    at = datetime.datetime(2024, 1, 1)
    records = spark.createDataFrame([("a", "L1", None, "12/01/2023", None, at), ("b", "L2", None, "01/01/2020", None, at), ("c", "L3", "x", None, None, at), ("d", None, "y", "12/30/2023", None, at)], fields)
    members = spark.createDataFrame([(1, "a", 0.2), (1, "b", 0.9), (1, "b", None), (2, "a", None), (2, "b", 0.1), (2, "c", None), (3, "a", None), (3, "b", float("nan")), (4, "b", 0.5), (4, "d", 0.4)], "g long, matnr string, score double")
    how = {"group": "g", "fields": ["matkl", "bismt"]}
    assert {tuple(r) for r in sv.survivors(members, records, trust="score", **how).collect()} == {(1, "b"), (2, "c"), (3, "a"), (4, "b")}
    assert {tuple(r) for r in sv.survivors(members, records, **how).collect()} == {(1, "a"), (2, "c"), (3, "a"), (4, "d")}
    built = {r["g"]: (r["matnr"], r["matkl"], r["bismt"]) for r in sv.built_records(members, records, trust="score", **how).collect()}
    assert built == {1: ("b", "L2", None), 2: ("c", "L3", "x"), 3: ("a", "L1", None), 4: ("b", "L2", "y")}
