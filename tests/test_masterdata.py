import datetime
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallgrass.operators import skewgroups, units
from tallgrass.operators import valuecounts as vc

T0 = datetime.datetime(2024, 1, 1)


def brute(data):
    out = defaultdict(lambda: [0, set(), 0.0, None])
    for a, b, o, v, w in data:
        x = out[(a, b)]
        x[0] += 1
        if o is not None:
            x[1].add(o)
        if v is not None:
            x[2] += v
        if w is not None and (x[3] is None or w > x[3]):
            x[3] = w
    return {k: (x[0], len(x[1]), round(x[2], 6), x[3]) for k, x in out.items()}


def figures(spark, data, parts):
    df = spark.createDataFrame(data, "a string, b string, o string, v double, w timestamp_ntz").withColumn("__order", F.lit("clash"))
    got = skewgroups.figures_by_key(df, ["a", "b"], "o", "v", "w", parts)
    return {(r["a"], r["b"]): (r["n_rows"], r["n_items"], round(r["value_sum"], 6), r["latest"]) for r in got.collect()}


def test_one_key_over_many_partitions(spark):
    data = [("hot", "x", f"{i % 400:04d}", float(i % 7), T0 + datetime.timedelta(minutes=i)) for i in range(3000)]
    data += [("hot", None, "m", None, None), (None, None, None, 1.0, T0), ("cold", "x", None, None, None)]
    assert figures(spark, data, 6) == brute(data)
    df = spark.createDataFrame(data, "a string, b string, o string, v double, w timestamp_ntz")
    got = skewgroups.figures_by_key(df, ["a"], "o", "v", "w", 6).where("a = 'hot'").first()
    assert got["n_parts"] > 1 and got["row_share"] > 0.9


def test_one_value_of_one_key_is_cut_and_stitched(spark):
    data = [("k", "x", "same", float(i), T0) for i in range(2000)] + [("k", "x", "other", 1.0, T0)] * 50
    assert figures(spark, data, 5) == brute(data)


def test_empty_and_single(spark):
    assert figures(spark, [], None) == {}
    assert figures(spark, [("a", "b", None, None, None)], None) == {("a", "b"): (1, 0, 0.0, None)}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.just("x"), st.sampled_from(["1", "2", None]), st.sampled_from([None, 0.5, 2.0]), st.just(T0)), max_size=40))
def test_against_brute_force(spark, data):
    assert figures(spark, data, 3) == brute(data)


def test_graph_composes_and_checks():
    e = units.Edge
    g = units.UnitGraph([e("c", "k", Fraction(1), Fraction(27315, 100)), e("f", "c", Fraction(5, 9), Fraction(-160, 9)), e("mk", "k", Fraction(1, 1000))])
    f, o, n = g.to("mk")["f"]
    assert n == 3 and round(float(f * 212 + o)) == 373150 and g.conflicts() == []
    bad = units.UnitGraph([e("a", "b", Fraction(2)), e("b", "c", Fraction(3)), e("a", "c", Fraction(7))])
    assert bad.conflicts()
    with pytest.raises(ValueError):
        units.UnitGraph([e("a", "b", Fraction(0))])
    assert units.UnitGraph([]).to("x") == {}


def test_grams_by_what_tells_the_unit(spark):
    t006 = spark.createDataFrame([("MG", 1e-6, "KG"), ("G", 0.001, "KG"), ("KG", 1.0, "KG"), ("LB", 0.45359237, "KG"), ("OZ", 0.028349523125, "KG"), ("L", 1.0, "L"), (None, 2.0, "KG")], "msehi string, factor double, base_unit string")
    mara = spark.createDataFrame([
        ("1", " kg. ", "1.000,500", "EA"), ("2", "LBS", "1,000", "EA"), ("3", None, "2,5 lb", "EA"), ("4", "?", "7,000", "EA"), ("5", "", "3,000", "kg "), ("6", "-", "3,000", "EA"),
        ("7", "L", "3,000", "KG"), ("8", "g", "0,500", "EA"), ("9", "MG", "499,999", "EA"), ("10", None, None, "KG"), ("11", "KG", "x", "EA"), ("1", " kg. ", "1.000,500", "EA"), (None, "KG", "1,000", "EA"), ("12", None, "9,000", "KG"),
    ], "matnr string, gewei string, ntgew string, meins string")
    makt = spark.createDataFrame([("4", "E", "Resin 12 x 105 g Acetal"), ("6", "E", "Putty 41 L Mica"), ("6", "D", "Kitt 5 kg"), ("10", "E", "Grease_0,85 Kilo_UL"), ("12", "E", "x" * 5000 + " 2lbs"), ("5", "E", None)], "matnr string, spras string, maktx string")
    got = {r["matnr"]: (r["told_by"], r["net_g"]) for r in units.net_grams(mara, makt, t006).collect()}
    assert got == {
        "1": ("gewei", 1000500), "2": ("gewei", 454), "3": ("ntgew", 1134), "4": ("text", 1260), "5": ("meins", 3000), "6": (None, None), "7": ("gewei", None),
        "8": ("gewei", 1), "9": ("gewei", 0), "10": ("text", 850), "11": ("gewei", None), "12": ("text", 907),
    }
    assert units.net_grams(mara.limit(0), makt, t006).count() == 0 and units.net_grams(mara, makt.limit(0), t006).count() == 12


FIELDS = [vc.Field("t", "c", "code", "[AB]", True), vc.Field("t", "q", "quantity", vc.QUANTITY_RE, False)]


def counted(spark, data):
    df = spark.createDataFrame(data, "k string, c string, q string, load_no int").withColumn("n", F.lit(9))
    return vc.count_values(df, "t", ["c", "q"], ["k"])


def equal(a, b):
    return a.exceptAll(b.select(a.columns)).count() == 0 and b.exceptAll(a.select(b.columns)).count() == 0


def test_signed_deltas_equal_a_fresh_count(spark):
    first = [(str(i), "A", "1,000", 1) for i in range(5)] + [("x", None, " ", 2), ("x", "B", "***", 2), ("y", "B", "***", None)]
    again = [(str(i), "B", "1,000", 1) for i in range(3)]
    store = vc.ValueCounts.create(spark)
    assert store.state().count() == 0 and store.loads("t") == set()
    store.apply(counted(spark, first), "t")
    assert store.loads("t") == {1, 2, None} and store.deltas().where("n < 0").count() == 0
    store.apply(counted(spark, again), "t", [1])
    want = counted(spark, again + first[5:])
    assert equal(store.state(), want)
    assert store.deltas().where("n < 0").count() > 0
    assert equal(store.compact().deltas(), want)
    # The whole table again: load 2 is gone, load 3 is new; the store is found by its path.
    last = [*again, ("z", "A", "2,000", 3)]
    kept = vc.ValueCounts.create(spark, store.path)
    kept.apply(counted(spark, last), "t")
    assert equal(store.state(), counted(spark, last))


def test_an_unfinished_delta_does_not_count(spark):
    import os

    store = vc.ValueCounts.create(spark)
    store.apply(counted(spark, [("1", "A", "1,000", 1)]), "t")
    store.apply(counted(spark, [("2", "A", "1,000", 2)]), "t", [2])
    assert store.loads("t") == {1, 2}
    folder = next(f for f, _, load in store._folders() if load == 2)
    os.remove(f"{folder.removeprefix('file:')}/_SUCCESS")
    assert store.loads("t") == {1} and equal(store.state(), counted(spark, [("1", "A", "1,000", 1)]))


def test_of_two_writers_one_succeeds(spark, monkeypatch):
    store = vc.ValueCounts.create(spark)
    counts = counted(spark, [("1", "A", "1,000", 1)])
    late = vc.ValueCounts.create(spark, store.path)
    monkeypatch.setattr(late, "_deltas_of", lambda tab: 0)  # it looked before the other wrote
    monkeypatch.setattr(late, "loads", lambda tab: set())
    assert store.apply(counts, "t") and not late.apply(counts, "t") and equal(store.state(), counts)
    fields = [vc.Field("t", "c", "code", "[AB]", True)]
    with pytest.raises(RuntimeError):
        vc.bring_up_to_date(late, {"t": spark.createDataFrame([("1", "A", 1)], "k string, c string, load_no int")}, fields, {"t": ["k"]}, again=True)


def test_a_kept_store_is_only_read(spark, tmp_path, monkeypatch):
    fields = [vc.Field("t", "c", "code", "[AB]", True)]
    df = spark.createDataFrame([("1", "A", 1), ("2", "B", 2)], "k string, c string, load_no int")
    df.write.parquet(f"{tmp_path}/t.parquet")
    read = lambda: {"t": spark.read.parquet(f"{tmp_path}/t.parquet")}
    store = vc.bring_up_to_date(vc.ValueCounts.kept(spark, f"{tmp_path}/t.parquet"), read(), fields, {"t": ["k"]})
    monkeypatch.setattr(vc, "count_values", None)  # a second scan would fail
    again = vc.bring_up_to_date(vc.ValueCounts.kept(spark, f"{tmp_path}/t.parquet"), read(), fields, {"t": ["k"]})
    assert again.path == store.path and again.state().count() == 4
    df.limit(1).write.mode("append").parquet(f"{tmp_path}/t.parquet")
    assert vc.ValueCounts.kept(spark, f"{tmp_path}/t.parquet").path != store.path


def test_profile_from_counts(spark):
    s = vc.annotate(counted(spark, [("1", "A", "1,000", 1), ("1", "A", "x", 1), ("2", "C", None, 1), (None, " ", "2,000", 2)]), FIELDS)
    got = {r["field_name"]: r for r in vc.profile(s, False).collect()}
    assert (got["c"]["populated_pct"], got["c"]["distinct_count"], got["c"]["violations"]) == (75.0, 2, 1)
    assert round(got["c"]["entropy"], 4) == 0.9183 and (got["q"]["min_number"], got["q"]["max_number"]) == (1.0, 2.0)
    assert got["primary_key"]["is_unique"] is False and got["primary_key"]["repeated_rows"] == 2
    assert vc.profile(s.limit(0), True).count() == 0


def test_departures_against_brute_force(spark):
    import random

    rnd = random.Random(5)
    data = []
    for load in (1, 2, 3):
        for i in range(60):
            c = rnd.choice("AB") if load != 2 else rnd.choice(["B", "B", "B", "C"])
            c = None if load == 3 and i % 2 else c
            q = f"{rnd.randint(1, 9) * (100 if load == 1 else 1)},000"
            data.append((f"{load}-{i % (59 if load == 3 else 60)}", c, q, load))
    got = {tuple(r) for r in vc.departures(vc.annotate(counted(spark, data), FIELDS)).select("field_name", "load_no", "issue").collect()}
    want = set()
    for load in (1, 2, 3):
        here, there = [r for r in data if r[3] == load], [r for r in data if r[3] != load]
        for pos, f in ((1, FIELDS[0]), (2, FIELDS[1])):
            a, b = [r[pos] for r in here if r[pos]], [r[pos] for r in there if r[pos]]
            if abs(len(a) / len(here) - len(b) / len(there)) > 0.15:
                want.add((f.field_name, load, "null_rate"))
            if f.tracked:
                x, y = Counter(a), Counter(b)
                if sum(abs(x[v] / len(a) - y[v] / len(b)) for v in x | y) / 2 > 0.3:
                    want.add((f.field_name, load, "values"))
                if sum(v not in "AB" for v in a) / len(a) > 0.1:
                    want.add((f.field_name, load, "pattern"))
            else:
                m = lambda vs: sorted(float(v.replace(",", ".")) for v in vs)
                med = lambda s: (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2
                if not 0.2 <= med(m(a)) / med(m(b)) <= 5:
                    want.add((f.field_name, load, "range"))
    want.add(("primary_key", 3, "dup_key"))
    assert got == want and len({i for _, _, i in got}) == 5


def test_conversion_by_unit_and_target(spark):
    e = units.Edge
    g = units.UnitGraph([e("c", "k", Fraction(1), Fraction(27315, 100)), e("f", "c", Fraction(5, 9), Fraction(-160, 9)), e("g", "kg", Fraction(1, 1000)), e("lb", "kg", Fraction(45359237, 100000000))])
    rows = [(1, "212", "F", "K"), (2, "1500", " g. ", "KG"), (3, "1", "LB", "g"), (4, "3", "kg", "k"), (5, None, "g", "kg"), (6, "7", None, "kg"), (7, "7", "g", None), (8, "7", "?", "kg"), (9, "0", "c", "f"), (2, "1500", " g. ", "KG")]
    df = spark.createDataFrame(rows, "id int, n string, u string, t string").withColumns({"n": F.col("n").cast("decimal(15,6)"), "factor": F.lit("x"), "shift": F.lit("y"), "source_unit": F.lit("z")})
    got = units.convert(df, g, "n", "u", "t")
    assert {r["id"]: r["converted"] and round(float(r["converted"]), 6) for r in got.collect()} == {1: 373.15, 2: 1.5, 3: 453.59237, 4: None, 5: None, 6: None, 7: None, 8: None, 9: 32.0}
    assert got.count() == 10 and got.columns == [*df.columns, "converted"]
    assert units.convert(df.limit(0), g, "n", "u", "t").count() == 0


def test_combined_rows_count_as_many_but_weigh_once(spark):
    df = spark.createDataFrame([("A", "1", 2.0, None, 3), ("A", "2", None, None, 1), ("A", "3", 5.0, None, None), (None, "1", 1.0, None, 6)], "k string, m string, v double, d timestamp, n long")
    got = {r["k"]: (r["n_rows"], r["n_items"], r["value_sum"], r["n_valued"], r["row_share"]) for r in skewgroups.figures_by_key(df, ["k"], "m", "v", "d", rows="n").collect()}
    assert got == {"A": (4, 3, 7.0, 2, 0.4), None: (6, 1, 1.0, 1, 0.6)}
