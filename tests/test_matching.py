import random
import re

import pytest
from pyspark.sql import functions as F

from tallgrass.functions import similarity
from tallgrass.operators import matching
from tallgrass.operators.ir import Comparison
from tallgrass.operators.matching import Matching


def frame(spark, *texts, block="EA"):
    return spark.createDataFrame([(k, "HALB", block, t) for k, t in zip("ABCDEFGH", texts)], "k string, t string, u string, text string")


def run(spark, m, *texts):
    found = matching.candidates(frame(spark, *texts), "k", "text", m)
    return found, matching.banded(matching.score_pairs(found, m, count_vetoes=True), m)


def test_settings_are_checked():
    for bad in ({"metric": "x"}, {"fuzzy_weight": 0, "semantic_weight": 0}, {"fuzzy_weight": -1}, {"duplicate": 0.5, "review_low": 0.6}, {"veto_cap": 1.5}, {"duplicate": 1.2}):
        with pytest.raises(ValueError):
            Matching(**bad)
    assert Matching().bands(0.05) == (0.85, 0.97) and Matching().bands(0.5) == (0.98, 0.99)
    assert Matching().fingerprint != Matching(duplicate=0.93).fingerprint and len(Matching().fingerprint) == 12


def test_uncertain_pair_makes_no_cluster(spark):
    m = Matching(block=("t", "u"), duplicate=0.92, review_low=0.70)
    found, bands = run(spark, m, "Hex Bolt M8 Stainless Steel", "Bolt M8 Stainless")
    assert [r["band"] for r in bands.collect()] == ["review"]
    assert matching.clusters(found, bands).count() == 0


def test_chain_survivor_and_weakest_link(spark):
    m = Matching(block=("t", "u"), duplicate=0.85, review_low=0.70)
    found, bands = run(spark, m, "Hex Bolt M8 Stainless Steel", "Hex Bolt M8 Stainless", "Bolt M8 Stainless")
    members = matching.clusters(found, bands)
    assert sorted(r["member"] for r in members.collect()) == ["A", "B", "C"] and members.first()["cluster_id"] == "CL-0001"
    assert matching.weakest_links(members, found, m).first()["weakest_link"] < 0.85
    filled = spark.createDataFrame([("A", 2, 3), ("B", 2, 2), ("C", 1, 1)], "member string, n_mandatory int, n_total int")
    kept = matching.survivors(members, filled, found).first()
    assert (kept["survivor"], kept["reason"], kept["needs_steward"]) == ("A", "completeness", False)
    tied = matching.survivors(members, filled.withColumns({"n_mandatory": F.lit(1), "n_total": F.lit(1)}), found).first()
    assert (tied["survivor"], tied["reason"], tied["needs_steward"]) == ("A", "none", True)
    out = matching.duplicate_findings(members, matching.survivors(members, filled, found), "mara", "k").collect()
    assert sorted(r["record_id"] for r in out) == ["k=B", "k=C"] and {r["rule_id"] for r in out} == {"UNIQ_MARA_DUPLICATE"}


def test_identical_texts_keep_the_smallest_key(spark):
    m = Matching(block=("t", "u"))
    found, bands = run(spark, m, "Hex Bolt M8", "Hex  -  Bolt M8", "hex bolt m8")
    members = matching.clusters(found, bands)
    kept = matching.survivors(members, spark.createDataFrame([("C", 9, 9)], "member string, n_mandatory int, n_total int"), found).first()
    assert bands.count() == 3 and (kept["survivor"], kept["reason"]) == ("A", "identical")


def test_vetoes(spark):
    m = Matching(block=("t", "u"), metric="token_sort_ratio", duplicate=0.90, review_low=0.80)
    _, bands = run(spark, m, "Bearing 6203", "Bearing 6204")
    assert [(r["veto"], r["score"], r["band"]) for r in bands.collect()] == [("digits", 0.75, "below")]
    _, bands = run(spark, m, "Centrifugal Pump Housing Unit Steel 12", "Centrifugal Pump Housing Unit Brass 12")
    assert [r["veto"] for r in bands.collect()] == ["material"]
    _, bands = run(spark, m, "Hex Bolt M8 6203", "M8 Hex Bolt 6203")
    assert [(r["veto"], r["band"]) for r in bands.collect()] == [(None, "duplicate")]


def test_hold_backs_in_order(spark):
    df = spark.createDataFrame([("A", "H", "x"), ("B", "H", None), ("C", " ", "y"), ("D", "H", "z"), ("E", "Q", "only"), ("F", "H", " ")], "k string, t string, text string")
    m = Matching(block=("t",), most_block_pairs=0)
    found = matching.candidates(df, "k", "text", m, spark.createDataFrame([("B",)], "key string"))
    got = {r["key"]: r["reason"] for r in found.collect()}
    assert got == {"A": "block_too_large", "B": "validity_failed", "C": "no_blocking_key", "D": "block_too_large", "E": None, "F": "no_description"}
    scoped = matching.candidates(df, "k", "text", m, scope=Comparison("t", "eq", "Q"))
    assert [r["key"] for r in scoped.collect()] == ["E"]


def test_a_block_of_over_20_million_pairs_is_compared(spark):
    # 6,400 records with numbers of their own, which the veto keeps apart, and two pairs to be found.
    texts = spark.range(6_400).select(F.format_string("k%05d", "id").alias("k"), F.lit("b").alias("t"), F.format_string("bolt %d", "id").alias("text"))
    more = spark.createDataFrame([("x1", "b", "Housing Unit 77"), ("x2", "b", "Unit, Housing 77"), ("k99999", "b", "BOLT 5")], "k string, t string, text string")
    m = Matching(block=("t",), metric="token_sort_ratio")
    found = matching.candidates(texts.unionByName(more), "k", "text", m)
    assert found.where("reason is not null").count() == 0
    assert matching.block_sizes(found).first()["n_pairs"] == 6_403 * 6_402 // 2 > 20_000_000
    bands = matching.banded(matching.score_pairs(found, m), m)
    assert sorted((r["left_id"], r["right_id"], r["band"]) for r in bands.collect()) == [("k00005", "k99999", "duplicate"), ("x1", "x2", "duplicate")]


def test_length_bound_loses_nothing_and_spread_adds_up(spark, small):
    from tallgrass.queries import quality

    m = quality.SORTED
    found = quality._candidates(spark, small, m)
    bands = matching.banded(matching.score_pairs(found, m, count_vetoes=True), m)
    slim = matching.banded(matching.score_pairs(found, m), m).where("band <> 'below'")
    assert slim.exceptAll(bands.where("band <> 'below'")).count() == 0 == bands.where("band <> 'below'").exceptAll(slim).count()
    rows = [(r["block"], r["norm"], r["key"]) for r in found.where("reason is null").collect()]
    want = set()
    for i, (b, x, k) in enumerate(rows):
        for c, y, j in rows[i + 1 :]:
            if b == c and similarity.token_sort(x, y) >= 0.80:
                want.add((min(k, j), max(k, j)))
    got = {(r["left_id"], r["right_id"]) for r in bands.collect() if r["raw"] >= 0.80}
    assert got == want
    spread = {r["band"]: r["n_pairs"] for r in matching.score_spread(found, bands).collect()}
    assert sum(spread.values()) == matching.block_sizes(found).agg(F.sum("n_pairs")).first()[0]


def test_vectors_count_only_in_blocks_that_have_them(spark):
    df = spark.createDataFrame([("A", "x", "ab", [1.0, 0.0]), ("B", "x", "ac", [1.0, 0.0]), ("C", "y", "ab", [1.0]), ("D", "y", "ac", None)], "k string, t string, text string, v array<double>")
    m = Matching(block=("t",), metric="ratio", fuzzy_weight=0.5, semantic_weight=0.5, duplicate=0.9, review_low=0.4)
    found = matching.candidates(df, "k", "text", m, vector="v")
    got = {r["left_id"]: r["score"] for r in matching.score_pairs(found, m, "v").collect()}
    assert got == {"A": 0.75, "C": 0.5}


def test_pair_key_and_content_code_ignore_order(spark):
    df = spark.createDataFrame([("1", "2", "a", "b"), ("2", "1", "b", "a"), ("1", "2", "b", "a")], "l string, r string, x string, y string")
    keys = [r[0] for r in df.select(matching.pair_key(*map(F.col, "lrxy"))).collect()]
    assert keys[0] == keys[1] != keys[2] and len(keys[0]) == 16
    t = spark.createDataFrame([("1", "a"), ("2", "b")], "k string, t string")
    code = lambda d: matching.content_code(d, "k", "t").first()["code"]
    assert code(t) == code(t.orderBy(F.desc("k"))) != code(t.limit(1))


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("left_id"), (F.col("id") + 1).alias("right_id"))
    got = matching.components(edges)
    assert got.count() == 61 and got.select("root").distinct().collect()[0][0] == 0
    assert matching.components(edges.limit(0)).count() == 0


def test_a_block_cut_into_chunks_keeps_every_pair(spark, monkeypatch):
    monkeypatch.setattr(matching, "CHUNK", 3)
    monkeypatch.setattr(matching, "PAIRS_A_TASK", 40)
    rows = [(f"{i:03d}", "b", f"item {i % 25} x") for i in range(30)] + [("900", "c", "item 1 x"), ("901", "c", "item 2 x")]
    df = spark.createDataFrame(rows, "k string, t string, text string")
    m = Matching(block=("t",), metric="ratio", duplicate=0.99, review_low=0.5, veto_cap=1.0)
    got = matching.score_pairs(matching.candidates(df, "k", "text", m), m)
    want = {(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if a[1] == b[1] and similarity.indel_ratio(a[2], b[2]) >= 0.5}
    pairs = [(r["left_id"], r["right_id"]) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_only_pairs_whose_digits_agree_are_met_where_the_veto_bars_the_rest(spark, monkeypatch):
    monkeypatch.setattr(matching, "CHUNK", 3)
    monkeypatch.setattr(matching, "PAIRS_A_TASK", 40)
    texts = [*[f"bolt {i} x" for i in range(20)], *[f"bolt {i % 2} y{i % 2} z" + "z" * i for i in range(20)], *[f"bolt {'v' * i}" for i in range(1, 9)]]
    rows = [(f"{i:03d}", "b", t) for i, t in enumerate([*texts, texts[0], texts[45]])] + [("900", "c", "bolt 1 x"), ("901", "c", "bolt 2 x")]
    m = Matching(block=("t",), metric="ratio", duplicate=0.99, review_low=0.5, veto_cap=0.4)
    found = matching.candidates(spark.createDataFrame(rows, "k string, t string, text string"), "k", "text", m)
    signed = matching._signed(found.groupBy("block", "norm").agg(F.count(F.lit(1)).alias("k")), m)
    digits = lambda t: set(re.findall(r"\d+", t))
    agree = lambda x, y: not digits(x) or not digits(y) or digits(x) == digits(y)
    met = [(r["left_norm"], r["right_norm"]) for r in matching._block_pairs(signed, alike=True).where("block = 'b'").collect()]
    want = {(x, y) for x in texts for y in texts if x < y and agree(x, y)} | {(texts[0], texts[0]), (texts[45], texts[45])}
    assert len(met) == len(set(met)) and set(met) == want
    got = [(r["left_id"], r["right_id"]) for r in matching.score_pairs(found, m).collect()]
    kept = {(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if a[1] == b[1] and agree(a[2], b[2]) and similarity.indel_ratio(a[2], b[2]) >= 0.4}
    assert len(got) == len(set(got)) and set(got) == kept


def test_near_pairs_are_those_of_all_pairs(spark, monkeypatch):
    rng = random.Random(4)
    words = ["bolt", "nut", "washer", "hex", "copper", "brass", "12", "m8", "40x3", "é", "flange"]
    texts = sorted({" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 20]))) for _ in range(160)})
    first, second = texts[::2], texts[1::2]
    for least in (0.55, 0.7, 0.75, 0.9):
        got = {(first[i], second[j]): s for i, j, s in zip(*similarity.jaro_winkler_near(first, second, least))}
        every = {(a, b): similarity.jaro_winkler(a, b) for a in first for b in second if a < b}
        assert got == pytest.approx({p: s for p, s in every.items() if s >= least}, abs=1e-12)
    assert [len(x) for x in similarity.jaro_winkler_near([], texts, 0.8)] == [0, 0, 0] == [len(x) for x in similarity.jaro_winkler_near(texts, [], 0.8)]
    # Counted vetoes: chunks meet in tasks, and no pair below the cap is written out.
    monkeypatch.setattr(matching, "WIDE_CHUNK", 16)
    monkeypatch.setattr(matching, "_block_pairs", lambda *a, **k: pytest.fail("all pairs were written out"))
    rows = [(f"{i:03d}", "b", t) for i, t in enumerate([*texts, texts[3], texts[3]])] + [("900", "c", texts[0]), ("901", "c", texts[1])]
    m = Matching(block=("t",))
    found = matching.candidates(spark.createDataFrame(rows, "k string, t string, text string"), "k", "text", m)
    got = {(r["left_id"], r["right_id"]): (round(r["raw"], 6), r["n_pairs"]) for r in matching.class_pairs(found, m, count_vetoes=True).where("block = 'b'").collect()}
    norm = {r["key"]: r["norm"] for r in found.collect()}
    heads = {norm[r[0]]: r[0] for r in reversed(rows[:-2])}
    k = {n: sum(norm[r[0]] == n for r in rows[:-2]) for n in heads}
    want = {(min(heads[x], heads[y]), max(heads[x], heads[y])): (round(s, 6), k[x] * k[y]) for x in heads for y in heads if x < y and (s := similarity.jaro_winkler(x, y)) >= 0.75}
    n = norm["003"]
    want[heads[n], max(r[0] for r in rows[:-2] if norm[r[0]] == n)] = (1.0, k[n] * (k[n] - 1) // 2)
    want |= {(heads[x], max(r[0] for r in rows[:-2] if norm[r[0]] == x)): (1.0, k[x] * (k[x] - 1) // 2) for x in heads if k[x] > 1}
    assert {p: n for p, (_, n) in got.items()} == {p: n for p, (_, n) in want.items()} and all(abs(got[p][0] - want[p][0]) < 1e-5 for p in want)


def test_components_of_a_long_chain_in_no_order_take_few_rounds(spark):
    ids = list(range(400))
    random.Random(2).shuffle(ids)
    edges = spark.createDataFrame([*zip(ids, ids[1:]), (1001, 1000)], "left_id long, right_id long")
    got = matching.components(edges, most_rounds=12)
    assert sorted(tuple(r) for r in got.collect()) == [*[(i, 0) for i in range(400)], (1000, 1000), (1001, 1000)]
