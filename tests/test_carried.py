import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from tallgrass.functions import text
from tallgrass.operators import clusterview, decisions, matching
from tallgrass.operators.matching import Matching


@pytest.mark.parametrize("metric", ["jaro_winkler", "token_set_ratio", "token_sort_ratio"])
def test_pairs_carry_what_is_told_of_their_records(spark, metric):
    m = Matching(block=("t",), metric=metric)
    texts = ["hex bolt 12", "hex bolts 12", "hex  Bolt 12", "hex bolt", "nut 12", None, "hex bolt 12"]
    records = spark.createDataFrame([(f"{9 - i}", "a", x, i if i % 2 else None, f"g{i}") for i, x in enumerate(texts)], "k string, t string, text string, n int, g string")
    found = matching.candidates(records, "k", "text", m, keep=("n", "g"))
    told = {r["k"]: (r["n"], r["g"]) for r in records.collect()}
    pairs = matching.class_pairs(found, m, keep=("n", "g")).collect()
    assert len(pairs) > 2
    for r in pairs:
        assert (tuple(r["left_kept"]), tuple(r["right_kept"])) == (told[r["left_id"]], told[r["right_id"]])
    plain = matching.class_pairs(matching.candidates(records, "k", "text", m), m)
    assert "left_kept" not in plain.columns
    assert sorted(tuple(r[c] for c in plain.columns) for r in pairs) == sorted(map(tuple, plain.collect()))


def test_a_judge_by_rule_is_applied_as_one_that_wrote_verdicts_down(spark):
    pairs = spark.createDataFrame([("p1", 0.9), ("p2", 0.85), ("p3", 0.8)], "pair_key string, score double")
    decision = F.when(F.col("score") > 0.88, "duplicate").when(F.col("score") > 0.82, "uncertain")
    now = decisions.judged_by(pairs, decision, F.col("score"), F.lit("r"))
    written = now.where("decision is not null").select("pair_key", "decision", "confidence", "rationale", F.lit("f").alias("fingerprint"))
    later = decisions.apply_verdicts(pairs, written, "f")
    assert sorted(map(tuple, now.select(later.columns).collect())) == sorted(map(tuple, later.collect()))


def test_verdict_findings_seeks_nothing_by_pair(spark, small, monkeypatch, rows):
    want = rows(entry_module.queries()["verdicts_applied"](spark, small).where("decision = 'duplicate'").select("left_id", "right_id"))
    monkeypatch.setattr(decisions, "apply_verdicts", lambda *a: pytest.fail("verdicts were sought by pair"))
    assert rows(entry_module.queries()["verdict_clusters"](spark, small).select(F.least("survivor", "other"), F.greatest("survivor", "other"))) == want
    df = entry_module.queries()["verdict_findings"](spark, small)
    assert "SortMergeJoin" not in (plan := df._jdf.queryExecution().executedPlan().toString()) and plan.count("BroadcastHashJoin") <= 1
    assert df.count() == len(want)


def test_plain_texts_read_as_others(spark):
    # One text that isn't ASCII in a batch must not change how the others are read, nor the other way round.
    rng = random.Random(5)
    letters = "".join(map(chr, range(128)))
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(300)] + [None, "", "nan", " None ", "a_b  C", "--"]
    plain = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").coalesce(1)
    mixed = plain.unionByName(spark.createDataFrame([(1000, "Écrou Ø1,2"), (1001, "ﬁn Ⅳ é"), (1002, "é")], "i int, x string")).coalesce(1)
    want = {r[0]: r[1] for r in plain.select("i", text.normalise_plain(F.col("x"))).collect()}
    assert {r[0]: r[1] for r in plain.select("i", text.normalise(F.col("x"))).collect()} == want
    got = {r[0]: r[1] for r in mixed.select("i", text.normalise(F.col("x"))).collect()}
    assert got == want | {1000: "ecrou ø1 2", 1001: "fin iv e", 1002: "e"}


def test_cluster_members_seeks_members_once(spark, small, monkeypatch):
    sought, real = [], matching.clusters
    monkeypatch.setattr(matching, "clusters", lambda found, *a, **k: sought.append((found, k)) or real(found, *a, **k))
    df = entry_module.queries()["cluster_members"](spark, small)
    found, how = sought[0]
    assert {"norm", "text", "n_mandatory", "n_total"} <= set(how["keep"])
    assert found._tallgrass_path.rpartition("/")[2] not in "".join(df.inputFiles())  # else members are sought among all records again


def test_members_that_carry_tell_the_same_as_members_that_are_sought(spark, rows):
    m = Matching(block=("t",))
    data = [(f"k{i}", "ab"[i % 2], t, i % 3, i % 4) for i, t in enumerate(["hex bolt", "hex bolts", "Hex bolt", "hex bolt", "hex bolts x", None, "nut", "hex bolts", "nut"])]
    records = spark.createDataFrame(data, "k string, t string, text string, n_mandatory int, n_total int")
    found = matching.candidates(records, "k", "text", m, keep=("n_mandatory", "n_total"))
    bands = matching.banded(matching.class_pairs(found, m), m)
    plain = matching.clusters(found, bands, copies=True)
    full = matching.clusters(found, bands, copies=True, keep=("norm", "text", "n_mandatory", "n_total"))
    assert rows(full.select(plain.columns)) == rows(plain) and plain.count() > 4
    filled = records.select(F.col("k").alias("member"), "n_mandatory", "n_total")
    kept = matching.survivors(plain, filled, found)
    assert rows(matching.survivors(full)) == rows(kept)
    assert rows(clusterview.listing(full, kept, None, None, m)) == rows(clusterview.listing(plain, kept, found, filled, m))
    assert rows(matching.weakest_links(full, None, m)) == rows(matching.weakest_links(plain, found, m))
