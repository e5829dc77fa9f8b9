import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from tallgrass.functions import nearpairs, similarity
from tallgrass.operators import matching
from tallgrass.operators.matching import Matching


def counted(monkeypatch, name):
    calls, real = [], getattr(matching, name)
    monkeypatch.setattr(matching, name, lambda *a, **k: calls.append(a) or real(*a, **k))
    return calls


@pytest.mark.parametrize("name", ["verdict_clusters", "verdict_findings", "cluster_members", "assessment"])
def test_deliveries_and_texts_are_sought_once(spark, small, monkeypatch, name):
    latest, texts, filled = (counted(monkeypatch, x) for x in ("latest_delivery", "one_text", "completeness"))
    entry_module.queries()[name](spark, small)
    assert (len(latest), len(texts)) == (1, 1)
    assert "text" not in filled[0][0].columns  # else the texts are joined again to count filled fields


@pytest.mark.parametrize("name", ["dedup_clusters", "dedup_weakest_link"])
def test_records_of_one_text_are_sought_once(spark, small, monkeypatch, name):
    classes, members = counted(monkeypatch, "classes"), counted(monkeypatch, "class_members")
    entry_module.queries()[name](spark, small)
    assert (len(classes), len(members)) == (1, 0)


@pytest.mark.parametrize("rows", [50_000, 0])
def test_copies_are_the_records_of_a_class_but_its_smallest(spark, monkeypatch, rows):
    monkeypatch.setattr(matching, "BROADCAST_ROWS", rows)
    m = Matching(block=("t",))
    data = [(f"{i:02d}", "ab"[i % 2], t) for i, t in enumerate(["hex bolt", "hex bolt", "hex bolt", "nut", "hex  Bolt", None, "nut", "nut", ""])]
    found = matching.candidates(spark.createDataFrame(data, "k string, t string, text string"), "k", "text", m)
    want = {("00", "02"), ("00", "04"), ("03", "07")}
    assert {tuple(r) for r in matching._copies(found).collect()} == want
    matching.class_pairs(found, m)
    assert {tuple(r) for r in matching._copies(found).collect()} == want


@pytest.mark.parametrize("rows", [50_000, 1])
def test_keys_of_one_row_are_not_shuffled(spark, monkeypatch, rows):
    monkeypatch.setattr(matching, "BROADCAST_ROWS", rows)
    data = [("a", 1, "x", "p"), ("a", 2, "w", "q"), ("b", 1, None, "p"), ("c", 3, "u", "p"), ("c", 3, "u", "q"), ("c", None, "z", "z"), (None, 9, "n", "n"), (None, 8, "o", "o"), ("d", None, None, None)]
    df = spark.createDataFrame(data, "k string, n int, v string, w string")
    got = matching.latest_delivery(df, "k", "n", "absent")
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == [("a", 2, "w", "q"), ("b", 1, None, "p"), ("c", 3, "u", "q"), ("d", None, None, None)]
    texts = matching.one_text(df, "k", "v", F.col("k").isNull() | (F.col("k") != "b")).collect()
    assert sorted(map(tuple, texts), key=str) == sorted([("a", "x"), ("c", "z"), ("d", None), (None, "o")], key=str)
    once, several = matching._apart(df, "k")
    if rows == 1:
        assert once is None and several.count() == len(data)
    else:
        assert "Exchange hashpartitioning" not in once._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["k"] for r in once.collect()) == ["b", "d"] and several.count() == len(data) - 2


def test_near_scores_what_is_moved_and_far_off(monkeypatch):
    # Pairs go as soon as too many of their letters have moved: whole words change places, in texts of up to 64 letters.
    monkeypatch.setattr(nearpairs, "STEP", 100)
    rng = random.Random(3)
    words = "alpha beta gamma delta 12x40 omega".split()
    texts = list(dict.fromkeys(" ".join(rng.sample(words, rng.randint(1, 6)))[: rng.randint(1, 64)] + rng.choice(["", "a" * 30, "é"]) for _ in range(90)))
    codes, bits = nearpairs.Letters(texts).placed()
    assert bits.ndim == 1 and codes.max() < len(bits)  # a letter's places are taken by one index
    for least in (0.5, 0.72, 0.8, 0.95):
        i, j, score = nearpairs.near("jaro_winkler", texts, [(0, len(texts), None, None)], least)
        pairs = [(x, y) if texts[x] < texts[y] else (y, x) for x in range(len(texts)) for y in range(x + 1, len(texts))]
        want = {p: s for p in pairs if (s := similarity.jaro_winkler(texts[p[0]], texts[p[1]])) >= least}
        assert len(i) == len(want) and dict(zip(zip(i.tolist(), j.tolist()), score)) == pytest.approx(want, abs=1e-12)
        assert np.all(score >= least)
