import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallgrass.functions import nearpairs, similarity, text
from tallgrass.operators import matching
from tallgrass.operators.matching import Matching

WORDS = ["bolt", "nut", "washer", "hex", "copper", "brass", "12", "m8", "40x3", "é", "flange", "aaaaaaaa"]


def made_up(n, seed=4):
    rng = random.Random(seed)
    texts = sorted({" ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 2, 3, 4, 20]))) for _ in range(n)})
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("name", ["jaro_winkler", "token_set_ratio"])
@pytest.mark.parametrize("least", [0.4, 0.55, 0.7, 0.8, 0.93])
def test_near_is_all_pairs_scored(name, least, monkeypatch):
    monkeypatch.setattr(nearpairs, "SLAB", 500)
    monkeypatch.setattr(nearpairs, "STEP", 64)
    texts = made_up(120)
    veto = np.array([i % 3 for i in range(len(texts))])
    for groups in ([(0, len(texts), None, None)], [(0, 30, 30, 70), (70, 71, None, None), (71, 71, 71, 80), (80, len(texts), None, None)]):
        i, j, score = nearpairs.near(name, texts, groups, least, veto)
        want = {}
        for first, end, other, last in groups:
            for x in range(first, end):
                for y in range(x + 1, end) if other is None else range(other, last):
                    a, b = sorted((x, y), key=texts.__getitem__)
                    if (not veto[x] or not veto[y] or veto[x] == veto[y]) and (s := similarity.METRICS[name](texts[a], texts[b])) >= least:
                        want[a, b] = s
        assert len(i) == len(want) and dict(zip(zip(i.tolist(), j.tolist()), score)) == pytest.approx(want, abs=1e-12)


def test_near_of_nothing():
    assert [len(x) for x in nearpairs.near("jaro_winkler", [], [], 0.8)] == [0, 0, 0]
    assert [len(x) for x in nearpairs.near("jaro_winkler", ["", "a"], [(0, 2, None, None)], 0.8)] == [0, 0, 0]
    with pytest.raises(ValueError):
        nearpairs.near("ratio", ["a"], [], 0.8)


@pytest.mark.parametrize("metric", ["jaro_winkler", "token_set_ratio"])
@pytest.mark.parametrize("group", [2_048, 3])
def test_classes_meet_within_tasks(spark, monkeypatch, metric, group):
    # Large groups, texts without digits, copies and both vetoes; groups go on over the batches of a task.
    monkeypatch.setattr(matching, "GROUP", group)
    monkeypatch.setattr(matching, "_scored", lambda *a: pytest.fail("pairs were written out before they were scored"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    texts = [*made_up(60), *[f"hex bolt {w}" for w in ("copper", "brass", "coper", "x", "y")]]
    rows = [(f"{i:03d}", "bc"[i % 2], t) for i, t in enumerate([*texts, *texts[:7], *texts[:7]])]
    m = Matching(block=("t",), metric=metric)
    try:
        found = matching.candidates(spark.createDataFrame(rows, "k string, t string, text string"), "k", "text", m)
        got = [(r["left_id"], r["right_id"], r["n_pairs"], float(np.float32(r["score"])), r["veto"]) for r in matching.banded(matching.class_pairs(found, m), m).where("band <> 'below'").collect()]
        norms = [(r["block"], r["norm"], r["key"], r["m"]) for r in found.select("block", "norm", "key", text.material_signature(F.col("norm")).alias("m")).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    keys, words = {}, {}
    for b, n, k, w in sorted(norms):
        keys.setdefault((b, n), []).append(k)
        words[n] = w
    digits = lambda t: set(re.findall(r"\d+", t))
    agree = lambda x, y: not x or not y or x == y
    want = []
    for (b, x), kx in keys.items():
        if len(kx) > 1:
            want.append((min(kx), max(kx), len(kx) * (len(kx) - 1) // 2, 1.0, None))
        for (c, y), ky in keys.items():
            if b == c and x < y and agree(digits(x), digits(y)) and agree(words[x], words[y]) and (s := float(np.float32(similarity.METRICS[metric](x, y)))) >= m.review_low:
                want.append((min(kx + ky), max(min(kx), min(ky)), len(kx) * len(ky), s, None))
    assert set(got) == set(want) and len(got) == len(want) > 20
