import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallgrass.llm import mixing, packing, residue
from tallgrass.llm.tokens import token_count


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), min_size=1, max_size=30))
def test_token_rule(spark, texts):
    texts = [t.replace("\x00", "") for t in texts] + ["a_b, c-d! ½² …x y z\x1cw"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(token_count(F.col("t"))).collect()]
    assert got == [len(re.findall(r"\w+|[^\w\s]+", t)) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 50), max_size=12))
def test_plan_places_everything(histogram):
    p = packing.plan(histogram, 32)
    used = {}
    for pattern in p.patterns:
        assert sum(n * k for n, k in pattern.slots) <= 32 and pattern.count > 0
        for n, k in pattern.slots:
            used[n] = used.get(n, 0) + k * pattern.count
    assert used == histogram and len(p.patterns) <= 2 * len(histogram) + 1
    # As many containers as if every text were put, the longest first, into the first that has room.
    gaps = []
    for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        at = next((i for i, g in enumerate(gaps) if g >= n), None)
        if at is None:
            gaps.append(32 - n)
        else:
            gaps[at] -= n
    assert p.containers == len(gaps) <= 2 * -(-sum(n * c for n, c in histogram.items()) // 32)


def test_tiers_are_packed_one_by_one():
    # Long windows are filled from the next shorter tier first, although a length of a lower tier would do.
    p = packing.plan({10: 2, 5: 1, 3: 2, 2: 9}, 16)
    assert {q.tier for q in p.patterns} == {16, 2}
    opened = {q.tier: q for q in p.patterns}
    assert all(max(packing.tier_of(n, 16) for n, _ in q.slots) == t for t, q in opened.items())
    first = next(q for q in p.patterns if (10, 1) in q.slots and (5, 1) in q.slots)
    assert all(packing.tier_of(n, 16) in (16, 8) for n, _ in first.slots)
    assert [q.filled for q in p.patterns] == sorted((q.filled for q in p.patterns), reverse=True) and [q.first for q in p.patterns] == [sum(x.count for x in p.patterns[:i]) for i in range(len(p.patterns))]


def test_a_tier_is_packed_among_itself_before_gaps_are_filled():
    # Three of the tier of 8 fit into 16 (5 + 5 + 6); packing them apart from it would leave room for none.
    p = packing.plan({6: 1, 5: 2, 1: 40}, 16)
    assert p.patterns[0].slots == [(6, 1), (5, 2)] and p.patterns[0].tier == 8


def test_capacity_is_checked():
    for c in (0, packing.MAX_CAPACITY + 1):
        with pytest.raises(ValueError):
            packing.plan({1: 1}, c)
    assert packing.plan({n: 3 for n in range(1, 8_193)}, 8_192).containers < 3 * 8_192


def test_step_groups_are_alike(spark):
    rnd = random.Random(8)
    got = packed(spark, [rnd.choice([16, 11, 9, 2, 1]) for _ in range(300)])
    sums = [r[1] for r in got.groupBy("step_group").agg(F.sum("piece_tokens")).collect()]
    assert len(sums) > 10 and max(sums) - min(sums) <= 2 * 16
    opened = got.where("container is not null").groupBy("container").agg(F.max("tier").alias("t"), F.max("container_tier").alias("c"))
    assert opened.where("t <> c").count() == 0


def test_tiers():
    assert [packing.tier_of(n, 1024) for n in (1, 2, 3, 512, 513, 1024)] == [1, 2, 4, 512, 1024, 1024]


def packed(spark, sizes, **how):
    df = spark.createDataFrame([(i, None if n is None else " ".join(["w"] * n)) for i, n in enumerate(sizes)], "doc_id long, text string")
    return packing.pack(df.withColumns({"id": F.lit(1), "tokens": F.lit(2), "length": F.lit(3)}), capacity=16, group_size=4, **how)


@pytest.mark.parametrize("rows", [100_000, 7])
def test_whole_where_they_fit_and_no_overlap(spark, rows):
    rnd = random.Random(2)
    sizes = [rnd.choice([3, 3, 3, 5, 9, 16]) for _ in range(120)] + [40, 32, 17, 0, None]
    got = packed(spark, sizes, rows_per_rank=rows).collect()
    by_doc, by_container = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        if r["container"] is not None:
            by_container.setdefault(r["container"], []).append((r["start"], r["piece_tokens"]))
    for doc, n in enumerate(sizes):
        pieces = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert sum(r["piece_tokens"] for r in pieces) == (n or 0) and len(pieces) == max(1, -(-(n or 0) // 16))
        assert {r["oversize"] for r in pieces} == {(n or 0) > 16}
    for spans in by_container.values():
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at = start + n
        assert at <= 16
    assert sorted(by_container) == list(range(len(by_container)))
    fill = packing.fill_report(packed(spark, sizes, rows_per_rank=rows), 16).first()
    assert fill["tokens"] == sum(n or 0 for n in sizes) and fill["fill"] > 0.9
    assert {r["doc_id"] for r in got if r["oversize"]} == {120, 121, 122}


def test_packing_nothing_and_repeats(spark):
    assert packed(spark, []).count() == 0
    one = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, " ")], "doc_id long, text string")
    got = packing.pack(one, capacity=4).collect()
    assert sorted((r["doc_id"], r["container"] is None) for r in got) == [(1, False), (1, False), (2, True)]
    assert len({r["container"] for r in got if r["container"] is not None}) == 2


def test_flight_keeps_both_sums():
    rng = np.random.default_rng(1)
    w = rng.integers(1, 400, 500)
    p = np.full(500, 0.37)
    q = mixing.fly(p, w)
    assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2 and q.min() >= 0 and q.max() <= 1
    assert abs(q.sum() - p.sum()) < 1e-6 and abs((q * w).sum() - (p * w).sum()) < 1e-3
    done = mixing.land(q, w)
    assert set(done) <= {0.0, 1.0} and abs((done * w).sum() - (p * w).sum()) < 400
    assert mixing.fly(np.array([]), np.array([])).size == 0
    assert set(mixing.land(mixing.fly(np.full(7, 0.5), np.full(7, 5)), np.full(7, 5))) <= {0.0, 1.0}


def mixed(spark, docs, targets, **how):
    d = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumns({"id": F.lit(1), "prob": F.lit(2), "copies": F.lit(3)})
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeat int")
    selection, report = mixing.mix(d, t, **how)
    return [tuple(r) for r in selection.collect()], {r["source"]: r for r in report.collect()}


@pytest.mark.parametrize("block", [20_000, 25])
def test_shares_and_repeats(spark, block):
    rnd = random.Random(4)
    docs = [(i, rnd.choice([" Big", "big ", "BIG", "big"]), "w " * rnd.randint(1, 30)) for i in range(600)]
    docs += [(1000 + i, "small", "w " * 10) for i in range(40)] + [(2000 + i, "tiny", "w w") for i in range(3)] + [(3000, "unlisted", "w"), (3001, None, "w"), (3002, "big", None), (3003, "small", " ")]
    rows, report = mixed(spark, docs, [("big", 0.6, 2), ("small", 0.35, 9), ("tiny", 0.04, 5), ("void", 0.01, 3)], block=block)
    assert report["void"]["need"] is None and report["void"]["passes"] == 0 and report["void"]["mixed_tokens"] == 0
    assert report["tiny"]["passes"] == 5 and report["tiny"]["mixed_tokens"] == 30
    total = sum(r["source_tokens"] for r in report.values())
    for s in ("big", "small"):
        assert abs(report[s]["mixed_tokens"] - report[s]["target_share"] * total) < 40
    copies = {}
    for _, s, _, n in rows:
        copies.setdefault(s, set()).add(n)
    assert copies["big"] == {1} and len(copies["small"]) <= 2 and copies["tiny"] == {5} and set(copies) == {"big", "small", "tiny"}
    assert abs(sum(r["reached_share"] for r in report.values()) - 1) < 1e-9
    assert len({r[0] for r in rows}) == len(rows)


def test_mixing_nothing(spark):
    rows, report = mixed(spark, [], [("a", 1.0, 2)])
    assert rows == [] and report["a"]["need"] is None and report["a"]["reached_share"] is None
    rows, report = mixed(spark, [(1, "a", "w")], [])
    assert rows == [] and report == {}


REAL = [
    "The buyer asked why the gross weight of {n} differs between A110 and B205.", "Delivery {n} contained hollow rivets instead of the ordered goods.", "Please compare material {n} with {n} before the next order.",
    "Order {n} is blocked until the lot size has been checked.", "Torque on the flanged spindle was {n} Nm, limit {n} Nm.", "Die Wiederbeschaffung dauert {n} statt {n} Tage.", "Plant A110 reports {n} open items, mostly about the volume unit.",
]
TALK = ["In the guide, tokens such as {{{{title}}}} or [[DATE]] are replaced when the record is saved; all {n} prints were complete.", 'The label template still showed "{{{{unit}}}}" on the proof, so we filled in the value and printed {n} labels.',
        "Ticket {n}: the catalogue answered with error 404 for {n} minutes; the link was repaired the same day.", "A demo record filled with lorem ipsum was deleted; the real text for {n} is in place."]
HOLES = ["Order {{{{ quantity }}}} is blocked until the lot size has been checked.", "Please compare material [insert matnr] with %MATNR% before the next order.", "Delivery <quantity> contained hollow rivets instead of the ordered goods.", "Plant __PLANT__ reports […] open items, mostly about the volume unit."]
ERRORS = ["Error 404: page not found\nRequest ID {n}\nPlease try again later.", "HTTP Status 503 – service unavailable\nPlease try again later.", "This page needs JavaScript to run.\nCookies are required.\nLoading…", "Please enable JavaScript to open the catalogue. Loading…"]
FILLER = ["lorem ipsum dolor sit amet, lorem ipsum dolor sit amet, lorem ipsum dolor sit amet", "asdf jkl asdf jkl asdf jkl asdf jkl", "Text goes here. Text goes here. Text goes here. Text goes here."]


def archive():
    rnd = random.Random(11)
    say = lambda t: t.format(n=rnd.randint(10, 99_999))
    docs, bad = [], set()
    for i in range(700):
        lines = [say(rnd.choice(REAL)) for _ in range(rnd.randint(1, 8))]
        if i % 7 == 1:
            lines.insert(rnd.randint(0, len(lines)), say(rnd.choice(TALK)))
        if i % 14 == 3:
            for _ in range(1 if i % 28 == 3 else 3):
                lines.insert(rnd.randint(0, len(lines)), say(rnd.choice(HOLES)))
            bad.add(i)
        text = " ".join(lines)
        if i % 20 == 5:
            text = say(rnd.choice(ERRORS + FILLER))
            bad.add(i)
        docs.append((i, text))
    return docs, bad


def test_residue_is_told_from_talk_about_it(spark):
    docs, bad = archive()
    df = spark.createDataFrame([*docs, (9000, None), (9001, ""), (9002, "  "), (docs[5][0], docs[5][1]), (None, "Error 404: page not found")], "doc_id long, text string").withColumns({"id": F.lit(1), "odds": F.lit(2), "n": F.lit(3)})
    got = residue.find_residue(df).collect()
    found = {r["doc_id"] for r in got}
    assert len(found) == len(got)
    assert len(found & bad) / len(bad) > 0.97 and len(found & bad) / len(found) > 0.97
    kinds = {r["doc_id"]: r["kind"] for r in got}
    assert kinds[3] == "unfilled" and kinds[5] == "junk" and max(r["share"] for r in got) <= 1


def test_residue_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert residue.find_residue(none).count() == 0
    real = spark.createDataFrame([(i, "The lot size has been checked.") for i in range(5)] + [(9, "x" * 50_000)], "doc_id long, text string")
    assert residue.find_residue(real).count() == 0


def test_hashes_agree_with_the_jvm(spark):
    words = ["lot", "größe", "a", "", "日本語", "x" * 300]
    got = [r[0] for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i").select(F.xxhash64("w")).collect()]
    assert got == [residue.hash_word(w) for w in words]


def test_no_limits_of_length(spark):
    # A long open place, a long error line, and an error page of many passages.
    docs, bad = archive()
    page = " ".join(["Error 503: service unavailable."] * 2 + ["Please try again later.", "Loading…"] * 4)
    line = "Error 404: page not found while the catalogue of the warehouse in the northern plant was asked for the open items of the order book today"
    extra = [(8001, "Order {{ " + "quantity of the goods that were ordered by the buyer in the northern plant" + " }} is blocked until the lot size has been checked."), (8002, line), (8003, page)]
    got = {r["doc_id"]: r["kind"] for r in residue.find_residue(spark.createDataFrame(docs + extra, "doc_id long, text string")).collect()}
    assert got.get(8001) == "unfilled" and got.get(8002) == "junk" and got.get(8003) == "junk"


def test_a_small_vocabulary_is_no_error(spark):
    docs, bad = archive()
    got = {r["doc_id"] for r in residue.find_residue(spark.createDataFrame(docs, "doc_id long, text string"), max_words=150).collect()}
    assert len(got & bad) / len(bad) > 0.9


def test_passages_and_marks(spark):
    text = "Same. Same. Same. Then 5 pcs!\n \u00a0 \nLast {{ x }} line"
    rows = residue.passages(spark.createDataFrame([(1, text)], "id long, text string")).collect()
    assert [r["first"] for r in rows] == [True] + [False] * 4
    thrice = lambda hashes, record: residue._thrice(np.array(hashes), np.array(record)).tolist()
    assert thrice([r["hash"] for r in rows], [0] * 5) == [True, True, True, False, False]
    assert thrice([1, 1, 1, 1, 2], [0, 0, 1, 1, 1]) == [False] * 5 and thrice([2, 1, 1, 1, 1], [0] * 5) == [False] + [True] * 4 and thrice([], []) == []
    assert [r["digits"] for r in rows] == [False] * 3 + [True, False] and [r["line"] is not None for r in rows] == [False] * 4 + [True]
    assert [r["size"] for r in rows] == [5, 5, 5, 11, 17]


def test_open_places():
    for text in ("on {{ date }} we", "on <date> we", "on «date» we", "on [TBD: date] we", "on [à compléter : date] we", "on %DATE% we", "on __DATE__ we", "on ~date~ we", "on ____ we", "on XX.XX.XXXX we", "on null_date we", "on (enter date) we", "on <!-- date --> we", "on &lt;date&gt; we"):
        assert residue.slots_of(text)[0] == 1, text
    for text in ('it said "{{ date }}" on', "„%DATE%“ als", "5 % to 7 %", "a < 5 and b > 3", "f(x) and x_y", "a & b"):
        assert residue.slots_of(text)[0] == 0, text
    assert residue.has_run("a b a b a b".split()) and not residue.has_run("a b c d e f".split())


def test_rows_of_megabytes_are_read_a_few_at_a_time(spark):
    import glob

    import pyarrow.parquet as pq

    from tallgrass.llm import residue
    from tallgrass.plans.staging import release, stage

    rows = stage(spark.range(0, 10, 1, 1), "wide", residue.GROUP_ROWS)
    groups = [pq.ParquetFile(f).metadata.row_group(i).num_rows for f in glob.glob(f"{rows._tallgrass_path.removeprefix('file://')}/*.parquet") for i in range(pq.ParquetFile(f).num_row_groups)]
    assert sum(groups) == rows.count() == 10 and max(groups) <= residue.GROUP_ROWS
    release(rows)
