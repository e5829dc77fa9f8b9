import itertools

import numpy as np
from pyspark.sql import functions as F

from tallgrass.llm import minhash, nearduplicates as nd, spelling

FORMS = ["Bevelled", "Hollow", "Zigzag", "Flanged", "Narrow", "Rotary"]
THINGS = ["Washer", "Spindle", "Rivet", "Gearbox", "Louvre"]
STUFF = ["Copper", "Titanium", "Bronze", "Nylon"]


def corpus(spark, extra=()):
    """One record per combination, so every word is frequent, and what is to be tested."""
    rows = [(f"m{i:04d}", "HALB", "ST", f"{f} {t} 10x{20 + i % 3} {s} ET") for i, (f, t, s) in enumerate(itertools.product(FORMS, THINGS, STUFF))]
    return spark.createDataFrame(rows + list(extra), "id string, mt string, me string, text string")


def groups(df):
    out = {}
    for r in nd.group_items(df, "id", "text", ["mt", "me"]).collect():
        out.setdefault((r["item_id"], r["mt"], r["me"]), set()).add(r["id"])
    return [v for v in out.values() if len(v) > 1]


def test_tokens_write_sizes_one_way(spark):
    same = [
        ["Resin 12,5 kg", "RESIN 12.5KG", "resin 12,50 Kilo", "Resin_12.5_kgs"], ["Pin M12x30", "pin m 12 X 30", "PIN M12×30", "Pin M12*30", "Pin, M12 x 30"],
        ["Elbow DN80 PN6", "elbow dn 80 / pn 6"], ["Glue 4 x 45 g", "GLUE 4X45GR", "glue 4*45g"], ["Heater 2 kW 48 V", "heater 2KW, 48V"], ["Tin 2lbs", "tin 2 LB"],
    ]
    for texts in same:
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        got = {tuple(r[0]) for r in df.select(nd.tokens(F.col("t"))).collect()}
        assert len(got) == 1, got
    other = spark.createDataFrame([("Glue 12,5kg",), ("Glue 1,25kg",), ("Glue 125 g",), ("Glue 10x5",), ("Glue 100 kg",), ("Glue 10 kg",)], "t string")
    assert other.select(nd.tokens(F.col("t")).alias("x")).distinct().count() == 6


def test_writings_of_frequent_words(spark):
    counts = [("copper", 900), ("bevelled", 800), ("washer", 700), ("hatch", 600), ("ratchet", 500), ("et", 5000), ("copprr", 2), ("coppre", 3), ("cppr", 4), ("bevel", 5), ("bvlld", 2), ("wsher", 1), ("ratch", 2), ("zzz", 3), ("dasher", 650), ("10x2", 1)]
    got = {r["word"]: r["target"] for r in spelling.writings(spark.createDataFrame(counts, "word string, n long")).collect()}
    assert got == {"copprr": "copper", "coppre": "copper", "cppr": "copper", "bevel": "bevelled", "bvlld": "bevelled", "wsher": "washer", "ratch": "ratchet"}
    assert spelling.writings(spark.createDataFrame([], "word string, n long")).count() == 0


def test_slips_orders_and_empty_words_come_together(spark):
    extra = [
        ("a1", "HALB", "ST", "Washer, Bevelled 10x77 Copper ET"), ("a2", "HALB", "ST", "BEVELLED WASHR 10 X 77 COPPER ET new"), ("a3", "HALB", "ST", " Bevel. Copper_ET - Washer 10*77 "), ("a4", "HALB", "ST", "item Bevelled Wahser 10×77 Cppr ET"),
        ("b1", "HALB", "ST", "Bevelled Washer 10x78 Copper ET"), ("b2", "ROH", "ST", "Bevelled Washer 10x77 Copper ET"), ("b3", "HALB", "ST", "Hollow Washer 10x77 Copper ET"), ("b4", "HALB", "ST", "Bevelled Washer 10x77 Copper UL"),
        ("n1", "HALB", "ST", None), ("n2", "HALB", "ST", ""), ("n3", "HALB", "ST", " . "), ("n4", "HALB", "ST", "."), ("n5", None, "ST", "Bevelled Washer 10x77 Copper ET"), (None, "HALB", "ST", "Bevelled Washer 10x77 Copper ET"), ("a1", "HALB", "ST", "Washer, Bevelled 10x77 Copper ET"),
        ("l1", "HALB", "ST", "Hollow Rivet 9x9 Nylon ET" + " " * 20_000), ("l2", "HALB", "ST", "Nylon ET Hollow Rivet 9x9"),
    ]
    got = groups(corpus(spark, extra))
    assert sorted(map(sorted, got)) == [["a1", "a2", "a3", "a4"], ["l1", "l2"]]
    assert groups(corpus(spark).limit(0)) == []


def test_an_unplaced_word_is_compared_by_signature(spark):
    words = "Bevelled Washer 10x77 Copper ET"
    extra = [("a1", "HALB", "ST", words), ("a2", "HALB", "ST", f"{words} Qwxyz"), ("a3", "HALB", "ST", "Hollow Washer 10x77 Copper ET Qwxyzz")]
    assert sorted(map(sorted, groups(corpus(spark, extra)))) == [["a1", "a2"]]


def test_swapped_and_added_words_are_all_found(spark):
    # 120 items of which each has a partner with one word two edits off, or with unplaced words more.
    rng = np.random.default_rng(5)
    slip = lambda i: "".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 9)) + str(i).translate(str.maketrans("0123456789", "abcdefghij"))
    extra = []
    for i in range(120):
        word, other = slip(i), slip(i + 500)
        base = ["Washer", f"10x{100 + i}", "Copper", "ET"][: 2 + i % 3]
        extra += [(f"s{i:03d}a", "HALB", "ST", " ".join([*base, word])), (f"s{i:03d}b", "HALB", "ST", " ".join([*base, "qq" + word[2:]]))]
        extra += [(f"t{i:03d}a", "HALB", "ST", " ".join(["Hollow", *base])), (f"t{i:03d}b", "HALB", "ST", " ".join(["Hollow", *base, word[::-1], other[: 5 + i % 3], other[::-1]]))]
    got = sorted(map(sorted, groups(corpus(spark, extra))))
    assert got == sorted([f"{k}{i:03d}a", f"{k}{i:03d}b"] for k in "st" for i in range(120))


def signed(spark, df):
    """The texts of a corpus as the operator signs them."""
    texts = df.select("id", F.col("mt").alias("b0"), F.col("me").alias("b1"), F.array_sort(F.array_distinct(nd.tokens(F.col("text")))).alias("raw"))
    return nd._signed(nd._placed(texts, nd.replacements(texts)), ["b0", "b1"], 48, 2)


def test_links_of_bands_against_brute_force(spark):
    # Twins with one word misspelt beyond the model, with a word inserted, and with words in another order.
    rng = np.random.default_rng(11)
    slip = lambda: "".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 8))
    extra = []
    for i in range(300):
        words = [FORMS[i % 6], THINGS[i % 5], STUFF[i % 4], "ET", f"10x{100 + i // 3}"][i % 3 :]
        odd, k = slip(), i % (len(words) - 1)
        a, b, c, d = list(words), list(words), list(words), list(words)
        a[k], b[k] = odd, "qq" + odd[2:]
        c = [*words, odd[::-1]]
        d = [words[j] for j in rng.permutation(len(words))]
        extra += [(f"x{i:03d}{n}", "HALB", "ST", " ".join(t)) for n, t in zip("abcd", (a, b, c, d))]
    got = signed(spark, corpus(spark, extra))
    left, right = got.alias("l"), got.alias("r")
    near = left.join(right, (F.col("l.b0") == F.col("r.b0")) & (F.col("l.b1") == F.col("r.b1")) & (F.col("l.v") < F.col("r.v"))).where(nd._same(F.col("l.item"), F.col("r.item")) | (F.col("l.item") == F.col("r.item")))
    want = {(r[0], r[1]) for r in near.select("l.v.rep", "r.v.rep").collect()}
    differ = {(r[0], r[1]) for r in near.where("l.item <> r.item").select("l.v.rep", "r.v.rep").collect()}
    links = {tuple(sorted((r[0]["rep"], r[1]["rep"]))) for r in nd._links(got, ["b0", "b1"], 24, 2, 0.3).collect()}
    # Equal token sets meet their first one only, so they are compared as groups.
    group = union_of(links)
    together = lambda pairs: sum(group.get(a, a) == group.get(b, b) for a, b in pairs)
    assert len(differ) > 300 and together(differ) >= 0.95 * len(differ) and together(want) >= 0.95 * len(want)


def union_of(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in list(parent)}


def test_all_rows_come_from_links(spark, monkeypatch):
    # Without what the bands and signatures link, no two wordings come together.
    extra = [("a1", "HALB", "ST", "Hollow Rivet 9x9 Nylon ET"), ("a2", "HALB", "ST", "Nylon Rivet, HOLLOW 9 x 9 ET std")]
    assert groups(corpus(spark, extra)) == [{"a1", "a2"}]
    links = nd._links
    monkeypatch.setattr(nd, "_links", lambda *how: links(*how).limit(0))
    assert groups(corpus(spark, extra)) == []


def test_a_large_table_of_words_is_joined(spark, monkeypatch):
    extra = [("a1", "HALB", "ST", "Hollow Rivet 9x9 Nylon ET"), ("a2", "HALB", "ST", "Nylon Rivt, HOLLOW 9 x 9 ET std")]
    monkeypatch.setattr(nd, "BROADCAST_ROWS", 0)
    assert groups(corpus(spark, extra)) == [{"a1", "a2"}]


def test_a_full_bucket_is_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(nd, "CHUNK", 3)
    keyed = spark.createDataFrame([("x", 7, f"r{i:02d}") for i in range(25)] + [("y", 7, "r00"), ("y", 7, "r99"), ("z", 7, "r00")], "b0 string, key long, rep string")
    got = [tuple(r) for r in nd.pairs_within(keyed, ["b0", "key"], "rep").select("b0", "a", "b").collect()]
    want = {("x", f"r{i:02d}", f"r{j:02d}") for i in range(25) for j in range(i + 1, 25)} | {("y", "r00", "r99")}
    assert len(got) == len(set(got)) and set(got) == want


def test_pairs_of_a_class(spark):
    items = spark.createDataFrame([("c", "x", "y", "1"), ("a", "x", "y", "1"), ("b", "x", "y", "1"), ("a", "x", "z", "1")], "matnr string, mtart string, meins string, item_id string")
    got = sorted(map(tuple, nd.item_pairs(items).collect()))
    assert got == [("a", "b"), ("a", "c"), ("b", "c")]


def test_a_hot_class_and_clashing_columns(spark):
    extra = [(f"h{i:03d}", "HALB", "ST", "Zigzag Gearbox 10x99 Bronze ET") for i in range(150)]
    df = corpus(spark, extra).withColumns({"word": F.lit(1), "item": F.lit(2), "rep": F.lit(3), "tokens": F.lit(4)})
    assert [len(g) for g in groups(df)] == [150]


def test_signatures_estimate_similarity(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**62), 2**62, 40).tolist()
    other = base[:32] + rng.integers(-(2**62), 2**62, 8).tolist()
    df = spark.createDataFrame([(1, base), (2, other), (3, list(reversed(base))), (4, []), (5, None)], "i int, t array<long>")
    signed = {r["i"]: r["s"] for r in df.select("i", minhash.signer(128)("t").alias("s")).collect()}
    assert signed[4] is None and signed[5] is None and signed[1] == signed[3] and len(signed[1]) == 256
    both = spark.createDataFrame([(bytes(signed[1]), bytes(signed[2]))], "a binary, b binary")
    assert abs(both.select(minhash.agreement("a", "b")).first()[0] - 32 / 48) < 0.15
    keys = both.select(*[minhash.band_keys(F.col(c), 16, 8, F.lit(p)) for c in "ab" for p in (1, 2)]).first()
    assert all(len(set(k)) == 16 for k in keys) and not set(keys[0]) & set(keys[1])
    minima = [np.frombuffer(bytes(signed[i]), np.uint16).reshape(16, 8) for i in (1, 2)]
    assert [x == y for x, y in zip(keys[0], keys[2])] == (minima[0] == minima[1]).all(axis=1).tolist()


def test_found_pairs_contain_the_confirmed_groups(spark, small):
    from tallgrass.llm.queries import p1_found

    pairs = {tuple(r) for r in p1_found(spark, small).collect()}
    code = lambda c: F.upper(F.trim(c))
    m = spark.read.parquet(f"{small}/mara.parquet").select("matnr", code("mtart").alias("a"), code("meins").alias("b")).distinct()
    t = spark.read.parquet(f"{small}/makt.parquet").where("spras = 'E'").select("matnr", nd.tokens(F.col("maktx")).alias("t")).distinct()
    full = m.join(t, "matnr").select("matnr", "a", "b", F.array_sort("t").alias("t"))
    same = full.alias("x").join(full.alias("y"), ["a", "b", "t"]).where("x.matnr < y.matnr and size(t) >= 4").select("x.matnr", "y.matnr")
    assert {tuple(r) for r in same.collect()} <= pairs


def test_bands_are_not_written_and_crowded_places_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(9)
    slip = lambda: "".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 9))
    extra = [(f"p{i:03d}", "HALB", "ST", f"Washer 10x{i % 3} Copper ET {slip()}") for i in range(90)]
    df = corpus(spark, extra + [(f"q{i:03d}", "HALB", "ST", t[3].replace(t[3][-9:-7], "qq")) for i, t in enumerate(extra)])
    staged, stage = [], nd.stage

    def seen(rows, label="step"):
        out = stage(rows, label)
        staged.append((label, out.count()))
        return out

    monkeypatch.setattr(nd, "stage", seen)
    local = sorted(map(sorted, groups(df)))
    assert len(local) >= 85 and max(n for label, n in staged if label != "word-counts") <= df.count()
    monkeypatch.setattr(nd, "MOST_LOCAL", 20)
    assert sorted(map(sorted, groups(df))) == local and "banded" in dict(staged)
