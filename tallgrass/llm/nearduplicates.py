"""Records that name the same item, though written a little differently each time.

Each wording is brought to a set of tokens: sizes are written one way, slips and short forms are replaced by
the frequent word they stand for, words that say nothing are left out. All wordings are signed by universal
hash minima of their words; a different size is a different item, so sizes are part of every bucket. Wordings
whose whole signature is the same meet in one bucket, at its first one; the first ones enter the buckets of
their bands. What meets is verified by signature, then token by token, and joined by alternating large-star
and small-star.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.llm.components import stars
from tallgrass.llm.minhash import agreement, band_keys, banded_pairs, signer, universal
from tallgrass.llm.spelling import surplus_words, usual_number, writings
from tallgrass.plans.lookup import BROADCAST_ROWS, HEAVY_SHARE, broadcast_if_small, lookup
from tallgrass.plans.staging import release, stage

# Words that say nothing about an item; more are learned from the texts.
EMPTY_WORDS = ["new", "old", "std", "standard", "item", "assy", "assembly", "spare", "part", "compl", "complete", "misc", "etc"]

# Units of sizes and contents, by the form they are brought to.
SIZE_UNITS = {"kg": ["kg", "kgs", "kilo", "kilos"], "g": ["g", "gr", "grm", "gramm"], "lb": ["lb", "lbs"], "oz": ["oz"], "ml": ["ml"], "l": ["l", "ltr"], "mm": ["mm"], "cm": ["cm"], "kw": ["kw"], "v": ["v"]}

MARK = "~"

#: Records of one bucket that meet in one task, on either side.
CHUNK = 512
#: Different texts of one block and one set of sizes that are signed and banded within one task; more are spread by bucket.
MOST_LOCAL = 100_000


def code(column: Column) -> Column:
    """A trimmed code: no blanks at either end, upper case."""
    return F.upper(F.trim(column))


def tokens(text: Column) -> Column:
    """Tokens of a wording in lower case, with sizes and contents written one way."""
    t = F.translate(F.lower(text), "×*", "xx")
    t = F.regexp_replace(t, r"(?<=\d)[.,](?=\d)", "p")  # the decimal sign, either way
    t = F.regexp_replace(t, r"[^\p{L}\p{N}]+", " ")
    fraction = F.regexp_replace(F.regexp_replace(t, r"(\dp\d*?)0+(?![\dp])", "$1"), r"(?<=\d)p(?!\d)", "")
    t = F.when(t.rlike(r"\dp"), fraction).otherwise(t)
    t = F.regexp_replace(t, r"\b(dn|pn) (?=\d)|\b(m) (?=\d+ ?x ?\d)", "$1$2")
    t = F.regexp_replace(t, r"(?<=\d) ?x ?(?=\d)", "x")
    measured = t
    for short, names in SIZE_UNITS.items():
        measured = F.regexp_replace(measured, rf"(?<=\d) ?(?:{'|'.join(names)})(?![\p{{L}}\p{{N}}])", short)
    every = "|".join(n for names in SIZE_UNITS.values() for n in names)
    t = F.when(t.rlike(rf"\d ?(?:{every})(?![\p{{L}}\p{{N}}])"), measured).otherwise(t)
    return F.filter(F.split(F.trim(t), " "), lambda x: x != "")


def _is_word(x: Column) -> Column:
    return ~x.rlike(r"\d")


def replacements(texts: DataFrame, empty_words: Sequence[str] = EMPTY_WORDS, least_share: float = 1e-3) -> DataFrame:
    """(word, target): what to write instead of each word that isn't established.

    The target is the frequent word that is meant, '' for a word that says nothing, or the word with MARK
    before it if it is rare and stands for no other. Counts run over all texts.
    """
    words = texts.select(F.filter("raw", _is_word).alias("words"))
    counts = stage(words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word-counts")
    total = words.count()
    meant = stage(writings(counts), "writings")
    extra = stage(surplus_words(words, usual_number(words)), "surplus")
    silent = extra.select("word").join(meant, "word", "left_anti").unionByName(counts.where(F.col("word").isin(*empty_words)).select("word")).distinct()
    rare = counts.where((F.col("n") < max(2.0, total * least_share)) & (F.length("word") > 2)).select("word")
    rare = rare.join(meant, "word", "left_anti").join(silent, "word", "left_anti")
    # A word meant as one that says nothing says nothing either.
    placed = meant.join(silent, "word", "left_anti").join(silent.withColumnRenamed("word", "target").withColumn("__silent", F.lit(True)), "target", "left")
    out = stage(
        placed.select("word", F.when(F.col("__silent"), "").otherwise(F.col("target")).alias("target"))
        .unionByName(silent.select("word", F.lit("").alias("target")))
        .unionByName(rare.select("word", F.concat(F.lit(MARK), F.col("word")).alias("target"))),
        "replacements",
    )
    release(counts, meant, extra)
    return out


def _placed(texts: DataFrame, table: DataFrame) -> DataFrame:
    """``texts`` with their tokens as ``table`` says: ``item``, the different words in order and then the sizes, and ``n_words``.

    A table of up to BROADCAST_ROWS words (read no further than that to tell) goes to the tasks as it is;
    a larger one meets the words of the texts in a join. Both give the same.
    """
    few = table.limit(BROADCAST_ROWS + 1).collect()
    if len(few) <= BROADCAST_ROWS:
        swap = {r["word"]: r["target"] for r in few}
        has_digit = re.compile("[0-9]").search

        @F.pandas_udf("item array<string>, n_words int")
        def write(raw: pd.Series) -> pd.DataFrame:
            items, n_words = [], []
            for xs in raw:
                placed = {swap.get(x, x) for x in xs} - {""}
                words = sorted(x for x in placed if not has_digit(x))
                items.append([*words, *sorted(placed.difference(words))])
                n_words.append(len(words))
            return pd.DataFrame({"item": items, "n_words": n_words})

        return texts.withColumn("t", write("raw")).select(*texts.columns, "t.*")
    key = F.struct("id", "raw").alias("w")
    pairs = texts.select(key, F.explode(F.filter("raw", _is_word)).alias("word"))
    maps = lookup(pairs, table, "word").groupBy("w").agg(F.map_from_entries(F.collect_list(F.struct("word", "target"))).alias("swap"))  # one text's words
    written = F.transform("raw", lambda x: F.coalesce(F.when(F.col("swap").isNull(), x).otherwise(F.try_element_at("swap", x)), x))
    placed = texts.withColumn("w", key).join(maps, "w", "left").withColumn("placed", F.array_sort(F.array_distinct(F.filter(written, lambda x: x != ""))))
    words, sizes = F.filter("placed", _is_word), F.filter("placed", lambda x: ~_is_word(x))
    return placed.select(*texts.columns, F.concat(words, sizes).alias("item"), F.size(words).alias("n_words"))


def _same(a: Column, b: Column) -> Column:
    """Whether two different token sets name the same item.

    They do if one has only unplaced words more, or if they differ in one word each, not a size or
    mark, of which one is unplaced and within two edits of the other. Sets of established words don't.
    """
    only_a, only_b = F.array_except(a, b), F.array_except(b, a)
    rare = lambda x: x.startswith(MARK)
    bare = lambda x: F.ltrim(x, F.lit(MARK))
    more = (F.size(only_b) == 0) & F.forall(only_a, rare) | (F.size(only_a) == 0) & F.forall(only_b, rare)
    x, y = F.get(only_a, F.lit(0)), F.get(only_b, F.lit(0))
    swapped = (
        (F.size(only_a) == 1) & (F.size(only_b) == 1) & (rare(x) | rare(y)) & ~x.rlike(r"\d") & ~y.rlike(r"\d")
        & (F.least(F.length(bare(x)), F.length(bare(y))) > 2) & (F.levenshtein(bare(x), bare(y)) <= 2)
    )
    return F.coalesce(more | swapped, F.lit(False))


def group_items(
    records: DataFrame,
    id: str,
    text: str,
    block: Sequence[str],
    bands: int = 24,
    rows: int = 2,
    least_similarity: float = 0.3,
    least_words: int = 2,
    empty_words: Sequence[str] = EMPTY_WORDS,
) -> DataFrame:
    """(id, *block, item_id): each record with the smallest id of the records that name the same item.

    Only records of equal, non-null ``block`` values can be the same. A text needs a size and
    ``least_words`` words to name an item; null, blank and useless texts are left out. Repeated rows
    count once; a record with several texts is in the item of each. Columns not named are not read.

    Two different token sets that name the same item share at least half of the smaller set's words, a third
    of all, and mostly more: 24 bands of 2 rows bring 0.94 of the pairs that share a third together, 0.999 of
    those that share half and all that share everything. Pairs whose signatures estimate that less than
    ``least_similarity`` of the smaller set is shared are not compared token by token.
    """
    names = [f"b{i}" for i in range(len(block))]
    slim = records.select(F.col(id).alias("id"), *[F.col(c).alias(n) for c, n in zip(block, names)], F.col(text).alias("text"))
    slim = slim.dropna(subset=["id", "text", *names]).distinct()
    read = slim.select("id", *names, F.array_sort(F.array_distinct(tokens(F.col("text")))).alias("raw")).where(F.size("raw") > 0)
    texts = stage(read, "tokens")
    table = replacements(texts, empty_words=empty_words)
    signed = _signed(_placed(texts, table), names, bands * rows, least_words)
    release(texts, table)
    links = _links(signed, names, bands, rows, least_similarity)
    joined = stars(links, "left", "right").select(F.col("member").alias("v"), F.col("component.rep").alias("component"))
    result = stage(signed.join(joined, "v", "left").select(F.col("v.rep").alias("id"), *names, F.coalesce("component", "v.rep").alias("item_id")).distinct(), "items")
    release(signed, links)
    return result.select(F.col("id").alias(id), *[F.col(n).alias(c) for c, n in zip(block, names)], "item_id")


def _signed(texts: DataFrame, names: list[str], k: int, least_words: int) -> DataFrame:
    """(v, *names, item, n_words, place, whole): the texts (id, *names, raw, item, n_words) that name an item.

    ``v`` tells texts apart, also those of one record; ``place`` is a hash of what must be equal in every
    bucket, block and sizes, and ``whole`` one of that and all tokens. The ``k`` minima are taken where they are compared.
    """
    n, size = F.col("n_words"), F.size("item")
    named = texts.where((n >= least_words) & (size > n))
    place = F.xxhash64(*names, F.slice("item", n + 1, size - n))
    made = named.select(F.struct(F.col("id").alias("rep"), F.xxhash64("raw").alias("h")).alias("v"), *names, "item", "n_words", place.alias("place"))
    return stage(made.withColumn("whole", F.xxhash64("place", "item")), "signatures")


def _hashes() -> Column:
    return F.transform(F.slice("item", F.lit(1), F.col("n_words")), lambda x: F.xxhash64(x))


def _large_groups(df: DataFrame, by: list[str], most: int | None = None) -> DataFrame:
    """(*by, n): the groups of more than ``most`` (CHUNK) rows.

    Groups are first counted by a coarse hash, which costs little where none is large: only groups of cells of
    more than CHUNK rows are then counted one by one.
    """
    cells = df.count() // 64 + 1024
    cell = F.pmod(F.xxhash64(*by), F.lit(cells)).alias("__cell")
    full = stage(df.groupBy(cell).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most).select("__cell"), "full-cells")
    if full.isEmpty():
        return full.select(*[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in by], F.lit(0).alias("n")).limit(0)
    suspects = df.withColumn("__cell", cell).join(broadcast_if_small(full), "__cell", "left_semi")
    return suspects.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)


def pairs_within(df: DataFrame, by: Sequence[str], id: str) -> DataFrame:
    """(*by, a, b): the pairs of different ids of each group, a < b; pairs of groups with repeated rows may repeat.

    A group of more than CHUNK rows is cut into chunks by hash, and pairs of chunks are the join key, so a
    group that holds most rows is spread over tasks.
    """
    by = list(by)
    large = stage(_large_groups(df, by).select(*by, F.ceil(F.col("n") / CHUNK).alias("chunks")), "large-groups")
    a, b = df.select(*by, F.col(id).alias("a")), df.select(*by, F.col(id).alias("b"))
    if large.isEmpty():
        return a.join(b, by).where("a < b")
    large = broadcast_if_small(large)
    small = df.join(large, by, "left_anti")
    pairs = small.select(*by, F.col(id).alias("a")).join(small.select(*by, F.col(id).alias("b")), by).where("a < b")
    cut = stage(df.select(*by, id).join(large, by).withColumn("chunk", F.pmod(F.xxhash64(id), F.col("chunks"))), "chunks")
    a = cut.select(*by, F.col("chunk").alias("i"), F.explode(F.sequence(F.col("chunk"), F.col("chunks") - 1)).alias("j"), F.col(id).alias("a"))
    b = cut.select(*by, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunk"))).alias("i"), F.col("chunk").alias("j"), F.col(id).alias("b"))
    across = a.join(b, [*by, "i", "j"]).where((F.col("a") < F.col("b")) | ((F.col("i") != F.col("j")) & (F.col("a") != F.col("b"))))
    return pairs.unionByName(across.select(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def _whole_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The same rows in tables that end with a place's last row."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        place = batch.column("place").to_numpy()
        if not len(place):
            continue
        cut = int(np.flatnonzero(place != place[-1])[-1]) + 1 if place[0] != place[-1] else 0
        if held and held[-1].column("place")[-1].as_py() != place[0] and not cut:
            yield pa.Table.from_batches(held)
            held = []
        elif cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _met_locally(firsts: DataFrame, bands: int, rows: int, least_similarity: float) -> DataFrame:
    """(ra, rb): the texts ``r`` of one place that agree in a band and by their signatures, one at least with an unplaced word, as others can't be the same."""
    made = firsts.select("place", "r", F.col("r.n_words").alias("n"), F.exists("r.item", lambda x: x.startswith(MARK)).alias("odd"), _hashes().alias("hashes"))
    kind = made.schema["r"].dataType.simpleString()
    sign = universal(bands * rows)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_places(batches):
            t = t.combine_chunks()
            place, n, odd = t["place"].to_numpy(), t["n"].to_numpy(), t["odd"].to_numpy()
            hashes = t["hashes"].combine_chunks()
            minima = sign(hashes.flatten().to_numpy(), np.diff(hashes.offsets.to_numpy()))
            for i, j, likeness in banded_pairs(place, minima, bands, rows, odd):
                # The part of the smaller set that is shared, by the estimate of the Jaccard similarity.
                kept = likeness * (n[i] + n[j]) / (1 + likeness) / np.minimum(n[i], n[j]) >= least_similarity
                r = t["r"].combine_chunks()
                yield pa.RecordBatch.from_arrays([r.take(pa.array(i[kept])), r.take(pa.array(j[kept]))], names=["ra", "rb"])

    return made.repartition("place").sortWithinPartitions("place").mapInArrow(meet, f"ra {kind}, rb {kind}")


def _met_spread(firsts: DataFrame, bands: int, rows: int, least_similarity: float) -> DataFrame:
    """:func:`_met_locally` for places of many texts: a row a bucket, and full buckets cut into chunks."""
    firsts = stage(firsts.select(F.xxhash64("r.v", "r").alias("id"), "r", "place", signer(bands * rows)(_hashes()).alias("minima")), "crowded")
    banded = stage(firsts.select("id", F.explode(band_keys(F.col("minima"), bands, rows, F.col("place"))).alias("key")), "banded")
    met = stage(pairs_within(banded, ["key"], "id").select("a", "b").distinct(), "met")
    release(banded)
    side = lambda c: firsts.select(F.col("id").alias(c), F.col("r").alias(f"r{c}"), F.col("minima").alias(f"m{c}"))
    full = met.join(side("a"), "a").join(side("b"), "b").withColumn("likeness", agreement(F.col("ma"), F.col("mb")))
    k = F.col("ra.n_words"), F.col("rb.n_words")
    shared = F.col("likeness") * (k[0] + k[1]) / (1 + F.col("likeness")) / F.least(*k)
    return full.where(shared >= least_similarity).select("ra", "rb")


def _links(signed: DataFrame, names: list[str], bands: int, rows: int, least_similarity: float) -> DataFrame:
    """(left, right): texts that name the same item, as found by signatures and bands."""
    # Equal tokens: all of them meet their first one, never each other.
    first = ["whole", "place", *names, "item", "n_words"]
    firsts = stage(signed.groupBy(*first).agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("n")), "firsts")
    several, total = firsts.where("n > 1"), signed.count()
    heavy = several.where(F.col("n") > total / HEAVY_SHARE).select("whole").distinct()
    met_first = lookup(signed.select("whole", *names, "item", "v"), several.select("whole", F.struct(*names, "item").alias("r"), F.col("v").alias("right")), "whole", heavy)
    same = met_first.where((F.struct(*names, "item") == F.col("r")) & (F.col("v") != F.col("right"))).select(F.col("v").alias("left"), "right")
    # The first ones enter the buckets of their bands.
    kept = firsts.where("n_words > 0").select("place", "item", "n_words", F.struct("v", *names, "item", "n_words").alias("r"))
    crowded = stage(_large_groups(kept, ["place"], MOST_LOCAL).select("place"), "crowded-places")
    if crowded.isEmpty():
        met = _met_locally(kept, bands, rows, least_similarity)
    else:
        crowded = broadcast_if_small(crowded)
        met = _met_locally(kept.join(crowded, "place", "left_anti"), bands, rows, least_similarity)
        met = met.unionByName(_met_spread(kept.join(crowded, "place", "left_semi"), bands, rows, least_similarity))
    for n in names:  # places are hashes
        met = met.where(F.col(f"ra.{n}") == F.col(f"rb.{n}"))
    alike = met.where(_same(F.col("ra.item"), F.col("rb.item"))).select(F.col("ra.v").alias("left"), F.col("rb.v").alias("right"))
    links = stage(same.unionByName(alike), "links")
    release(firsts)
    return links


def material_items(mara: DataFrame, makt: DataFrame, language: str = "E") -> DataFrame:
    """(matnr, mtart, meins, item_id) of all materials, blocked on trimmed mtart and meins."""
    m = mara.select("matnr", code(F.col("mtart")).alias("mtart"), code(F.col("meins")).alias("meins")).dropna().distinct()
    t = makt.where(F.col("spras") == language).select("matnr", "maktx").dropna().distinct()
    return group_items(m.join(t, "matnr"), "matnr", "maktx", ["mtart", "meins"])


def item_pairs(items: DataFrame, id: str = "matnr", block: Sequence[str] = ("mtart", "meins")) -> DataFrame:
    """(matnr_a, matnr_b): all pairs of different records within an item, the smaller first.

    This is the one place where pairs are written out, because the result is defined as pairs. An item of
    most records is cut into chunks that meet in tasks of their own.
    """
    pairs = pairs_within(items, [*block, "item_id"], id)
    return pairs.select(F.col("a").alias(f"{id}_a"), F.col("b").alias(f"{id}_b")).distinct()
