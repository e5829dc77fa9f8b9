"""Duplicate records within blocks: hold-back, scored pairs, vetoes, bands, clusters, survivors, findings."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tallgrass.functions.nearpairs import NEAR, near
from tallgrass.functions.similarity import METRICS, cosine, jaro_winkler_near, metric
from tallgrass.functions.text import MATERIAL_WORDS, digit_signature, disagreement, material_signature, normalise, signatures_differ
from tallgrass.operators.compile import to_column
from tallgrass.operators.ir import Predicate
from tallgrass.plans.lookup import BROADCAST_ROWS, broadcast_if_small, heavy_keys, lookup
from tallgrass.plans.numbering import numbered
from tallgrass.plans.staging import release, stage

MOST_BAND = 0.99
REASONS = ["validity_failed", "no_description", "no_blocking_key", "block_too_large"]


@dataclass(frozen=True)
class Matching:
    """Settings, checked on creation. Blocks of more than ``most_block_pairs`` pairs are held back; None compares all."""

    block: tuple[str, ...] = ()
    compare: str = "text"
    metric: str = "jaro_winkler"
    fuzzy_weight: float = 1.0
    semantic_weight: float = 0.0
    duplicate: float = 0.92
    review_low: float = 0.80
    veto_cap: float = 0.75
    materials: tuple[str, ...] = field(default=tuple(MATERIAL_WORDS))
    most_block_pairs: int | None = None

    def __post_init__(self):
        if self.metric not in METRICS:
            raise ValueError(f"unknown metric {self.metric!r}")
        if min(self.fuzzy_weight, self.semantic_weight) < 0 or self.fuzzy_weight + self.semantic_weight <= 0:
            raise ValueError("method weights must not be negative nor both 0")
        if not 0 < self.review_low < self.duplicate <= 1:
            raise ValueError("bands must satisfy 0 < review_low < duplicate <= 1")
        if not 0 <= self.veto_cap <= 1:
            raise ValueError("the veto cap must lie in [0, 1]")

    @property
    def shares(self) -> tuple[float, float]:
        total = self.fuzzy_weight + self.semantic_weight
        return self.fuzzy_weight / total, self.semantic_weight / total

    def bands(self, shift: float = 0.0) -> tuple[float, float]:
        """(review_low, duplicate) moved up by ``shift``, kept below MOST_BAND and in order."""
        top = round(min(self.duplicate + shift, MOST_BAND), 4)
        return round(min(self.review_low + shift, top - 0.01), 4), top

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:12]


def _apart(rows: DataFrame, key: str) -> tuple[DataFrame | None, DataFrame]:
    """(the rows whose key no other row has, all others): the former need no shuffle, and plans prune their columns; None where keys of several rows are many.

    Rows without a key are among the others.
    """
    again = stage(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key), "again")
    if again.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        release(again)
        return None, rows
    marked = rows.join(F.broadcast(again.withColumn("__again", F.lit(True))), key, "left")
    lone = F.col("__again").isNull() & F.col(key).isNotNull()
    return tuple(marked.where(x).select(*rows.columns) for x in (lone, ~lone))


def latest_delivery(records: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key: the latest delivery by the columns ``order``, ties by all others; with no null key."""
    order = [c for c in order if c in records.columns]
    rest = [c for c in records.columns if c not in order and c != key]
    once, several = _apart(records.where(F.col(key).isNotNull()), key)
    best = several.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("__r"))
    best = best.select(*[F.col(key) if c == key else F.col(f"__r.{c}").alias(c) for c in records.columns])
    return best if once is None else once.unionByName(best)


def one_text(texts: DataFrame, key: str, text: str, language: Column | None = None) -> DataFrame:
    """(key, text): one text per key, the greatest if there are several, as row order means nothing here."""
    kept = (texts.where(language) if language is not None else texts).select(key, F.col(text).alias("text"))
    once, several = _apart(kept, key)
    best = several.groupBy(key).agg(F.max("text").alias("text"))
    return best if once is None else once.unionByName(best)


def candidates(records: DataFrame, key: str, text: str, m: Matching, excluded: DataFrame | None = None, scope: Predicate | None = None, vector: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(key, text, norm, block, vector, ``keep``, reason): every record in scope once, with why it is held back (null: it isn't)."""
    kept = records if scope is None else records.where(F.coalesce(to_column(scope, records.schema), F.lit(False)))
    parts = [F.trim(F.col(b).cast("string")) for b in m.block]
    blank = F.lit(False)
    for p in parts:
        blank = blank | p.isNull() | p.isin("", "nan")
    rows = kept.select(
        F.col(key).cast("string").alias("key"), F.col(text).alias("text"), normalise(F.col(text)).alias("norm"), (F.concat_ws("\u001f", *parts) if parts else F.lit("")).alias("block"),
        blank.alias("blank"), *([F.col(vector).alias("vector")] if vector else []), *keep,
    )
    if excluded is not None:
        rows = rows.join(excluded.select(F.col(excluded.columns[0]).cast("string").alias("key"), F.lit(True).alias("out")).distinct(), "key", "left")
    else:
        rows = rows.withColumn("out", F.lit(None).cast("boolean"))
    early = F.when(F.col("out"), REASONS[0]).when(F.col("norm") == "", REASONS[1]).when(F.col("blank"), REASONS[2])
    rows = rows.withColumn("early", early)
    if m.most_block_pairs is None:
        rows = rows.withColumn("large", F.lit(None).cast("boolean"))
    else:
        sizes = rows.where("early is null").groupBy("block").agg(F.count(F.lit(1)).alias("k"))
        large = sizes.where(F.col("k") * (F.col("k") - 1) / 2 > m.most_block_pairs).select("block", F.lit(True).alias("large"))
        rows = rows.join(broadcast_if_small(large), "block", "left")
    reason = F.coalesce("early", F.when(F.col("large"), REASONS[3]))
    return rows.select("key", "text", "norm", "block", *(["vector"] if vector else []), *keep, reason.alias("reason"))


def held_back(found: DataFrame) -> DataFrame:
    return found.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n_records"))


def block_sizes(found: DataFrame) -> DataFrame:
    """(block, n_records, n_pairs) of the records that are compared or held back for their block's size."""
    kept = found.where((F.col("reason").isNull()) | (F.col("reason") == REASONS[3]))
    return kept.groupBy("block").agg(F.count(F.lit(1)).alias("n_records")).withColumn("n_pairs", (F.col("n_records") * (F.col("n_records") - 1) / 2).cast("bigint"))


#: Distinct texts of a block that meet in one task, on either side.
CHUNK = 512
#: The same where a task scores all pairs of two chunks itself.
WIDE_CHUNK = 4_096
#: Pairs that a task compares; where there are more than MOST_PARTS times as many, tasks compare more pairs each.
PAIRS_A_TASK, MOST_PARTS = 200_000, 100_000


def _block_pairs(texts: DataFrame, alike: bool = False) -> DataFrame:
    """Pairs of texts within blocks, the smaller left, each once; a text that stands in several records also meets itself.

    With ``alike`` these are only the pairs whose digit signatures don't differ: texts of one signature meet each
    other, and those without digits also all others of their block. A block (or its texts of one signature) is cut
    into chunks of about CHUNK texts by hash, and pairs of chunks are the join key, so one that holds most texts is
    spread over as many tasks as its pairs ask for. Each text is sent once per chunk of its block. The number of
    partitions follows the number of pairs, not the bytes sent, which say nothing here.
    """
    within = _pairs_within(texts, ["block", "d"] if alike else ["block"])
    return within.unionByName(_pairs_across(texts)) if alike else within


_TEXT = ("norm", "size", "k", "d", "m")


def _parts(pairs: DataFrame, pairs_a_task: int) -> int:
    return max(1, min(MOST_PARTS, int((pairs.agg(F.sum("pairs")).first()[0] or 0) // pairs_a_task)))


def _in_order(met: DataFrame, *more: str) -> DataFrame:
    swap = F.col("a.norm") > F.col("b.norm")
    side = lambda x, y, f: F.when(swap, F.col(f"{y}.{f}")).otherwise(F.col(f"{x}.{f}"))
    return met.select(
        "block", side("a", "b", "norm").alias("left_norm"), side("b", "a", "norm").alias("right_norm"), side("a", "b", "size").alias("ls"), side("b", "a", "size").alias("rs"),
        side("a", "b", "d").alias("ld"), side("b", "a", "d").alias("rd"), side("a", "b", "m").alias("lm"), side("b", "a", "m").alias("rm"), *more,
    )


def _pairs_within(texts: DataFrame, by: list[str]) -> DataFrame:
    """The pairs of texts that are equal in ``by``, the block among it."""
    a, b, keys = _chunk_pairs(texts, by, CHUNK, PAIRS_A_TASK)
    one = (F.col("i") != F.col("j")) | (F.col("a.norm") < F.col("b.norm")) | ((F.col("a.norm") == F.col("b.norm")) & (F.col("a.k") > 1))
    return _in_order(a.join(b, keys).where(one).withColumn("block", F.col("key_block")))


def _chunk_pairs(texts: DataFrame, by: list[str], size: int, pairs_a_task: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """(left, right, keys): texts ``a`` and ``b`` of the chunks of about ``size`` texts that meet, each once per chunk met, and what they meet by."""
    n = F.count(F.lit(1))
    sizes = texts.groupBy(*by).agg(F.ceil(n / size).alias("chunks"), (n * (n + 1) / 2).alias("pairs"))
    parts = _parts(sizes, pairs_a_task)
    large = sizes.where("chunks > 1").select(*[F.col(c).alias(f"large_{c}") for c in by], "chunks")
    cut = texts.join(broadcast_if_small(large), [F.col(c) == F.col(f"large_{c}") for c in by], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("bigint")))
    cut = cut.withColumn("chunk", F.pmod(F.xxhash64("norm"), F.col("chunks")))
    text, key = F.struct(*_TEXT), [F.col(c).alias(f"key_{c}") for c in by]
    a = cut.select(*key, F.col("chunk").alias("i"), F.explode(F.sequence(F.col("chunk"), F.col("chunks") - 1)).alias("j"), text.alias("a"))
    b = cut.select(*key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunk"))).alias("i"), F.col("chunk").alias("j"), text.alias("b"))
    keys = [*[f"key_{c}" for c in by], "i", "j"]
    a, b = (x.repartition(parts, *keys) for x in (a, b))
    return a, b, keys


def _near_pairs(texts: DataFrame, least: float) -> DataFrame:
    """:func:`_block_pairs` with ``fuzzy``, of a Jaro-Winkler similarity of ``least`` at least: whole chunks meet in a task, and only such pairs leave it."""
    a, b, keys = _chunk_pairs(texts, ["block"], WIDE_CHUNK, WIDE_CHUNK**2 // 4)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = left["a"].combine_chunks(), right["b"].combine_chunks()
        if not len(x) or not len(y):
            return schema.empty_table()
        xs, ys = pc.struct_field(x, "norm").to_pylist(), pc.struct_field(y, "norm").to_pylist()
        i, j, fuzzy = jaro_winkler_near(xs, ys, least)
        if left["i"][0] != left["j"][0]:
            back, forth, more = jaro_winkler_near(ys, xs, least)
            i, j, fuzzy = (np.concatenate(p) for p in ((i, forth), (j, back), (fuzzy, more)))
        else:  # the same texts on both sides; one of several records meets itself
            own, place = np.flatnonzero(pc.struct_field(x, "k").to_numpy() > 1), {t: n for n, t in enumerate(ys)}
            i, j, fuzzy = np.concatenate([i, own]), np.concatenate([j, [place[xs[n]] for n in own]]).astype(np.int64), np.concatenate([fuzzy, np.ones(len(own))])
        block = left["key_block"].combine_chunks().take(pa.array(i))
        return pa.Table.from_arrays([block, x.take(pa.array(i)), y.take(pa.array(j)), pa.array(fuzzy)], names=schema.names)

    text = a.schema["a"].dataType.simpleString()
    schema = pa.schema(to_arrow_schema(a.select(F.col("key_block").alias("block"), "a", F.col("a").alias("b"), F.lit(0.0).alias("fuzzy")).schema))
    met = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(meet, f"block string, a {text}, b {text}, fuzzy double")
    return _in_order(met, "fuzzy")


def _pairs_across(texts: DataFrame) -> DataFrame:
    """The pairs of a text without digits and one with digits of its block."""
    bare = F.size("d") == 0
    sizes = texts.groupBy("block").agg(F.count_if(bare).alias("e"), F.count_if(~bare).alias("n")).where("e > 0 and n > 0")
    parts = _parts(sizes.select((F.col("e") * F.col("n")).alias("pairs")), PAIRS_A_TASK)
    sizes = broadcast_if_small(sizes.select("block", F.ceil(F.col("e") / CHUNK).alias("rows"), F.ceil(F.col("n") / CHUNK).alias("columns")))
    cut, text, chunk = texts.join(sizes, "block"), F.struct(*_TEXT), F.xxhash64("norm")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    a = cut.where(bare).select("block", F.pmod(chunk, F.col("rows")).alias("i"), each("columns").alias("j"), text.alias("a"))
    b = cut.where(~bare).select("block", each("rows").alias("i"), F.pmod(chunk, F.col("columns")).alias("j"), text.alias("b"))
    a, b = (x.repartition(parts, "block", "i", "j") for x in (a, b))
    return _in_order(a.join(b, ["block", "i", "j"]))


#: Distinct texts of a group, on either side, that meet at once; pairs and texts that a task looks at.
GROUP, LOOKED_A_TASK, TEXTS_A_TASK = 2_048, 1_000_000, 25_000
#: Single precision may lift a score to a band by less than this.
SINGLE = 1e-6


def _met_alike(texts: DataFrame) -> DataFrame:
    """``texts`` once for each meeting: (key, side, ...), side 0 where all of a key meet each other, 1 and 2 where these meet those.

    Who meets is as in :func:`_block_pairs` with ``alike``. Rows of a key lie together, in the order of ``side``; the
    number of partitions follows pairs and texts.
    """
    n, bare = F.count(F.lit(1)), F.col("d") == ""
    own = stage(texts.groupBy("block", "d").agg(n.alias("n"), F.ceil(n / GROUP).alias("chunks")), "groups")
    blocks = own.groupBy("block").agg(F.sum(F.when(bare, F.col("n")).otherwise(0)).alias("e"), F.sum(F.when(bare, 0).otherwise(F.col("n"))).alias("n")).where("e > 0 and n > 0")
    work = own.select((F.col("n") * F.col("n") / 2).alias("pairs"), (F.col("n") * F.col("chunks")).alias("texts"))
    crossed = [F.ceil(F.col(c) / GROUP) for c in "en"]
    work = work.unionByName(blocks.select((F.col("e") * F.col("n")).alias("pairs"), (F.col("e") * crossed[1] + F.col("n") * crossed[0]).alias("texts")))
    pairs, copies = work.agg(F.coalesce(F.sum("pairs"), F.lit(0)), F.coalesce(F.sum("texts"), F.lit(0))).first()
    large = own.where("chunks > 1").select(F.col("block").alias("__b"), F.col("d").alias("__d"), "chunks")
    cut = texts.join(broadcast_if_small(large), (F.col("block") == F.col("__b")) & (F.col("d") == F.col("__d")), "left").drop("__b", "__d")
    chunk, last = F.pmod(F.xxhash64("norm"), F.coalesce("chunks", F.lit(1).cast("bigint"))), F.coalesce("chunks", F.lit(1).cast("bigint")) - 1
    cut = cut.withColumns({"x": chunk, "y": F.explode(F.sequence(F.lit(0).cast("bigint"), last))})
    key = lambda *parts: F.concat_ws("\u001f", *parts).alias("key")
    within = cut.select(key(F.lit("="), "block", "d", F.least("x", "y"), F.greatest("x", "y")), F.when(F.col("x") == F.col("y"), 0).when(F.col("x") < F.col("y"), 1).otherwise(2).alias("side"), *texts.columns)
    both = texts.join(broadcast_if_small(blocks.select("block", *[c.alias(a) for c, a in zip(crossed, ("rows", "columns"))])), "block")
    both = both.withColumn("x", F.pmod(F.xxhash64("norm"), F.when(bare, F.col("rows")).otherwise(F.col("columns"))))
    both = both.withColumn("y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(bare, F.col("columns")).otherwise(F.col("rows")) - 1)))
    place = [F.when(bare, F.col(a)).otherwise(F.col(b)) for a, b in ("xy", "yx")]
    across = both.select(key(F.lit("*"), "block", *place), F.when(bare, 1).otherwise(2).alias("side"), *texts.columns)
    parts = max(1, min(MOST_PARTS, int(pairs // LOOKED_A_TASK + copies // TEXTS_A_TASK)))
    # The hash leads, as most keys begin alike.
    return within.unionByName(across).withColumn("h", F.xxhash64("key")).repartition(parts, "h").sortWithinPartitions("h", "key", "side").drop("h")


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, ends): batches cut anew so that the rows of a key, which follow each other, are in one; where each key ends."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        if not rows.num_rows:
            continue
        ends = pc.run_end_encode(rows["key"].combine_chunks()).run_ends.to_numpy()
        start = int(ends[-2]) if len(ends) > 1 else 0
        rest = rows.slice(start)
        if start:
            yield rows.slice(0, start), ends[:-1]
    if rest is not None and rest.num_rows:
        yield rest, np.array([rest.num_rows])


def _near_classes(found: DataFrame, m: Matching, keep: Sequence[str] = ()) -> DataFrame:
    """(block, left_id, right_id, n_pairs, fuzzy, veto_by, left_kept, right_kept): :func:`class_pairs` where the veto bars what differs, down to the review band.

    The classes of a block and a digit signature meet within a task, which writes out only those that are near.
    """
    norm = F.col("norm")
    # Most texts hold none of the words, which one pattern tells sooner than the search that takes each out.
    said = norm.rlike("|".join(re.escape(w) for w in m.materials)) if m.materials else F.lit(False)
    signed = classes(found, keep).withColumns({"d": F.array_join(digit_signature(norm), ","), "m": F.when(said, F.array_join(material_signature(norm, m.materials), ",")).otherwise("")})
    # Told to what reads the same candidates later (see :func:`_copies`).
    texts = found._tallgrass_classes = stage(signed, "block-texts")
    name, least = m.metric, m.bands()[0] - SINGLE

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ends in _whole_keys(batches):
            side, groups, first = rows["side"].to_numpy(), [], 0
            for end in ends.tolist():
                middle = first + int(np.count_nonzero(side[first:end] == 1))
                groups.append((first, end, None, None) if side[first] == 0 else (first, middle, middle, end))
                first = end
            words = rows["m"].combine_chunks().dictionary_encode()
            veto = np.where(np.array(words.dictionary.to_pylist()) == "", 0, np.arange(1, len(words.dictionary) + 1))[words.indices.to_numpy()]
            i, j, fuzzy = near(name, rows["norm"].to_pylist(), groups, least, veto)
            k = rows["n_records"].to_numpy()
            block, of = rows["block"].combine_chunks(), [rows[c].combine_chunks() for c in told]
            i, j, n = pa.array(i), pa.array(j), pa.array(k[i] * k[j])
            yield pa.RecordBatch.from_arrays([block.take(i), *[x.take(i) for x in of], *[x.take(j) for x in of], n, pa.array(fuzzy)], names=["block", *[f"{s}_{c}" for s in "ab" for c in told], "n_pairs", "fuzzy"])

    told = ["rep", "rep_kept"] if keep else ["rep"]
    sides = ", ".join(f"{s}_{c} {texts.schema[c].dataType.simpleString()}" for s in "ab" for c in told)
    met = _met_alike(texts.drop("last", "last_kept")).mapInArrow(meet, f"block string, {sides}, n_pairs bigint, fuzzy double")
    a, b = (F.struct(*[F.col(f"{s}_{c}").alias(c) for c in told]) for s in "ab")
    k, names = F.col("n_records"), [f"{p}_{c}" for c in (["id", "kept"] if keep else ["id"]) for p in ("left", "right")]
    others = met.select("block", F.least(a, b).alias("l"), F.greatest(a, b).alias("r"), "n_pairs", "fuzzy")
    others = others.select("block", *[F.col(f"{p}.{c}").alias(n) for n, (c, p) in zip(names, [(c, p) for c in told for p in "lr"])], "n_pairs", "fuzzy")
    ends = ["rep", "last", "rep_kept", "last_kept"][: len(names)]
    itself = texts.where("n_records > 1").select("block", *[F.col(c).alias(n) for n, c in zip(names, ends)], (k * (k - 1) / 2).cast("bigint").alias("n_pairs"), F.lit(1.0).alias("fuzzy"))
    return others.unionByName(itself).withColumn("veto_by", F.lit(""))


def vector_pairs(df: DataFrame, block: str, id: str, vector: str, least: float) -> DataFrame:
    """(block, left_id, right_id, cosine): pairs of one block whose vectors' cosine is at least ``least``.

    Blocks are cut into chunks by hash, and pairs of chunks are the join key, so one that holds most rows is
    spread over tasks. Null blocks and null vectors match nothing.
    """
    rows = df.select(F.col(block).alias("b"), F.col(id).alias("id"), F.col(vector).alias("v")).dropna(subset=["b", "id", "v"])
    sizes = rows.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    cut = rows.join(broadcast_if_small(sizes), "b").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
    a = cut.select("b", F.col("chunk").alias("i"), F.explode(F.sequence(F.col("chunk"), F.col("chunks") - 1)).alias("j"), F.col("id").alias("x"), F.col("v").alias("p"))
    b = cut.select("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunk"))).alias("i"), F.col("chunk").alias("j"), F.col("id").alias("y"), F.col("v").alias("q"))
    pairs = a.join(b, ["b", "i", "j"]).where((F.col("x") < F.col("y")) | ((F.col("i") != F.col("j")) & (F.col("x") != F.col("y"))))
    scored = pairs.select(F.col("b").alias(block), F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id"), cosine(F.col("p"), F.col("q")).alias("cosine"))
    return scored.where(F.col("cosine") >= least)


def _signed(texts: DataFrame, m: Matching) -> DataFrame:
    n = F.col("norm")
    return texts.withColumns({"size": F.length(n), "d": digit_signature(n), "m": material_signature(n, m.materials)})


def _scored(kept: DataFrame, m: Matching, count_vetoes: bool, bound: bool) -> DataFrame:
    """(block, left_norm, right_norm, fuzzy, veto_by): pairs of different texts of a block, and of a text of several records with itself.

    Texts are scored once per distinct pair, their signatures taken once per text. A pair whose signatures
    differ is capped; where the cap lies below the review band it is not scored at all (and where digits
    differ not even met), unless ``count_vetoes`` asks for the pairs that the veto kept out. With ``bound`` (only texts count) pairs whose
    lengths alone keep them below both the review band and the veto cap are dropped before scoring, which
    changes no band and no veto: the similarity is at most twice the shorter length over the sum.
    """
    low = m.bands()[0]
    # Written once: each side of the self-join would otherwise normalise and sign all texts again.
    texts = stage(_signed(kept.groupBy("block", "norm").agg(F.count(F.lit(1)).alias("k")), m), "block-texts")
    vetoed = m.veto_cap >= low or count_vetoes
    if bound and vetoed and m.metric == "jaro_winkler" and min(low, m.veto_cap) > 0.5:
        near = _near_pairs(texts, min(low, m.veto_cap))
        return near.select("block", "left_norm", "right_norm", "fuzzy", signatures_differ(F.col("ld"), F.col("rd"), F.col("lm"), F.col("rm")).alias("veto_by"))
    pairs = _block_pairs(texts, alike=not vetoed)
    if bound and m.metric in ("ratio", "token_sort_ratio"):
        pairs = pairs.where(2 * F.least("ls", "rs") / (F.col("ls") + F.col("rs")) >= min(low, m.veto_cap))
    pairs = pairs.withColumn("veto_by", signatures_differ(F.col("ld"), F.col("rd"), F.col("lm"), F.col("rm")))
    if not vetoed:
        pairs = pairs.where("veto_by = ''")
    fuzzy = metric(m.metric)(F.col("left_norm"), F.col("right_norm"))
    scored = pairs.select("block", "left_norm", "right_norm", fuzzy.alias("fuzzy"), "veto_by")
    return scored.where(F.col("fuzzy") >= min(low, m.veto_cap)) if bound else scored


def _capped(rows: DataFrame, raw: Column, m: Matching, *columns: str) -> DataFrame:
    # The reference's scores are single precision; bands compare them as doubles.
    veto = F.when((F.col("veto_by") != "") & (F.col("raw") > m.veto_cap), F.col("veto_by"))
    single = rows.withColumn("raw", raw.cast("float").cast("double"))
    return single.select(*columns, "raw", F.when(veto.isNotNull(), m.veto_cap).otherwise(F.col("raw")).alias("score"), veto.alias("veto"))


def classes(found: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(block, norm, rep, last, n_records): the compared records of one text in a block, as one class under its smallest key.

    With ``keep`` also ``rep_kept`` and ``last_kept``, these columns of the records of smallest and largest key.
    """
    # The hash leads, as sorting tells most texts apart by it alone.
    groups = found.where("reason is null").groupBy(F.xxhash64("block", "norm").alias("h"), "block", "norm")
    if not keep:
        return groups.agg(F.min("key").alias("rep"), F.max("key").alias("last"), F.count(F.lit(1)).alias("n_records")).drop("h")
    record = F.struct("key", F.struct(*keep).alias("kept"))
    ends = groups.agg(F.min(record).alias("a"), F.max(record).alias("b"), F.count(F.lit(1)).alias("n_records"))
    return ends.select("block", "norm", F.col("a.key").alias("rep"), F.col("b.key").alias("last"), "n_records", F.col("a.kept").alias("rep_kept"), F.col("b.kept").alias("last_kept"))


def class_members(found: DataFrame) -> DataFrame:
    """(key, rep): the class of each compared record; a class of most records is joined around the shuffle."""
    slim = found.where("reason is null").select("key", F.struct("block", "norm").alias("class"))
    return lookup(slim, classes(found).select(F.struct("block", "norm").alias("class"), "rep"), "class").select("key", "rep")


def _copies(found: DataFrame) -> DataFrame:
    """(rep, key): the compared records that aren't the smallest of their class, each with that one; only classes of several records are joined."""
    known = getattr(found, "_tallgrass_classes", None)
    several = (classes(found) if known is None else known).where("n_records > 1").select(F.struct("block", "norm").alias("class"), "rep")
    slim = found.where("reason is null").select("key", F.struct("block", "norm").alias("class"))
    small = several.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = slim.join(F.broadcast(several), "class") if small else lookup(slim, several, "class")
    return joined.where("key <> rep").select("rep", "key")


def class_pairs(found: DataFrame, m: Matching, count_vetoes: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """(block, left_id, right_id, n_pairs, raw, score, veto, left_kept, right_kept): pairs of classes (see :func:`classes`) that may reach the review band.

    Each row stands for the ``n_pairs`` pairs of records of the two classes, named by their smallest keys;
    a class of several records also meets itself, named by its smallest and its largest key. Copies are
    never written out as pairs. Only texts count. The columns ``keep`` of the two named records come along as structs,
    so that none of them is looked up again; without ``keep`` these aren't there.
    """
    kept_too = ["left_kept", "right_kept"] if keep else []
    if m.metric in NEAR and m.veto_cap < m.bands()[0] and not count_vetoes:
        return _capped(_near_classes(found, m, keep), F.col("fuzzy"), m, "block", "left_id", "right_id", "n_pairs", *kept_too)
    kept = found.where("reason is null")
    side = lambda p: classes(found).select("block", F.col("norm").alias(f"{p}_norm"), F.struct("rep", "last", "n_records").alias(p))
    full = _scored(kept, m, count_vetoes, True).join(side("left"), ["block", "left_norm"]).join(side("right"), ["block", "right_norm"])
    itself = F.col("left_norm") == F.col("right_norm")
    k, n = F.col("left.n_records"), F.col("right.n_records")
    named = full.select(
        "block", F.least("left.rep", "right.rep").alias("left_id"), F.when(itself, F.col("left.last")).otherwise(F.greatest("left.rep", "right.rep")).alias("right_id"),
        F.when(itself, k * (k - 1) / 2).otherwise(k * n).cast("bigint").alias("n_pairs"), "fuzzy", "veto_by",
    )
    if keep:
        for p in ("left", "right"):
            named = named.join(found.select(F.col("key").alias(f"{p}_id"), F.struct(*keep).alias(f"{p}_kept")), f"{p}_id")
    return _capped(named, F.col("fuzzy"), m, "block", "left_id", "right_id", "n_pairs", *kept_too)


def score_pairs(found: DataFrame, m: Matching, vector: str | None = None, count_vetoes: bool = False) -> DataFrame:
    """(block, left_id, right_id, raw, score, veto): pairs of records that may reach the review band.

    Every pair is written out, for small blocks and where vectors tell records of one text apart; else
    :func:`class_pairs` says the same in fewer rows.
    """
    kept = found.where("reason is null")
    scored = _scored(kept, m, count_vetoes, m.shares[1] == 0)
    l = kept.select("block", F.col("norm").alias("left_norm"), F.col("key").alias("lkey"), *([F.col("vector").alias("lv")] if vector else []))  # noqa: E741
    r = kept.select("block", F.col("norm").alias("right_norm"), F.col("key").alias("rkey"), *([F.col("vector").alias("rv")] if vector else []))
    full = scored.join(l, ["block", "left_norm"]).join(r, ["block", "right_norm"]).where((F.col("left_norm") != F.col("right_norm")) | (F.col("lkey") < F.col("rkey")))
    raw = F.col("fuzzy")
    if vector and m.shares[1] > 0:
        # The vectors count in a block only if every record of it has one.
        able = kept.groupBy("block").agg(F.bool_and(F.col("vector").isNotNull()).alias("able"))
        full = full.join(able, "block")
        raw = F.when(F.col("able"), m.shares[0] * F.col("fuzzy") + m.shares[1] * cosine(F.col("lv"), F.col("rv"))).otherwise(F.col("fuzzy"))
    return _capped(full.withColumns({"left_id": F.least("lkey", "rkey"), "right_id": F.greatest("lkey", "rkey")}), raw, m, "block", "left_id", "right_id")


def banded(scores: DataFrame, m: Matching, shift: float = 0.0) -> DataFrame:
    low, top = m.bands(shift)
    return scores.withColumn("band", F.when(F.col("score") >= top, "duplicate").when(F.col("score") >= low, "review").otherwise("below"))


def score_spread(found: DataFrame, bands: DataFrame) -> DataFrame:
    """(band, n_pairs): duplicate and review as counted, below as what is left of all pairs in the blocks."""
    total = block_sizes(found.where("reason is null")).agg(F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n_pairs")).withColumn("band", F.lit("below"))
    n = F.sum("n_pairs") if "n_pairs" in bands.columns else F.count(F.lit(1))
    counted = bands.where("band <> 'below'").groupBy("band").agg(n.alias("n_pairs"))
    less = counted.select(F.lit("below").alias("band"), (-F.col("n_pairs")).alias("n_pairs"))
    return total.select("band", "n_pairs").unionByName(less).groupBy("band").agg(F.sum("n_pairs").alias("n_pairs")).unionByName(counted)


def components(edges: DataFrame, left: str = "left_id", right: str = "right_id", most_rounds: int = 60) -> DataFrame:
    """(member, root): connected components by repeatedly taking the least root among neighbours, with pointer jumping.

    The least root that any member of a tree sees moves its root and so the whole tree, which keeps the rounds
    few however long the chains are.
    Vertices with many neighbours and roots with many members are joined around the shuffle.
    """
    arcs = stage(edges.select(F.inline(F.array(F.struct(F.col(left).alias("u"), F.col(right).alias("v")), F.struct(F.col(right).alias("u"), F.col(left).alias("v"))))).where("u <> v").distinct(), "arcs")
    roots = stage(arcs.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("member"), F.least("u", "v").alias("root")), "roots")
    hubs = heavy_keys(arcs, "v").collect()  # under HEAVY_SHARE vertices
    n = roots.count()
    for _ in range(most_rounds):
        near = lookup(arcs, roots.select(F.col("member").alias("v"), "root"), "v", hubs).groupBy("u").agg(F.min("root").alias("r"))
        lower = stage(roots.join(near, roots["member"] == near["u"]).select("member", F.least("root", "r").alias("root"), F.col("root").alias("was")), "lower")
        hooked = lower.groupBy("was").agg(F.min("root").alias("over")).select(F.col("was").alias("root"), "over")
        jump = roots.select(F.col("member").alias("root"), F.col("root").alias("over")).unionByName(hooked).groupBy("root").agg(F.min("over").alias("over"))
        moved = stage(lookup(lower, jump, "root", heavy_keys(lower, "root", n), how="left").select("member", F.least("root", F.coalesce("over", "root")).alias("root"), "was"), "roots")
        still = moved.where("root <> was").isEmpty()
        release(roots, lower)
        roots = moved.select("member", "root")
        roots._tallgrass_path = moved._tallgrass_path
        if still:
            release(arcs)
            return roots
    raise RuntimeError(f"not stable after {most_rounds} rounds")


def clusters(found: DataFrame, bands: DataFrame, copies: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """(cluster_id, block, member, root, ``keep``): clusters of duplicate pairs, numbered by block and smallest member.

    With ``copies`` the pairs are those of classes (see :func:`class_pairs`), and all records of a class are in one cluster.
    The columns ``keep`` of ``found`` come along, so that later steps needn't seek the members among all records again.
    """
    edges = bands.where("band = 'duplicate'").select("left_id", "right_id")
    if copies:
        edges = edges.unionByName(_copies(found).select(F.col("rep").alias("left_id"), F.col("key").alias("right_id")))
    roots = components(edges)
    # Written once: the heads, the search for large clusters and the result read it.
    keyed = stage(roots.join(found.select(F.col("key").alias("member"), "block", *keep), "member"), "in-clusters")
    heads = keyed.where("member = root").select("block", "root")
    named = numbered(heads, "block", "root").select("root", F.concat(F.lit("CL-"), F.lpad(F.col("number").cast("string"), F.greatest(F.lit(4), F.length(F.col("number").cast("string"))), F.lit("0"))).alias("cluster_id"))
    return lookup(keyed, named, "root").select("cluster_id", "block", "member", "root", *keep)


def completeness(records: DataFrame, key: str, fields: Sequence[str], mandatory: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(member, n_mandatory, n_total, ``keep``): how many declared fields of a record are filled."""
    filled = lambda fs: sum((F.when(F.trim(F.col(f).cast("string")) != "", 1).otherwise(0) for f in fs), F.lit(0))
    have = [f for f in fields if f in records.columns]
    return records.select(F.col(key).cast("string").alias("member"), filled([f for f in mandatory if f in have]).alias("n_mandatory"), filled(have).alias("n_total"), *keep)


def survivors(members: DataFrame, filled: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """(cluster_id, survivor, reason, needs_steward): equal texts keep the smallest key; else the most complete record; a tie is left to a steward.

    Two aggregates that are combined before they are shuffled; no cluster is gathered. Without ``filled`` and
    ``found`` the members carry n_mandatory, n_total and norm.
    """
    m = members if filled is None else members.join(filled, "member", "left").join(found.select(F.col("key").alias("member"), "norm"), "member")
    level = m.groupBy("cluster_id", F.coalesce("n_mandatory", F.lit(0)).alias("a"), F.coalesce("n_total", F.lit(0)).alias("b"))
    level = level.agg(F.min("member").alias("first"), F.count(F.lit(1)).alias("k"), F.min("norm").alias("x"), F.max("norm").alias("y"))
    top = level.groupBy("cluster_id").agg(F.max(F.struct("a", "b", "first", "k")).alias("best"), (F.min("x") == F.max("y")).alias("alike"), F.min("first").alias("smallest"))
    reason = F.when(F.col("alike"), "identical").when(F.col("best.k") > 1, "none").otherwise("completeness")
    return top.select("cluster_id", F.when(F.col("alike"), F.col("smallest")).otherwise(F.col("best.first")).alias("survivor"), reason.alias("reason"), (reason == "none").alias("needs_steward"))


def weakest_links(members: DataFrame, found: DataFrame | None, m: Matching) -> DataFrame:
    """(cluster_id, weakest_link): the least score among all pairs within a cluster, edges or not; a large cluster is cut into chunks as blocks are. Without ``found`` the members carry norm."""
    told = members if found is None else members.join(found.select(F.col("key").alias("member"), "norm"), "member")
    texts = told.groupBy(F.col("cluster_id").alias("block"), "norm").agg(F.count(F.lit(1)).alias("k"))
    pairs = _block_pairs(stage(_signed(texts, m), "cluster-texts"))
    rows = pairs.select(F.col("block").alias("cluster_id"), metric(m.metric)(F.col("left_norm"), F.col("right_norm")).alias("fuzzy"), signatures_differ(F.col("ld"), F.col("rd"), F.col("lm"), F.col("rm")).alias("veto_by"))
    return _capped(rows, F.col("fuzzy"), m, "cluster_id").groupBy("cluster_id").agg(F.min("score").alias("weakest_link"))


def member_scores(members: DataFrame, kept: DataFrame, found: DataFrame | None, m: Matching, shift: float = 0.0, keep: Sequence[str] = ()) -> DataFrame:
    """(cluster_id, member, is_survivor, score, below_band, ``keep``): each member's score against its survivor.

    ``below_band`` marks a member that joined by a chain: alone with the survivor it would not reach the band.
    The survivor scores 1. Without ``found`` the members carry norm; columns ``keep`` of the members come along.
    """
    told = members if found is None else members.join(found.select(F.col("key").alias("member"), "norm"), "member")
    heads = kept.select("cluster_id", F.col("survivor").alias("member")).join(told.select("member", "norm"), "member").select("cluster_id", F.col("member").alias("survivor"), F.col("norm").alias("head"))
    both = lookup(told.select("cluster_id", "member", "norm", *keep), heads, "cluster_id")
    rows = both.select("cluster_id", "member", "survivor", *keep, metric(m.metric)(F.col("norm"), F.col("head")).alias("fuzzy"), disagreement(F.col("norm"), F.col("head"), m.materials).alias("veto_by"))
    scored, own = _capped(rows, F.col("fuzzy"), m, "cluster_id", "member", "survivor", *keep), F.col("member") == F.col("survivor")
    score = F.when(own, 1.0).otherwise(F.col("score"))
    return scored.select("cluster_id", "member", own.alias("is_survivor"), score.alias("score"), (~own & (score < m.bands(shift)[1])).alias("below_band"), *keep)


def duplicate_findings(members: DataFrame, kept: DataFrame, table: str, key: str) -> DataFrame:
    """A high finding per member that doesn't survive."""
    rows = lookup(members, kept, "cluster_id").where("member <> survivor")
    none = F.lit(None).cast("string")
    return rows.select(
        F.lit("Uniqueness").alias("dimension"), F.lit(table).alias("table_name"), F.concat(F.lit(f"{key}="), F.col("member")).alias("record_id"), none.alias("field"),
        F.lit(f"UNIQ_{table.upper()}_DUPLICATE").alias("rule_id"), F.concat(F.lit("duplicate of "), F.col("survivor")).alias("issue"), F.lit("High").alias("severity"), F.lit(1.0).alias("confidence"),
        none.alias("observed_value"), F.lit(None).cast("array<string>").alias("expected"),
        F.create_map(F.lit("cluster_id"), F.col("cluster_id"), F.lit("survivor"), F.col("survivor")).alias("metadata"),
    )


def pair_key(left_id: Column, right_id: Column, left_norm: Column, right_norm: Column) -> Column:
    """16 hex digits that name a pair in either order with its normalised wording."""
    one, two = F.struct(left_id.alias("i"), left_norm.alias("t")), F.struct(right_id.alias("i"), right_norm.alias("t"))
    a, b = F.least(one, two), F.greatest(one, two)
    return F.substring(F.sha2(F.concat_ws("|", a["i"], a["t"], b["i"], b["t"]), 256), 1, 16)


def content_code(texts: DataFrame, key: str, text: str) -> DataFrame:
    """One row: a code of all (key, text) lines that doesn't depend on their order, and their number.

    A sum of 64-bit hashes of the lines modulo a prime, so it needs no sorted collection of them.
    """
    line = F.xxhash64(F.col(key), F.lit("\u0000"), F.col(text)).cast("decimal(38,0)")
    return texts.agg(F.count(F.lit(1)).alias("n_lines"), F.sha2((F.coalesce(F.sum(line), F.lit(0)) % F.lit(2305843009213693951)).cast("string"), 256).alias("code"))
