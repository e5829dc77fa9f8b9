"""A spelling model learned from word counts: which rare words are slips or short forms of which frequent ones.

A word is a writing of another if the other is sufficiently more frequent and the first is its beginning
(an abbreviation), its consonants after the first letter, or within one edit or swap of it. Candidates
meet through shared deletions, beginnings and consonants, by equi-joins, never by comparing all words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_LENGTH = 3
LEAST_TARGET = 4


def consonants(word: Column) -> Column:
    """The first letter and the consonants behind it."""
    return F.concat(F.substring(word, 1, 1), F.translate(F.substring(word, 2, 1_000), "aeiou", ""))


def _deletions(word: Column) -> Column:
    """The word and every form of it with one letter left out."""
    size = F.length(word)
    forms = F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, size)))
    return F.array_union(F.array(word), forms)


def _keys(kind: str, forms: Column) -> Column:
    return F.transform(forms, lambda x: F.concat(F.lit(f"{kind}:"), x))


def writings(counts: DataFrame, least_ratio: float = 4.0, most_ratio: float = 50.0) -> DataFrame:
    """(word, target): the frequent word that each rarer writing stands for.

    ``counts`` has one row per ``word`` with the number ``n`` of its texts. The ratio of counts asked for
    grows with the evidence, from ``least_ratio`` to ``most_ratio``. Of several targets an abbreviation
    beats consonants, these a slip that keeps the first letter, that any other slip; then the more
    frequent and the alphabetically first word wins. Words of digits or under three letters have none.
    """
    usable = counts.where((F.length("word") >= LEAST_LENGTH) & ~F.col("word").rlike(r"\d")).select("word", "n")
    w = F.col("word")
    rare = usable.select(w.alias("u"), F.col("n").alias("nu"), F.explode(F.concat(_keys("d", _deletions(w)), _keys("p", F.array(w)), _keys("c", F.array(w)))).alias("key"))
    starts = F.when(F.length(w) > LEAST_LENGTH, F.transform(F.sequence(F.lit(LEAST_LENGTH), F.greatest(F.length(w) - 1, F.lit(LEAST_LENGTH))), lambda k: F.substring(w, F.lit(1), k))).otherwise(F.array().cast("array<string>"))
    target = usable.where(F.length("word") >= LEAST_TARGET).select(
        w.alias("t"), F.col("n").alias("nt"),
        F.explode(F.concat(_keys("d", _deletions(w)), _keys("p", starts), _keys("c", F.array(consonants(w))))).alias("key"),
    )
    ratio = F.least(F.lit(most_ratio), F.greatest(F.lit(least_ratio), F.col("nt") / 10))
    u, t = F.col("u"), F.col("t")
    letters = lambda c: F.array_sort(F.split(c, ""))
    slip = (F.levenshtein(u, t) <= 1) | ((F.length(u) == F.length(t)) & (letters(u) == letters(t)))
    kind = (
        F.when(F.col("key").startswith("p:"), 0)
        .when(F.col("key").startswith("c:"), 1)
        .when(slip & (F.substring(u, 1, 1) == F.substring(t, 1, 1)), 2)
        .when(slip, 3)
    )
    near = rare.join(target, "key").where((u != t) & (F.col("nt") >= ratio * F.col("nu"))).withColumn("kind", kind).where("kind is not null")
    best = near.groupBy("u").agg(F.min(F.struct("kind", (-F.col("nt")).alias("m"), "t"))["t"].alias("t"))
    # A target that is itself a writing of a third word stands for that word.
    further = best.select(F.col("u").alias("t"), F.col("t").alias("t2"))
    return best.join(further, "t", "left").select(u.alias("word"), F.coalesce("t2", "t").alias("target")).where("word <> target")


def surplus_words(texts: DataFrame, usual: int, least_share: float = 0.9, least_texts: int = 5) -> DataFrame:
    """(word): words that say nothing, told by their texts nearly always having more than the usual number of words.

    ``texts`` has a row per text with its array ``words``; every text names the same number of things, so
    a word on top of them is not one of them.
    """
    per_word = texts.select(F.explode(F.array_distinct("words")).alias("word"), (F.size("words") > usual).cast("int").alias("more"))
    return per_word.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.avg("more").alias("share")).where((F.col("n") >= least_texts) & (F.col("share") >= least_share)).select("word", "n")


def usual_number(texts: DataFrame) -> int:
    """The most frequent number of words of a text (the smaller of equals; 0 for no texts)."""
    row = texts.groupBy(F.size("words").alias("k")).count().agg(F.max(F.struct("count", (-F.col("k")).alias("m")))["m"]).first()
    return -row[0] if row and row[0] is not None else 0


