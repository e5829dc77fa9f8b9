"""The best representative of each group of duplicates, and a record built field by field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions.values import calendar_day

# What people enter where nothing is known, in lower case.
STAND_INS = ["?", "-", "--", ".", "#", "n.a.", "na", "n/a", "n.a", "tbd", "null", "none", "nil", "unknown", "k.a.", "xxx"]

#: Fields whose entries make a material record complete.
COMPLETENESS_FIELDS = ["matkl", "bismt", "raube", "tragr", "spart", "gewei", "voleh", "wrkst", "aenam"]


def known(value: Column, stand_ins: Sequence[str] = STAND_INS) -> Column:
    """Populated, and not a stand-in for "nothing known"."""
    text = F.lower(F.trim(value.cast("string")))
    return F.coalesce((text != "") & ~text.isin(*stand_ins), F.lit(False))


def rank_members(
    members: DataFrame,
    records: DataFrame,
    group: str = "group_no",
    key: str = "matnr",
    fields: Sequence[str] = COMPLETENESS_FIELDS,
    changed: str = "laeda",
    created: str = "ersda",
    arrived: str = "loaded_at",
    trust: str | None = None,
) -> DataFrame:
    """Members of each group with what ranks them: (group, key, n_known, trust, changed, created, *fields).

    ``trust`` names a number of ``members``, say the score of a steward or the rank of a source; the highest
    of a member's rows counts, and null is less than any. Without it all members are trusted alike. A member
    listed or delivered several times counts once. Of deliveries that differ the one with most entries, the
    latest change, the earliest creation counts. A member without a record has no entries and no dates. Null
    groups and null keys are no members.
    """
    worth = F.max(F.when(~F.isnan(trust), F.col(trust).cast("double"))) if trust else F.lit(0.0)
    links = members.where(F.col(group).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(group).alias("__group"), F.col(key).alias("__key")).agg(F.coalesce(worth, F.lit(float("-inf"))).alias("__trust"))
    filled = sum((known(F.col(f)).cast("int") for f in fields), F.lit(0))
    best = F.struct(
        filled.alias("n_known"),
        F.coalesce(F.datediff(calendar_day(F.col(changed), F.col(arrived)), F.lit("0001-01-01").cast("date")), F.lit(-1)).alias("c"),
        F.coalesce(-F.datediff(calendar_day(F.col(created), F.col(arrived)), F.lit("0001-01-01").cast("date")), F.lit(-10_000_000)).alias("e"),
        *[F.col(f).alias(f"f_{f}") for f in fields],
    )
    one = (
        records.select(F.col(key).alias("__key"), best.alias("b"))
        .where(F.col("__key").isNotNull())
        .join(links.select("__key").distinct(), "__key", "left_semi")
        .groupBy("__key").agg(F.max("b").alias("b"))
    )
    return links.join(one, "__key", "left").select(
        F.col("__group").alias(group), F.col("__key").alias(key),
        F.coalesce("b.n_known", F.lit(0)).alias("n_known"), "__trust",
        F.coalesce("b.c", F.lit(-1)).alias("__c"), F.coalesce("b.e", F.lit(-10_000_000)).alias("__e"),
        *[F.col(f"b.f_{f}").alias(f"__{f}") for f in fields],
    )


def _order(key: str) -> list[Column]:
    return [F.desc("n_known"), F.desc("__trust"), F.desc("__c"), F.desc("__e"), F.asc(key)]


def survivors(members: DataFrame, records: DataFrame, group: str = "group_no", key: str = "matnr", **named) -> DataFrame:
    """(group, key): the surviving member of each group.

    Ranked by completeness, then trust (see :func:`rank_members`), the latest change, the earliest creation and the smallest key. Only the
    first rank is asked for, so Spark keeps one candidate per group and map task ahead of the shuffle:
    a group that holds a third of all rows costs its task no more than any other.
    """
    ranked = rank_members(members, records, group, key, **named).select(group, key, "n_known", "__trust", "__c", "__e")
    first = F.row_number().over(Window.partitionBy(group).orderBy(*_order(key)))
    return ranked.withColumn("__rank", first).where("__rank = 1").select(group, key)


def built_records(members: DataFrame, records: DataFrame, group: str = "group_no", key: str = "matnr", fields: Sequence[str] = COMPLETENESS_FIELDS, **named) -> DataFrame:
    """One record per group, each field taken from the best-ranked member that knows it: (group, key, *fields).

    A field no member knows is null. Computed as one map-side combined aggregate; no group is gathered.
    """
    ranked = rank_members(members, records, group, key, fields=fields, **named)
    # The smallest struct ranks first: counts and days are negated, the key breaks ties.
    rank = F.struct((-F.col("n_known")).alias("n"), (-F.col("__trust")).alias("t"), (-F.col("__c")).alias("c"), (-F.col("__e")).alias("e"), F.col(key).alias("k"))
    picks = [F.min(F.when(known(F.col(f"__{f}")), F.struct(rank.alias("rank"), F.col(f"__{f}").alias("v"))))["v"].alias(f) for f in fields]
    return ranked.groupBy(group).agg(F.min(rank)["k"].alias(key), *picks)
