"""Placement of ordered records into groups by an ordered list of tiers, with the trail of every tier's answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinspark.operators.gates import equal_count_keys, unanimous


def hash_tier(prior: DataFrame, fresh: DataFrame, hash_col: str, home: str) -> DataFrame:
    """(hash, home, miss): the home of a hash that occurs as often on both sides and lives in one place; else why not: absent, count or split."""
    a = prior.groupBy(hash_col).agg(F.count(F.lit(1)).alias("_a"), F.min(home).alias("_lo"), F.max(home).alias("_hi"))
    b = fresh.groupBy(hash_col).agg(F.count(F.lit(1)).alias("_b"))
    j = b.join(a, hash_col, "left")
    miss = F.when(F.col("_a").isNull(), "absent").when(F.col("_a") != F.col("_b"), "count").when(F.col("_lo") != F.col("_hi"), "split")
    return j.select(hash_col, F.when(miss.isNull(), F.col("_lo")).alias(home), miss.alias("miss"))


def name_votes(prior: DataFrame, fresh: DataFrame, name: str, order: str, home: str) -> DataFrame:
    """fresh rows with ``vote`` and ``kind``: all-same where a name has one prior home; else the k-th home where the counts agree (ordinal); else none."""
    one = unanimous(prior, [name], home).withColumnRenamed(home, "_same")
    equal = equal_count_keys(prior, fresh, [name]).drop("n").withColumn("_equal", F.lit(True))
    rank = lambda: F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    p = prior.select(name, F.col(home).alias("_kth"), rank().alias("_k"))
    f = fresh.withColumn("_k", rank()).join(one, name, "left").join(equal, name, "left").join(p, [name, "_k"], "left")
    kth = F.when(F.col("_equal"), F.col("_kth"))
    kind = F.when(F.col("_same").isNotNull(), "allsame").when(kth.isNotNull(), "ordinal")
    return f.withColumn("vote", F.coalesce("_same", kth)).withColumn("kind", kind).drop("_same", "_equal", "_kth", "_k")


def statement_votes(prior: DataFrame, fresh: DataFrame, home: str) -> DataFrame:
    """(id, votes, name_vote, allsame_vote, used_ordinal) of fresh records that declare several names each.

    Both sides have id, pos (the name's place in its record) and name; ``prior`` has ``home`` too. A name whose prior
    homes are one votes for it; else its k-th declaration votes for the k-th prior home, where both sides declare it
    equally often; else it abstains. Only names that need their order get one, so a frequent name of one home is one row.
    """
    homes = prior.groupBy("name").agg(F.count(F.lit(1)).alias("_n"), F.min(home).alias("_lo"), F.max(home).alias("_hi"))
    counts = fresh.groupBy("name").agg(F.count(F.lit(1)).alias("_m"))
    known = counts.join(homes, "name")
    same = known.where("_lo = _hi").select("name", F.col("_lo").alias("_home"))
    ordered = known.where("_lo <> _hi and _n = _m").select("name")
    along = Window.partitionBy("name").orderBy("id", "pos")
    kth = prior.join(ordered, "name", "left_semi").select("name", F.col(home).alias("_home"), F.row_number().over(along).alias("_k"))
    by_order = fresh.join(ordered, "name", "left_semi").select("id", "name", F.row_number().over(along).alias("_k")).join(kth, ["name", "_k"])
    cast = fresh.select("id", "name").join(same, "name").select("id", "_home", F.lit(True).alias("_same")).unionByName(by_order.select("id", "_home", F.lit(False).alias("_same")))
    alone = F.when(F.col("_same"), F.col("_home"))
    return cast.groupBy("id").agg(
        F.count_distinct("_home").alias("votes"), F.when(F.min("_home") == F.max("_home"), F.min("_home")).alias("name_vote"),
        F.when(F.min(alone) == F.max(alone), F.min(alone)).alias("allsame_vote"), F.bool_or(~F.col("_same")).alias("used_ordinal"),
    )


def identity_votes(prior: DataFrame, fresh: DataFrame, matched: DataFrame, home: str) -> DataFrame:
    """(id, identity): the one home of all prior names that ``matched`` (name, prior_name) gives for the names a record declares; names with several homes don't speak."""
    one = unanimous(prior, ["name"], home).select(F.col("name").alias("prior_name"), home)
    return unanimous(fresh.join(matched, "name").join(one, "prior_name"), ["id"], home).select("id", F.col(home).alias("identity"))


def ten_tiers() -> list[tuple[str, Column]]:
    """The evidence tiers in order, over columns hash_home, shapeless, votes, name_vote, allsame_vote, used_ordinal, identity, identity_real, anchor and anchor_strong."""
    vote = F.col("name_vote")
    over = lambda c: F.when(vote.isNotNull() & (F.col(c) != vote), F.col(c))
    return [
        ("hash", F.when(~F.col("shapeless"), F.col("hash_home"))), ("preempt", over("identity_real")), ("anchorPreempt", over("anchor_strong")), ("ordinal", F.when(F.col("used_ordinal"), vote)),
        ("name", F.when(~F.col("used_ordinal"), vote)), ("allsame", F.col("allsame_vote")), ("fill", F.when(F.coalesce("votes", F.lit(0)) == 0, F.col("identity"))), ("anchor", F.col("anchor")),
    ]


def place_by_evidence(rows: DataFrame, group: list[str], order: str, first_home: Column, disabled: frozenset[str] = frozenset()) -> DataFrame:
    """``place`` with the ten tiers: what no evidence places is conflict (two votes or more) or novote and follows the record before it, the first one ``first_home``."""
    out = place(rows, ten_tiers(), group, order, disabled).withColumn("home", F.coalesce("home", first_home))
    several = (F.col("votes") > 1) & F.lit("conflict" not in disabled)
    return out.withColumn("tier", F.when((F.col("tier") == "novote") & several, "conflict").otherwise(F.col("tier")))


def place(rows: DataFrame, tiers: list[tuple[str, Column]], group: list[str], order: str, disabled: frozenset[str] = frozenset()) -> DataFrame:
    """Adds ``home`` and ``tier`` of the first tier with an answer; rows without one take the home before them (tier novote), and ``trail``: what every tier said."""
    active = [(n, c) for n, c in tiers if n not in disabled]
    home = F.coalesce(*[c for _, c in active])
    tier = F.lit("novote")
    for n, c in reversed(active):
        tier = F.when(c.isNotNull(), F.lit(n)).otherwise(tier)
    said = F.filter(F.array(*[F.when(c.isNotNull(), F.concat(F.lit(f"{n}="), c.cast("string"))) for n, c in active]), lambda x: x.isNotNull())
    decided = rows.withColumn("_home", home).withColumn("tier", tier).withColumn("trail", F.array_join(said, ";"))
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return decided.withColumn("home", F.last("_home", ignorenulls=True).over(w)).drop("_home")
