"""Votes: many witnesses, one value, silence on a tie."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.operators.gates import strict_best


def tally(votes: DataFrame, slot: str, value: str, exact: str | None = None) -> DataFrame:
    """(slot, value, total, exact): how many votes each value has, and how many of them are exact."""
    aggs = [F.count(F.lit(1)).alias("total")]
    if exact:
        aggs.append(F.count_if(F.col(exact)).cast("long").alias("exact"))
    return votes.groupBy(slot, value).agg(*aggs)


def top_vote(votes: DataFrame, slot: str, value: str, floor: int = 1) -> DataFrame:
    """(slot, value, total): the value with most votes, if it has the floor and no equal."""
    return strict_best(tally(votes, slot, value), [slot], "total", floor)


def ranked_suggestion(tallied: DataFrame, slot: str, value: str, floor: int = 1) -> DataFrame:
    """By exact votes, then all votes; values below the floor are out first, a tie on both gives none."""
    able = tallied.where(F.col("total") >= floor).withColumn("_key", F.struct("exact", "total"))
    best = able.groupBy(slot).agg(F.max("_key").alias("_best"))
    top = able.join(best, slot).where("_key = _best")
    ties = top.groupBy(slot).agg(F.count(F.lit(1)).alias("_n"))
    return top.join(ties, slot).where("_n = 1").select(slot, value, "exact", "total")


def claimants(votes: list[DataFrame], value: str, by: str) -> DataFrame:
    """(value, claimants): how many distinct slots claim a value over all vote tables."""
    every = votes[0].select(value, by)
    for v in votes[1:]:
        every = every.unionByName(v.select(value, by))
    return every.distinct().groupBy(value).agg(F.count(F.lit(1)).alias("claimants"))


def credit_pools(requests: DataFrame, credits: DataFrame, key: str, order: str) -> DataFrame:
    """Requests in order, each served as long as its key has credits (``credits``: key, n)."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return requests.withColumn("_nth", nth).join(credits.select(key, "n"), key, "left").withColumn("served", F.coalesce(F.col("_nth") <= F.col("n"), F.lit(False))).drop("_nth", "n")
