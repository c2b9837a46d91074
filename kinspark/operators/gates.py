"""Gates: every one abstains rather than guesses. Ties, unequal counts and double claims give no answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_both_sides(a: DataFrame, b: DataFrame, key: str, a_id: str, b_id: str) -> DataFrame:
    """(a_id, b_id) where a key occurs once in A and once in B. Counts are grouped, so frequent keys never meet row by row."""
    one_a = a.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(a_id).alias(a_id)).where("_n = 1").drop("_n")
    one_b = b.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(b_id).alias(b_id)).where("_n = 1").drop("_n")
    return one_a.join(one_b, key)


def equal_count_keys(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur as often in A as in B, with that count."""
    return a.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).join(b.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), [*key, "n"])


def unanimous(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, value) where all rows of a key agree; null values don't speak."""
    return df.groupBy(*key).agg(F.min(value).alias(value), F.max(value).alias("_hi")).where(F.col(value) == F.col("_hi")).drop("_hi")


def strict_best(df: DataFrame, key: list[str], score: str, floor: float | None = None) -> DataFrame:
    """Rows with the single highest score of their key; a tie for it gives none."""
    if floor is not None:
        df = df.where(F.col(score) >= floor)
    best = df.groupBy(*key).agg(F.max(score).alias("_best"))
    top = df.join(best, key).where(F.col(score) == F.col("_best")).drop("_best")
    count = top.groupBy(*key).agg(F.count(F.lit(1)).alias("_ties"))
    return top.join(count, key).where("_ties = 1").drop("_ties")


def injective(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """(kept, demoted): a target claimed more than once loses all its claims."""
    n = F.count(F.lit(1)).over(Window.partitionBy(target))
    counted = df.withColumn("_claims", n)
    return counted.where("_claims = 1").drop("_claims"), counted.where("_claims > 1").drop("_claims")


def verdict(pairs: list[tuple[Column, Column]]) -> Column:
    """accept, reject or unguarded from pairs of values: reject where two known ones differ, unguarded where none could be compared."""
    known = [a.isNotNull() & b.isNotNull() for a, b in pairs]
    differ, compared = F.lit(False), F.lit(False)
    for (a, b), k in zip(pairs, known, strict=True):
        differ = differ | (k & (a != b))
        compared = compared | k
    return F.when(differ, "reject").when(compared, "accept").otherwise("unguarded")


def mutual_best(df: DataFrame, a: str, b: str, score: str, floor: float | None = None) -> DataFrame:
    """Pairs that are the strict best of both their ends: one window over either end, no join."""
    if floor is not None:
        df = df.where(F.col(score) >= floor)
    for end, best, ties in ((a, "_best_a", "_ties_a"), (b, "_best_b", "_ties_b")):
        of = Window.partitionBy(end)
        df = df.withColumn(best, F.max(score).over(of)).withColumn(ties, F.count_if(F.col(score) == F.col(best)).over(of))
    wins = (F.col(score) == F.col("_best_a")) & (F.col("_ties_a") == 1) & (F.col(score) == F.col("_best_b")) & (F.col("_ties_b") == 1)
    return df.where(wins).drop("_best_a", "_ties_a", "_best_b", "_ties_b")


def narrow(candidates: DataFrame, old: str, keep: Column) -> DataFrame:
    """Candidates with how many of their row's pool pass ``keep``: _left 0 is a contradiction and ends the search, 1 closes it."""
    return candidates.withColumn("_keep", F.coalesce(keep, F.lit(False))).withColumn("_left", F.sum(F.col("_keep").cast("int")).over(Window.partitionBy(old)))
