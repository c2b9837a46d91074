"""Scores of a grouping against the truth, from the long contingency table; never a pivot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contingency(truth: DataFrame, pred: DataFrame, key: str, true_col: str, pred_col: str) -> DataFrame:
    """(true_group, pred_group, n) over the ids that both have."""
    both = truth.select(key, F.col(true_col).alias("true_group")).join(pred.select(key, F.col(pred_col).alias("pred_group")), key)
    return both.groupBy("true_group", "pred_group").agg(F.count(F.lit(1)).alias("n"))


def _pairs(c):  # noqa: ANN001, ANN202
    return c * (c - 1) / 2


def adjusted_rand(table: DataFrame) -> DataFrame:
    """(ari): one row. 1 for up to one record, and where the denominator is 0."""
    a = table.groupBy("true_group").agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("a"))
    b = table.groupBy("pred_group").agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("b"))
    c = table.agg(F.sum(_pairs(F.col("n"))).alias("c"), F.sum("n").alias("all"))
    x = c.crossJoin(a).crossJoin(b)  # one row each
    total = _pairs(F.col("all"))
    expected = F.col("a") * F.col("b") / total
    most = (F.col("a") + F.col("b")) / 2
    return x.select(F.when((F.col("all") <= 1) | (total == 0), 1.0).when(most - expected == 0, 1.0).otherwise((F.col("c") - expected) / (most - expected)).alias("ari"))


def v_measure(table: DataFrame) -> DataFrame:
    """(homogeneity, completeness, v): natural logarithms; 1 where the entropy they divide by is 0."""
    all_n = table.agg(F.sum("n").alias("all"))
    by_true = table.groupBy("true_group").agg(F.sum("n").alias("nt"))
    by_pred = table.groupBy("pred_group").agg(F.sum("n").alias("np"))
    ht = by_true.crossJoin(all_n).agg(F.sum(-(F.col("nt") / F.col("all")) * F.log(F.col("nt") / F.col("all"))).alias("ht"))
    hp = by_pred.crossJoin(all_n).agg(F.sum(-(F.col("np") / F.col("all")) * F.log(F.col("np") / F.col("all"))).alias("hp"))
    cells = table.join(by_true, "true_group").join(by_pred, "pred_group").crossJoin(all_n)
    cond = cells.agg(F.sum(-(F.col("n") / F.col("all")) * F.log(F.col("n") / F.col("np"))).alias("htp"), F.sum(-(F.col("n") / F.col("all")) * F.log(F.col("n") / F.col("nt"))).alias("hpt"))
    x = cond.crossJoin(ht).crossJoin(hp)  # one row each
    h = F.when(F.col("ht") == 0, 1.0).otherwise(1 - F.col("htp") / F.col("ht"))
    c = F.when(F.col("hp") == 0, 1.0).otherwise(1 - F.col("hpt") / F.col("hp"))
    return x.select(h.alias("homogeneity"), c.alias("completeness")).withColumn(
        "v", F.when(F.col("homogeneity") + F.col("completeness") == 0, 0.0).otherwise(2 * F.col("homogeneity") * F.col("completeness") / (F.col("homogeneity") + F.col("completeness")))
    )


def purity(table: DataFrame) -> DataFrame:
    """(purity, inverse_purity)."""
    p = table.groupBy("pred_group").agg(F.max("n").alias("m"), F.sum("n").alias("n")).agg((F.sum("m") / F.sum("n")).alias("purity"))
    q = table.groupBy("true_group").agg(F.max("n").alias("m"), F.sum("n").alias("n")).agg((F.sum("m") / F.sum("n")).alias("inverse_purity"))
    return p.crossJoin(q)  # one row each


def breakdown(table: DataFrame) -> DataFrame:
    """(true_group, dominant, n, completeness) of each true group: its largest output, ties to the first in order."""
    best = table.groupBy("true_group").agg(F.min(F.struct(-F.col("n"), "pred_group")).getField("pred_group").alias("dominant"), F.max("n").alias("m"), F.sum("n").alias("n"))
    return best.select("true_group", "dominant", "n", (F.col("m") / F.col("n")).alias("completeness"))
