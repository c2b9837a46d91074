"""Ordered windows: segments, regions, fills, curves, merged intervals, proximity groups."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinspark.operators.graph import settle


def ordinal_in_group(df: DataFrame, key: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """Rank from 0 in a group, null where a record is alone in it."""
    w = Window.partitionBy(*key)
    rank = (F.row_number().over(w.orderBy(*order)) - 1).cast("long")
    return df.withColumn(name, F.when(F.count(F.lit(1)).over(w) >= 2, rank))


def locality_fill(df: DataFrame, group: list[str], order: str, value: str, seed: Column | None = None) -> DataFrame:
    """Rows without a value take the last one before them; the first ones the seed."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(value, ignorenulls=True).over(w)
    return df.withColumn(value, F.coalesce(last, seed) if seed is not None else last)


def anchored_order(df: DataFrame, group: list[str], rank: str, order: str) -> DataFrame:
    """Adds ``key`` and ``place``: ranked rows keep their rank, others stand half a step behind the last ranked one before them."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    key = F.coalesce(F.col(rank).cast("double"), F.last(rank, ignorenulls=True).over(w) + 0.5, F.lit(-0.5))
    keyed = df.withColumn("key", key)
    return keyed.withColumn("place", (F.row_number().over(Window.partitionBy(*group).orderBy("key", order)) - 1).cast("long"))


def segments(df: DataFrame, group: str, order: str, ends: Column) -> DataFrame:
    """Adds ``segment``: runs that end with a terminator row; rows after the last one are the tail, null."""
    w = Window.partitionBy(group).orderBy(order)
    before = F.coalesce(F.sum(ends.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(ends.cast("int")).over(Window.partitionBy(group))
    return df.withColumn("segment", F.when(before < total, before.cast("long")))


def regions(df: DataFrame, group: str, order: str, banner: Column) -> DataFrame:
    """Adds ``region``: the last banner at or before each row, null before the first."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("region", F.last(banner, ignorenulls=True).over(w))


def merged_intervals(df: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """(group, start, end, n): overlapping or touching whole-number intervals become one."""
    w = Window.partitionBy(group).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = df.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach + 1), 1).otherwise(0))
    island = opened.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return island.groupBy(group, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_island")


def crossing_curve(edges: DataFrame, positions: DataFrame, group: str) -> DataFrame:
    """(group, pos, height): how much weight of edges (group, lo, hi, weight) crosses each gap before ``pos``."""
    rise = edges.select(group, (F.col("lo") + 1).alias("pos"), F.col("weight").alias("d"))
    fall = edges.select(group, (F.col("hi") + 1).alias("pos"), (-F.col("weight")).alias("d"))
    steps = rise.unionByName(fall).unionByName(positions.select(group, "pos", F.lit(0).cast("double").alias("d"))).groupBy(group, "pos").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(group).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return positions.select(group, "pos").distinct().join(steps.select(group, "pos", F.sum("d").over(w).alias("height")), [group, "pos"])


def spaced_valleys(curve: DataFrame, group: str, min_gap: int, target: int) -> DataFrame:
    """(group, pos): lowest points first, none nearer than ``min_gap`` to one taken, target - 1 at most; sequential inside a group."""

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: list[int] = []
        for pos in pdf.sort_values(["height", "pos"], kind="stable")["pos"]:
            if len(taken) >= target - 1:
                break
            if all(abs(pos - q) >= min_gap for q in taken):
                taken.append(pos)
        return pd.DataFrame({group: [pdf[group].iloc[0]] * len(taken), "pos": sorted(taken)})

    kinds = dict(curve.dtypes)
    return curve.groupBy(group).applyInPandas(cut, f"{group} {kinds[group]}, pos {kinds['pos']}")


def proximity_groups(df: DataFrame, group: str, position: str, span: int = 100, most: int = 10) -> DataFrame:
    """Adds ``cluster``: a new one where a row lies more than ``span`` behind the first of its cluster, or the cluster is full.

    Sorted rows stream past with only the open cluster held, so a group of any length takes no memory.
    """
    kind = dict(df.dtypes)[group]
    rows = df.select(group, F.col(position).cast("long").alias(position)).repartition(group).sortWithinPartitions(group, position)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, first, n, c = None, 0, 0, -1
        for pdf in batches:
            out = []
            for g, p in zip(pdf[group], pdf[position], strict=True):
                if now is None or g != now:
                    now, first, n, c = g, p, 1, 0
                elif p - first > span or n >= most:
                    first, n, c = p, 1, c + 1
                else:
                    n += 1
                out.append(c)
            yield pdf.assign(cluster=out)

    return rows.mapInPandas(stream, f"{group} {kind}, {position} long, cluster long")


def gap_split(df: DataFrame, group: str, position: str, order: str, parts: int) -> DataFrame:
    """Adds ``part``: cut at the parts - 1 largest gaps, ties to the earlier one."""
    w = Window.partitionBy(group).orderBy(position, order)
    gap = F.coalesce(F.col(position) - F.lag(position).over(w), F.lit(0))
    ranked = df.withColumn("_gap", gap).withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(F.col("_gap").desc(), position, order)))
    is_cut = ((F.col("_rank") <= parts - 1) & (F.col("_gap") > 0)).cast("int")
    return ranked.withColumn("part", F.sum(is_cut).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_gap", "_rank")


def position_lanes(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``lane``: contiguous chunks of ceil(n / lanes); 0, 4, 8 or 16 lanes for up to 25, 200, 1000 or more records."""
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    lanes = F.when(n <= 25, 0).when(n <= 200, 4).when(n <= 1000, 8).otherwise(16)
    at = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    return df.withColumn("lane", F.when(lanes == 0, F.lit(0)).otherwise(F.floor(at / F.ceil(n / lanes))).cast("long"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each left row with ``value`` of the last right row of its key at or before it: one union and one window, no range join."""
    kinds = dict(right.dtypes)
    both = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(kinds[value])).unionByName(right.select(key, at, F.lit(0).alias("_side"), F.col(value).alias("_v")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_v")


def nearest(left: DataFrame, right: DataFrame, key: str, at: str) -> DataFrame:
    """Left rows with ``nearest``: the position of the right row of their key that is nearest to theirs, ties to the earlier one; no range join."""
    both = left.withColumn("_side", F.lit(1)).withColumn("_p", F.lit(None).cast(dict(right.dtypes)[at])).unionByName(right.select(key, at, F.lit(0).alias("_side"), F.col(at).alias("_p")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_side")
    before = F.last("_p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("_p", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    out = both.withColumn("_b", before).withColumn("_a", after).where("_side = 1")
    later = F.col("_b").isNull() | (F.col("_a") - F.col(at) < F.col(at) - F.col("_b"))
    return out.withColumn("nearest", F.when(later, F.col("_a")).otherwise(F.col("_b"))).drop("_side", "_p", "_a", "_b")


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the place of every row in a total order, from 1: ranges are sorted on their own and start where the counts before them end."""
    ranged = settle(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row a partition
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before")
    return ranged.join(F.broadcast(before), "_part").withColumn(name, place.cast("long")).drop("_part", "_before")
