"""Similarity joins: inverted-index joins for sets (exact), blocks of matrix products for vectors, greedy one-to-one assignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinspark.operators.gates import mutual_best, strict_best
from kinspark.operators.graph import forget, stored


def shared_items(a: DataFrame, b: DataFrame, items: str = "items") -> DataFrame:
    """(a_id, b_id, inter, n_a, n_b) of sets that share an item, by an inverted index: cost follows the shared items, not |A| * |B|."""
    one = a.select(F.col("id").alias("a_id"), F.size(items).alias("n_a"), F.explode(items).alias("_x"))
    two = b.select(F.col("id").alias("b_id"), F.size(items).alias("n_b"), F.explode(items).alias("_x"))
    return one.join(two, "_x").groupBy("a_id", "b_id").agg(F.count(F.lit(1)).alias("inter"), F.min("n_a").cast("long").alias("n_a"), F.min("n_b").cast("long").alias("n_b"))


#: Bits of the parity maps that travel with each row of a prefix, in longs.
_MAP = 4


def _prefixes(sets: DataFrame, floor: float) -> DataFrame:
    """(item, cls, n, pos, on_a, on_b, m0...) of ``sets`` (cls, s, on_a, on_b): the n - ceil(floor * n) + 1 rarest items of each, in one global order.

    Rare are items of a rarely used range of the hash (up to 2^22 ranges, their counts in the order of powers of two): any
    order that all sets share is right, and this one needs neither a shuffle of the items nor a table of all of them. Items
    of a range that the other side does not use are passed over.
    """
    import numpy as np
    import pyarrow as pa

    total = sets.agg(F.sum(F.size("s"))).first()[0] or 0
    ranges = 1 << min(22, max(16, int(total).bit_length() - 1))
    range_ = F.col("x").bitwiseAND(F.lit(ranges - 1).cast("long")).cast("int").alias("x")
    used = F.least(F.count(F.lit(1)), F.lit(2**31 - 1)).cast("int").alias("c")
    count = sets.select("on_a", "on_b", F.explode("s").alias("x")).groupBy(range_).agg(used, F.bool_or("on_a").alias("a"), F.bool_or("on_b").alias("b")).toArrow()
    rank = np.zeros(ranges, np.uint8)
    rank[count["x"].to_numpy()] = np.minimum(255, 8 * np.log2(count["c"].to_numpy())).astype(np.uint8)

    has = np.zeros((2, ranges), bool)
    for i, c in enumerate("ab"):
        has[i, count["x"].to_numpy()] = count[c].to_numpy()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, cls = batch.column("s"), batch.column("cls").to_numpy()
            n = np.diff(s.offsets.to_numpy()).astype(np.int64)
            x = s.flatten().to_numpy()
            if not len(x):
                continue
            first = np.cumsum(n) - n
            row = np.repeat(np.arange(len(n)), n)
            bit = (x >> 24) & (64 * _MAP - 1)
            one = np.uint64(1) << (bit & 63).astype(np.uint64)
            maps = [np.bitwise_xor.reduceat(np.where(bit >> 6 == i, one, np.uint64(0)), first).view(np.int64) for i in range(_MAP)]
            order = np.lexsort((x, rank[x & (ranges - 1)], row))
            pos = np.arange(len(x)) - first[row] + 1
            keep = pos <= (n - np.ceil(n * floor - 1e-9).astype(np.int64) + 1)[row]
            on_a, on_b = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in ("on_a", "on_b"))
            where = x[order] & (ranges - 1)
            keep &= (on_a & has[1, where]) | (on_b & has[0, where])
            r = row[keep]
            at = lambda c: batch.column(c).take(pa.array(r))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[order][keep]), pa.array(cls[r]), pa.array(n[r].astype(np.int32)), pa.array(pos[keep].astype(np.int32)), at("on_a"), at("on_b"), *[pa.array(m[r]) for m in maps]],
                names=["item", "cls", "n", "pos", "on_a", "on_b", *[f"m{i}" for i in range(_MAP)]],
            )

    return sets.mapInArrow(cut, "item long, cls long, n int, pos int, on_a boolean, on_b boolean, " + ", ".join(f"m{i} long" for i in range(_MAP)))


def overlapping_sets(a: DataFrame, b: DataFrame, floor: float, need: Callable[[Column, Column], Column], items: Column | str = "items") -> DataFrame:
    """(a_id, b_id, inter, n_a, n_b) of sets (arrays without repeats) that share ``need(n_a, n_b)`` items or more.

    ``need`` is at least ``floor`` times the size of either set. Equal sets are one class, compared once with others and
    expanded at the end. Classes meet in their rarest items, where as many items can follow in both as they still have to
    share; parity maps of all items bound what two sets differ in. What is left is counted. Items are 64-bit hashes.
    """
    hashed = lambda df, side: df.select("id", F.lit(side).alias("side"), F.array_sort(F.transform(items, lambda x: F.xxhash64(x))).alias("s"))
    read = stored(hashed(a, 0).unionByName(hashed(b, 1)))
    both = read.where(F.size("s") > 0).withColumn("cls", F.xxhash64("s"))
    sets = stored(both.groupBy("cls").agg(F.first("s").alias("s"), F.bool_or(F.col("side") == 0).alias("on_a"), F.bool_or(F.col("side") == 1).alias("on_b")))
    both = stored(both.select("id", "side", "cls"))
    forget(read)
    rare = _prefixes(sets, floor)
    end = lambda c: rare.where(f"on_{c}").select("item", F.col("cls").alias(f"cls_{c}"), F.col("n").alias(f"n_{c}"), F.col("pos").alias(f"pos_{c}"), *[F.col(f"m{i}").alias(f"m{i}_{c}") for i in range(_MAP)])
    n_a, n_b = F.col("n_a"), F.col("n_b")
    apart = sum((F.bit_count(F.col(f"m{i}_a").bitwiseXOR(F.col(f"m{i}_b"))) for i in range(1, _MAP)), F.bit_count(F.col("m0_a").bitwiseXOR(F.col("m0_b"))))
    least = need(n_a, n_b)
    able = (F.least(n_a - F.col("pos_a"), n_b - F.col("pos_b")) + 1 >= least) & (n_a + n_b - apart >= 2 * least)
    x, y = end("a"), end("b")
    met = x.join(y, (x["item"] == y["item"]) & (F.col("cls_a") != F.col("cls_b")) & able).select("cls_a", "cls_b").distinct()
    whole = lambda c: sets.where(f"on_{c}").select(F.col("cls").alias(f"cls_{c}"), F.col("s").alias(f"s_{c}"))
    counted = met.join(whole("a"), "cls_a").join(whole("b"), "cls_b").select("cls_a", "cls_b", F.size(F.array_intersect("s_a", "s_b")).cast("long").alias("inter"), F.size("s_a").cast("long").alias("n_a"), F.size("s_b").cast("long").alias("n_b")).where(F.col("inter") >= least)
    size = F.size("s").cast("long")
    pairs = counted.unionByName(sets.where("on_a and on_b").select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b"), size.alias("inter"), size.alias("n_a"), size.alias("n_b")))
    member = lambda side, c: both.where(F.col("side") == side).select(F.col("cls").alias(f"cls_{c}"), F.col("id").alias(f"{c}_id"))
    return pairs.join(member(0, "a"), "cls_a").join(member(1, "b"), "cls_b").select("a_id", "b_id", "inter", "n_a", "n_b")


def similar_sets(a: DataFrame, b: DataFrame, floor: float, items: str = "items") -> DataFrame:
    """(a_id, b_id, inter, n_a, n_b) of sets (arrays without repeats) with a Jaccard similarity of at least ``floor``."""
    return overlapping_sets(a, b, floor, lambda n_a, n_b: F.ceil((n_a + n_b) * (floor / (1 + floor)) - 1e-9), items).where(_jaccard() >= floor)


def _jaccard() -> Column:
    return F.col("inter") / (F.col("n_a") + F.col("n_b") - F.col("inter"))


def _contained() -> Column:
    return F.col("inter") / F.least("n_a", "n_b")


def clear_best(pairs: DataFrame, floor: float = 0.5, margin: float = 1.5, end: str = "a_id", other: str = "b_id") -> DataFrame:
    """Of each end the best pair, where it reaches the floor and ``margin`` times the second best."""
    order = Window.partitionBy(end).orderBy(F.col("score").desc(), other)
    ranked = pairs.withColumn("_rank", F.row_number().over(order)).withColumn("_second", F.lead("score").over(order))
    clear = F.col("_second").isNull() | (F.col("score") >= F.lit(margin) * F.col("_second"))
    return ranked.where((F.col("_rank") == 1) & (F.col("score") >= floor) & clear).drop("_rank", "_second")


def export_set_join(a: DataFrame, b: DataFrame, floor: float = 0.6) -> DataFrame:
    """Mutual best by Jaccard."""
    return mutual_best(similar_sets(a, b, floor).withColumn("score", _jaccard()), "a_id", "b_id", "score", floor).select("a_id", "b_id", "score")


def containment_join(a: DataFrame, b: DataFrame, floor: float = 0.75, jaccard_floor: float = 0.4, least: int = 2) -> DataFrame:
    """Mutual best by containment, with a floor for Jaccard and for the size of both sets."""
    pairs = similar_sets(a, b, jaccard_floor).where(F.least("n_a", "n_b") >= least)
    return mutual_best(pairs.withColumn("score", _contained()), "a_id", "b_id", "score", floor).select("a_id", "b_id", "score")


def graded_join(a: DataFrame, b: DataFrame, floor: float = 0.5, margin: float = 1.5) -> DataFrame:
    """The best by Jaccard, where it reaches the floor and ``margin`` times the second best (one below floor / margin can't rival it)."""
    return clear_best(similar_sets(a, b, floor / margin - 1e-6).withColumn("score", _jaccard()), floor, margin).select("a_id", "b_id", "score")


def multiset_join(a: DataFrame, b: DataFrame, floor: float = 0.5) -> DataFrame:
    """All pairs whose multisets (array ``items``, repeats count) overlap by the floor or more: sets of items with the number of their repeat."""

    def numbered(df: DataFrame) -> DataFrame:
        once = df.select("id", F.array_sort(F.transform("items", lambda x: F.xxhash64(x))).alias("_s"))
        return stored(once).select("id", F.transform("_s", lambda x, i: F.struct(x, i - F.array_position("_s", x).cast("int"))).alias("items"))

    return similar_sets(numbered(a), numbered(b), floor).select("a_id", "b_id", _jaccard().alias("score"))


def content_anchor(a: DataFrame, b: DataFrame, token_floor: float = 0.5) -> DataFrame:
    """(a_id, b_id, score): literals (array ``literals``) unique on both sides that all point to one record, with tokens (``items``) alike and no rival."""
    one = a.select(F.col("id").alias("a_id"), F.explode(F.array_distinct("literals")).alias("_x")).groupBy("_x").agg(F.count(F.lit(1)).alias("_na"), F.min("a_id").alias("a_id")).where("_na = 1")
    two = b.select(F.col("id").alias("b_id"), F.explode(F.array_distinct("literals")).alias("_x")).groupBy("_x").agg(F.count(F.lit(1)).alias("_nb"), F.min("b_id").alias("b_id")).where("_nb = 1")
    votes = one.join(two, "_x").groupBy("b_id").agg(F.min("a_id").alias("a_id"), F.max("a_id").alias("_hi")).where("a_id = _hi").drop("_hi")
    both = votes.join(a.select(F.col("id").alias("a_id"), F.col("items").alias("_i")), "a_id").join(b.select(F.col("id").alias("b_id"), F.col("items").alias("_j")), "b_id")
    most = F.greatest(F.size("_i"), F.size("_j"))
    scored = both.withColumn("score", F.when(most == 0, 0.0).otherwise(F.size(F.array_intersect("_i", "_j")) / most)).where(F.col("score") >= token_floor)
    claims = scored.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("a_id")))
    return claims.where("_n = 1").select("a_id", "b_id", "score")


def cosine_top(a: DataFrame, b: DataFrame, k: int = 3, floor: float = 0.8, block: int = 2048) -> DataFrame:
    """(a_id, b_id, score): up to k best of B for each of A, at the floor or above, ties to the lower id.

    Either side is cut into blocks of about ``block`` vectors; pairs of blocks are matrix products, and only
    each block's best rows leave them. Nothing is broadcast, and no pair of rows is formed by a join. Scores are rounded
    to nine places, so that equal vectors tie whatever block they are in.
    """
    import numpy as np

    spark = a.sparkSession

    def packed(df: DataFrame, name: str) -> DataFrame:
        n = max(1, -(-df.count() // block))
        dealt = df.select(F.col("id"), F.col("vector").cast("array<double>").alias("vector"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(name))

        def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            x = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
            size = np.sqrt((x * x).sum(1, keepdims=True))
            x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
            return pd.DataFrame({name: [key[0]], f"{name}_ids": [pdf["id"].to_numpy(np.int64).tobytes()], f"{name}_x": [x.tobytes()]})

        return dealt.where("vector is not null").groupBy(name).applyInPandas(one, f"{name} int, {name}_ids binary, {name}_x binary"), n

    (left, n_left), (right, n_right) = packed(a, "p"), packed(b, "q")
    grid = spark.range(n_left * n_right).select((F.col("id") % n_left).cast("int").alias("p"), F.floor(F.col("id") / n_left).cast("int").alias("q"))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                i, j = np.frombuffer(row.p_ids, np.int64), np.frombuffer(row.q_ids, np.int64)
                order = np.argsort(j, kind="stable")
                s = np.frombuffer(row.p_x, np.float64).reshape(len(i), -1) @ np.frombuffer(row.q_x, np.float64).reshape(len(j), -1)[order].T
                s = np.round(s, 9)
                s[np.isnan(s)] = -np.inf
                every = np.arange(len(i))
                # The first of equal maxima is the lower id.
                for _ in range(min(k, len(j))):
                    top = s.argmax(axis=1)
                    score = s[every, top]
                    s[every, top] = -np.inf
                    ok = score >= floor
                    yield pd.DataFrame({"a_id": i[ok], "b_id": j[order][top[ok]], "score": score[ok]})

    found = grid.join(left, "p").join(right, "q").mapInPandas(best, "a_id long, b_id long, score double")
    rank = F.row_number().over(Window.partitionBy("a_id").orderBy(F.col("score").desc(), "b_id"))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


#: Pairs still open that one task works off in order, so that a last long chain of rivals doesn't take a round a link.
_LAST = 10_000


def greedy_assign(pairs: DataFrame, component: str | None = None) -> DataFrame:
    """(a_id, b_id, score): best first, one to one; an equal score that shares an end with a free rival makes both abstain.

    A pair is free where no free pair with a higher score shares an end with it, and taken where no other free pair does.
    Rounds find the free ones: of the open pairs those that are best at both ends are free and shut out the lower ones there.
    Rounds follow the longest chain of rivals, not the pairs; no task holds more than the pairs of one end or ``_LAST`` open ones.
    ``component`` names a column whose values keep their pairs apart; pairs that don't share an end never compete, with or without one.
    """
    group = F.col(component) if component else F.lit(0)
    cols = ["_g", "a_id", "b_id", "score"]
    at_a, at_b = Window.partitionBy("a_id", "_g"), Window.partitionBy("b_id", "_g")
    score, lower_a, lower_b = F.col("score"), F.col("score") < F.col("_ma"), F.col("score") < F.col("_mb")

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(pdf[cols].itertuples(index=False, name=None), key=lambda r: -r[3])
        done_a: dict[tuple, float] = {}
        done_b: dict[tuple, float] = {}
        out = []
        for g, a, b, s in rows:
            # An end that a pair of the same score has taken is still free for this one.
            if done_a.get((g, a), s) == s and done_b.get((g, b), s) == s:
                done_a[g, a] = done_b[g, b] = s
                out.append((g, a, b, s))
        return pd.DataFrame(out, columns=cols)

    tables = [stored(pairs.select(group.alias("_g"), F.col("a_id").cast("long").alias("a_id"), F.col("b_id").cast("long").alias("b_id"), F.col("score").cast("double").alias("score"), F.lit(False).alias("_free")).where("score is not null"))]
    free = []
    while (left := tables[-1].where("not _free").count()) > _LAST:
        x = tables[-1].withColumn("_ma", F.max("score").over(at_a)).withColumn("_shut", F.bool_or("_free").over(at_a))
        x = x.where(~F.col("_free") & ~(F.col("_shut") & lower_a)).withColumn("_mb", F.max("score").over(at_b))
        x = x.withColumn("_free", (score == F.col("_ma")) & (score == F.col("_mb"))).withColumn("_shut", F.bool_or("_free").over(at_b))
        tables.append(stored(x.where(~(F.col("_shut") & lower_b)).select(*cols, "_free")))
        free.append(tables[-1].where("_free").select(*cols))
    if left:
        rest = tables[-1].withColumn("_shut", F.max(F.when(F.col("_free"), score)).over(at_a))
        rest = rest.where("not _free and (_shut is null or score >= _shut)").select(*cols)
        free.append(rest.groupBy().applyInPandas(last, rest.schema))
    if not free:
        free = [tables[0].select(*cols)]
    found = free[0]
    for more in free[1:]:
        found = found.unionByName(more)
    alone = (F.count(F.lit(1)).over(at_a) == 1) & (F.count(F.lit(1)).over(at_b) == 1)
    taken = stored(found.withColumn("_alone", alone).where("_alone").select("a_id", "b_id", "score"))
    for table in tables:
        forget(table)
    return taken


def stem_join(a: DataFrame, b: DataFrame, floor: float = 0.7) -> DataFrame:
    """(a_id, b_id, score): unique stems on both sides (columns id, stem, items) whose sets have a Jaccard similarity at the floor; only such pairs are compared."""
    # The counts say which ids are alone; only those fetch their sets.
    one = a.groupBy("stem").agg(F.count(F.lit(1)).alias("_na"), F.min("id").alias("a_id")).where("_na = 1")
    two = b.groupBy("stem").agg(F.count(F.lit(1)).alias("_nb"), F.min("id").alias("b_id")).where("_nb = 1")
    pairs = one.join(two, "stem").select("a_id", "b_id")
    both = pairs.join(a.select(F.col("id").alias("a_id"), F.col("items").alias("_i")), "a_id").join(b.select(F.col("id").alias("b_id"), F.col("items").alias("_j")), "b_id")
    inter = F.size(F.array_intersect("_i", "_j"))
    scored = both.select("a_id", "b_id", inter.alias("inter"), F.size("_i").alias("n_a"), F.size("_j").alias("n_b")).where("inter > 0")
    return scored.select("a_id", "b_id", _jaccard().alias("score")).where(F.col("score") >= floor)


def agreement(matches: DataFrame, edges_a: DataFrame, edges_b: DataFrame) -> DataFrame:
    """(a_id, b_id, agree): how many imports and importers of two open records map onto each other through ``matches`` (a_id, b_id). Edges (src, dst)."""

    def near(edges: DataFrame, end: str) -> DataFrame:
        out = edges.select(F.col("src").alias(end), F.lit("imports").alias("way"), F.col("dst").alias("near"))
        return out.unionByName(edges.select(F.col("dst").alias(end), F.lit("importers").alias("way"), F.col("src").alias("near"))).distinct()

    mapped = near(edges_a, "a_id").join(matches.select("a_id"), "a_id", "left_anti").join(matches.select(F.col("a_id").alias("near"), F.col("b_id").alias("mapped")), "near").select("a_id", "way", F.col("mapped").alias("near"))
    other = near(edges_b, "b_id").join(matches.select("b_id"), "b_id", "left_anti")
    return mapped.join(other, ["way", "near"]).groupBy("a_id", "b_id").agg(F.count(F.lit(1)).alias("agree"))


def position_join(matches: DataFrame, edges_a: DataFrame, edges_b: DataFrame) -> DataFrame:
    """(a_id, b_id, score): unmatched records whose matched neighbours agree most, the strict best both ways."""
    return mutual_best(agreement(matches, edges_a, edges_b).withColumnRenamed("agree", "score"), "a_id", "b_id", "score").select("a_id", "b_id", "score")


__all__ = [
    "agreement", "clear_best", "containment_join", "content_anchor", "cosine_top", "export_set_join", "graded_join", "greedy_assign", "multiset_join", "overlapping_sets", "position_join",
    "shared_items", "similar_sets", "stem_join", "strict_best",
]
