"""Mixing sources to target weights by subset-sum budget fitting.

Sizes are counted in words. Targets share the total by weight, none above ``cap``
times its source. A source is taken whole as often as its target allows; the rest
of the budget is fitted on the table of exact lengths: first the same share of every
length, then, where more than a window is left but few sums are reachable, those sums in
full; else long to short while more than a window is left, then a bounded knapsack
over the lengths still available closes the window exactly where it can. Documents of
a length are picked in the order of a seeded hash, so reruns agree.

Only per-length counts meet in one task, never documents: a source with a third of
all rows is a few thousand lengths. The table of sources (one row each) is ordered in
one task, which spills if it must. The pick within a length is decided by buckets
of the hash, and only the bucket in which the count runs out is ranked.

Defined results: a null or blank text has size 0 and is taken 0 times; a null source
is a source of its own, ordered last; rows that repeat are counted and taken one by
one; null ids are allowed; a very long text is one document of its length, taken whole or not; other
columns, whatever their names, are not read, and ``take_mix`` returns them as they are; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinspark.llm.shared import batches_of_texts, scratch, slices, stored, text_buffers, with_columns_renamed_free
from kinspark.llm.words import word_counts

#: Words that the knapsack closes; the bits of its table of reachable sums.
KNAPSACK_WINDOW = 1 << 16
#: Reachable sums up to which a budget beyond the window is fitted exactly, and additions that may be spent on finding them.
SPARSE_SUMS = 1 << 18
SPARSE_STEPS = 1 << 19
#: Rows (source, length) up to which a mix's decisions are broadcast, about 20 MB.
BROADCAST_LENGTHS = 200_000
_NO_ID = -(2**63)


def _ticket(doc_id: Column, seed: int) -> Column:
    """The place of a document in the seeded order of its length."""
    return F.xxhash64(F.lit(seed), doc_id)


def _size_of():
    @F.pandas_udf("long")
    def size_of(texts: pd.Series) -> pd.Series:
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
        out = [word_counts(*text_buffers(part.column(0))) for part in slices([batch], "text")]
        return pd.Series(np.concatenate(out) if out else np.zeros(0, np.int64))

    return size_of


def target_sizes(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, source_size) -> (source, rank, source_size, target), one row per source.

    Weights repeat along the sources in code-point order, null last. Raising a common level until the
    targets fill the total, with each stopped at cap * size, is the fixed point of resharing the excess.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    ranked = ranked.withColumn("stop", F.col("limit") / F.col("weight"))
    by_stop = Window.orderBy("stop", "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Level at which the total is filled if exactly the sources that stop earlier are at their limits.
    total, all_weight = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    before_limit, before_weight = F.coalesce(F.sum("limit").over(by_stop), F.lit(0.0)), F.coalesce(F.sum("weight").over(by_stop), F.lit(0.0))
    leveled = ranked.withColumn("level", (total - before_limit) / (all_weight - before_weight))
    # The right level belongs to the first source, by stop, that does not reach its limit under it.
    level = F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "rank", "level"))).over(everything).getField("level")
    return leveled.withColumn("target", F.coalesce(F.least(F.col("limit"), level * F.col("weight")), F.col("limit"))).select("source", "rank", "source_size", "target")


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = KNAPSACK_WINDOW) -> np.ndarray:
    """How many documents of each length to take so that the sum comes as near to ``budget`` from below as the window allows."""
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.astype(np.int64)
    take = np.array([int(c) * budget // total for c in counts.tolist()], np.int64)
    left = budget - int((lengths * take).sum())
    spare = counts - take
    order = np.argsort(-lengths, kind="stable")
    if left > window:
        exact = sparse_knapsack(lengths, spare, left, order)
        if exact is not None:
            for i, k in exact.items():
                take[i] += k
            return take
    for i in order.tolist():
        length = int(lengths[i])
        if left <= window:
            break
        k = min(int(spare[i]), left // length)
        take[i] += k
        spare[i] -= k
        left -= k * length
    if left <= window:
        for i, k in bounded_knapsack(lengths, spare, left, order).items():
            take[i] += k
    return take


def sparse_knapsack(lengths: np.ndarray, spare: np.ndarray, budget: int, order: np.ndarray, limit: int = SPARSE_SUMS) -> dict[int, int] | None:
    """As ``bounded_knapsack``, with the reachable sums as a set; None where there are more than ``limit`` or they take more than SPARSE_STEPS additions."""
    came: dict[int, tuple[int, int, int]] = {0: (0, -1, 0)}
    steps = 0
    for i in order.tolist():
        length, n = int(lengths[i]), int(spare[i])
        if length <= 0 or n <= 0 or length > budget:
            continue
        for base in list(came):
            most = min(n, (budget - base) // length)
            steps += most
            if steps > SPARSE_STEPS or len(came) + most > 2 * limit:
                return None
            for k in range(1, most + 1):
                came.setdefault(base + k * length, (base, i, k))
        if len(came) > limit:
            return None
        if budget in came:
            break
    at, out = max(came), {}
    while at:
        at, i, k = came[at]
        out[i] = k
    return out


def bounded_knapsack(lengths: np.ndarray, spare: np.ndarray, budget: int, order: np.ndarray) -> dict[int, int]:
    """Counts whose lengths sum to the largest reachable number up to ``budget``.

    Reachable sums are the bits of one integer. Each length is offered in groups of 1, 2, 4, ... documents;
    for every sum the first group that reached it is kept, and the sum without it was reached by earlier groups.
    """
    full = (1 << (budget + 1)) - 1
    reach = 1
    first = np.full(budget + 1, -1, np.int64)
    groups: list[tuple[int, int]] = []
    for i in order.tolist():
        length, n = int(lengths[i]), int(spare[i])
        if length > budget or length <= 0:
            continue
        n = min(n, budget // length)
        size = 1
        while n > 0:
            k = min(size, n)
            fresh = (reach << (k * length)) & full & ~reach
            if fresh:
                bits = np.frombuffer(fresh.to_bytes((budget >> 3) + 1, "little"), np.uint8)
                first[np.flatnonzero(np.unpackbits(bits, bitorder="little")[: budget + 1])] = len(groups)
                reach |= fresh
            groups.append((i, k))
            n -= k
            size *= 2
        if reach >> budget & 1:
            break
    at = reach.bit_length() - 1
    out: dict[int, int] = {}
    while at:
        i, k = groups[first[at]]
        out[i] = out.get(i, 0) + k
        at -= k * int(lengths[i])
    return out


def _fit_source(table: pd.DataFrame) -> pd.DataFrame:
    table = table.sort_values("size", kind="stable")
    size, target = int(table["source_size"].iloc[0]), float(table["target"].iloc[0])
    whole = int(target // size) if size else 0
    picks = fit_counts(table["size"].to_numpy(np.int64), table["n"].to_numpy(np.int64), round(target) - whole * size)
    return pd.DataFrame({"rank": table["rank"], "size": table["size"], "whole": whole, "pick": picks})


def mix_to_targets(
    docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row per row of ``docs``: (doc_id, source, size, source_size, target, copies, taken)."""
    rows = _decided(docs, weights, cap, seed, id_col, text_col, source_col)
    copies = F.col("whole") + F.col("picked")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def _decided(docs: DataFrame, weights: tuple[float, ...], cap: float, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, id, source, size, ticket, source_size, target, whole, picked): taken ``whole`` times, and once more where picked is 1."""
    batches_of_texts(docs.sparkSession)
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), _size_of()(F.col(text_col)).alias("size"))
    ticket = _ticket(F.coalesce("doc_id", F.lit(_NO_ID)), seed)
    sized = stored(found.withColumn("ticket", ticket).withColumn("bucket", F.shiftrightunsigned("ticket", 56).cast("int")), "mix_sizes")
    counts = stored(sized.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("n")), "mix_counts")
    targets = stored(target_sizes(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, cap), "mix_targets")
    of = targets.withColumnRenamed("source", "_source")
    ranked = counts.join(of, F.col("source").eqNullSafe(F.col("_source"))).drop("source", "_source")
    # Buckets in signed order of the ticket: its top byte from -128 on.
    ranked = ranked.withColumn("turn", (F.col("bucket") + 128) % 256)
    per_length = ranked.where("size > 0").groupBy("rank", "size", "source_size", "target").agg(F.sum("n").alias("n"))
    plan = per_length.groupBy("rank").applyInPandas(_fit_source, "rank int, size long, whole long, pick long")
    along = Window.partitionBy("rank", "size").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    cut = ranked.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0))).join(plan, ["rank", "size"], "left")
    cut = cut.select(
        "rank", "size", "bucket", "source_size", "target", F.coalesce("whole", F.lit(0)).alias("whole"),
        F.greatest(F.lit(0), F.least(F.col("n"), F.coalesce("pick", F.lit(0)) - F.col("before"))).alias("here"), "n",
    )
    names = targets.select(F.col("source").alias("_source"), "rank")
    rows = sized.join(names, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").join(cut, ["rank", "size", "bucket"])
    sure = rows.where("here = 0 or here = n").withColumn("picked", (F.col("here") > 0).cast("long"))
    open_rows = rows.where("here > 0 and here < n")
    nth = F.row_number().over(Window.partitionBy("rank", "size", "bucket").orderBy("ticket", "doc_id"))
    ranked_rows = open_rows.withColumn("picked", (nth <= F.col("here")).cast("long"))
    return sure.unionByName(ranked_rows).withColumn("id", F.coalesce("doc_id", F.lit(_NO_ID)))


def take_mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns as they are, each as often as the mix takes it.

    Whole texts stay where they are: of each source and length the decision is one row (how often all of its
    documents are taken, and the last ticket and id of those taken once more). Those rows are broadcast while there
    are at most ``BROADCAST_LENGTHS``; beyond, the documents are joined to them by a shuffle. Rows alike in id, source
    and size are taken alike. Documents without words, which no budget counts, stay once.
    """
    with scratch(docs.sparkSession) as keep:
        plan = _decided(docs, weights, cap, seed, id_col, text_col, source_col)
        last = F.max(F.when(F.col("picked") > 0, F.struct("ticket", "id"))).alias("last")
        cuts = plan.where("size > 0").groupBy("source", "size").agg(F.max("whole").alias("whole"), last)
        mark, side = with_columns_renamed_free(docs, "_mix"), with_columns_renamed_free(docs, "_mix_cut")
        cuts = keep(cuts.select(F.struct("source", "size", "whole", "last").alias(side)), "mix_cuts")
    if cuts.count() <= BROADCAST_LENGTHS:
        cuts = F.broadcast(cuts)
    own = F.struct(F.col(source_col).cast("string").alias("s"), _size_of()(F.col(text_col)).alias("n"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"))
    sized = docs.withColumn(mark, own)
    mine, cut = (lambda c: F.col(mark)[c]), (lambda c: F.col(side)[c])
    joined = sized.join(cuts, mine("s").eqNullSafe(cut("source")) & (mine("n") == cut("size")), "left")
    ticket = F.struct(_ticket(mine("id"), seed).alias("ticket"), mine("id").alias("id"))
    picked = F.coalesce((ticket <= cut("last")).cast("long"), F.lit(0))
    times = F.when(mine("n") == 0, 1).otherwise(F.coalesce(cut("whole"), F.lit(0)) + picked)
    counted = joined.withColumn(mark, times.cast("long")).where(F.col(mark) > 0)
    return counted.withColumn(mark, F.explode(F.sequence(F.lit(1).cast("long"), F.col(mark)))).select(*[F.col(f"`{c}`") for c in docs.columns])
