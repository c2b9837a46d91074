"""Matching two snapshots of records: buckets, twins, ordinal and context pairing, and the tier cascade."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinspark.operators.gates import equal_count_keys, injective, strict_best, unique_both_sides
from kinspark.operators.graph import settle, stored
from kinspark.operators.similarity_join import overlapping_sets


def bucket_candidates(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(old_id, new_id) of every pair that shares a bucket."""
    return old.select(F.col("id").alias("old_id"), key).join(new.select(F.col("id").alias("new_id"), key), key).select("old_id", "new_id")


def twin_match(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(old_id, new_id, tier): unique where the key occurs once on either side, ambiguous where more, unmatched where never.

    Only counts are joined, so that a frequent key is one row on each side.
    """
    counts = new.groupBy(key).agg(F.count(F.lit(1)).alias("_new"), F.min("id").alias("_new_id"))
    mine = old.groupBy(key).agg(F.count(F.lit(1)).alias("_old"))
    rows = old.select("id", key).join(mine.join(counts, key, "left"), key)
    one = (F.col("_old") == 1) & (F.col("_new") == 1)
    tier = F.when(F.col("_new").isNull(), "unmatched").when(one, "unique").otherwise("ambiguous")
    return rows.select(F.col("id").alias("old_id"), F.when(one, F.col("_new_id")).alias("new_id"), tier.alias("tier"))


def match_rate(result: DataFrame) -> DataFrame:
    count = lambda t: F.count_if(F.col("tier") == t).cast("long").alias(t)
    out = result.agg(F.count_if(F.col("new_id").isNotNull()).cast("long").alias("matched"), count("ambiguous"), count("unmatched"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("rate", F.when(F.col("total") == 0, 0.0).otherwise(F.col("matched") / F.col("total")))


def ordinal_pairs(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """(old_id, new_id) by rank inside keys that occur equally often on both sides."""
    w = Window.partitionBy(*key).orderBy(*order)
    keys = equal_count_keys(old, new, key).drop("n")
    a = old.join(keys, key, "left_semi").select(*key, F.col("id").alias("old_id"), F.row_number().over(w).alias("_rank"))
    b = new.join(keys, key, "left_semi").select(*key, F.col("id").alias("new_id"), F.row_number().over(w).alias("_rank"))
    return a.join(b, [*key, "_rank"]).select("old_id", "new_id")


def neighbor_context(df: DataFrame, group: str, order: str, key: str) -> DataFrame:
    """Adds ``context``: the keys before and after, ^ and $ at the ends; null where a record is alone."""
    w = Window.partitionBy(group).orderBy(order)
    before, after = F.lag(key).over(w), F.lead(key).over(w)
    context = F.concat(F.coalesce(before, F.lit("^")), F.lit("|"), F.coalesce(after, F.lit("$")))
    return df.withColumn("context", F.when(before.isNull() & after.isNull(), F.lit(None).cast("string")).otherwise(context))


def set_identity(old: DataFrame, new: DataFrame, id_col: str = "id", key_col: str = "key") -> DataFrame:
    """(old_id, new_id) of records whose canonical set keys occur once on each side."""
    a = old.select(F.col(id_col).alias("old_id"), key_col)
    b = new.select(F.col(id_col).alias("new_id"), key_col)
    return unique_both_sides(a, b, key_col, "old_id", "new_id").select("old_id", "new_id")


@dataclass(frozen=True)
class KeyTier:
    """A tier that keeps candidates of equal ``column``. ``open_null``: a record without a value keeps its whole pool.

    ``falls_to``: how many tiers back the pool stands that is kept when this one empties it.
    """

    name: str
    column: str
    open_null: bool = False
    falls_to: int = 1


def _count_pools(new: DataFrame, keys: list[str], level: int) -> DataFrame:
    return new.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"_n{level}"), F.min("id").alias(f"_m{level}"))


def cascade(
    old: DataFrame, new: DataFrame, bucket: str, verdict_pairs: list[tuple[str, str]], tiers: list[KeyTier], shingles: str | None = None, floor: float = 0.5,
    resolver: DataFrame | None = None, partners: DataFrame | None = None, parent: str | None = None,
) -> DataFrame:
    """(old_id, new_id, tier, pool, state): the tier cascade with its gates.

    A bucket of one candidate closes unless the verdict rejects it. In larger ones ``resolver`` (old_id, new_id), where
    it names a member, comes first (tier identity); then pools are narrowed tier by tier: one left closes, none left
    ends the search as ambiguous. ``partners`` (old_id, new_id; tier enclosingStatement) come after the first tier, where
    the partner is still in its pool. Narrowing needs only how many candidates share a prefix of keys, so pools are
    counted, not enumerated; pairs are formed for the shingle tier alone, from records that every earlier tier left open.

    A candidate claimed twice is taken from all (state demoted). Then, with a ``parent`` column, a match by enclosing
    statement whose parents are matched, but to others, is taken back (state revoked). Both are ambiguous again, with
    their whole bucket. ``pool`` is how many candidates an ambiguous record keeps, 0 for all others.
    """
    keyless = [t for t in tiers if t.open_null]
    if len(keyless) > 1 or (keyless and tiers[0] is not keyless[0]):
        raise ValueError("only the first tier may keep the pool of records without a value")
    used = list(dict.fromkeys(["id", bucket, *[t.column for t in tiers], *[c for p in verdict_pairs for c in p], *([shingles] if shingles else []), *([parent] if parent else [])]))
    old, new = settle(old.select(*used)), settle(new.select(*used))  # each is read once for every tier
    member = tiers[0].column if keyless else None
    named = old.select(F.col("id").alias("_old"))
    for label, pairs in (("_id", resolver), ("_at", partners)):
        if pairs is None:
            named = named.select("*", F.lit(None).cast("long").alias(label))
        else:
            of = new.select(F.col("id").alias(label), F.col(bucket).alias(f"{label}_bucket"), *([F.col(member).alias(f"{label}_member")] if member else []))
            named = named.join(pairs.select(F.col("old_id").alias("_old"), F.col("new_id").alias(label)).join(of, label), "_old", "left")
    frames = []
    parts = [(old.where(F.col(tiers[0].column).isNotNull()), tiers), (old.where(F.col(tiers[0].column).isNull()), tiers[1:])] if keyless else [(old, tiers)]
    for rows, steps in parts:
        keys = [bucket]
        state = rows.join(_count_pools(new, keys, 0), keys, "left")
        for i, t in enumerate(steps, 1):
            keys = [*keys, t.column]
            counts = _count_pools(new, keys, i).select(*[F.col(k).alias(f"_k_{k}") for k in keys], f"_n{i}", f"_m{i}")
            on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
            state = state.join(counts, on, "left").drop(*[f"_k_{k}" for k in keys])
        state = state.join(named, F.col("id") == F.col("_old"), "left").drop("_old")
        size = lambda i: F.coalesce(F.col(f"_n{i}"), F.lit(0))
        tier, target, pool = F.lit("open"), F.lit(None).cast("long"), size(len(steps))
        in_bucket = lambda label: F.coalesce(F.col(f"{label}_bucket") == F.col(bucket), F.lit(False)) if f"{label}_bucket" in named.columns else F.lit(False)
        first = 1 if keyless and steps is tiers else 0
        for i in range(len(steps), -1, -1):
            if i == first:
                here = in_bucket("_at")
                if member and first and "_at_member" in named.columns:
                    here = here & F.coalesce(F.col("_at_member") == F.col(member), F.lit(False))
                tier, target, pool = F.when(here, "enclosingStatement").otherwise(tier), F.when(here, F.col("_at")).otherwise(target), F.when(here, 0).otherwise(pool)
            if i == 0:
                break
            n, back = size(i), size(max(i - steps[i - 1].falls_to, 0))
            tier = F.when(n == 1, steps[i - 1].name).when(n == 0, "ambiguous").otherwise(tier)
            target = F.when(n == 1, F.col(f"_m{i}")).when(n == 0, F.lit(None)).otherwise(target)
            pool = F.when(n == 1, 0).when(n == 0, back).otherwise(pool)
        known = in_bucket("_id")
        tier, target, pool = F.when(known, "identity").otherwise(tier), F.when(known, F.col("_id")).otherwise(target), F.when(known, 0).otherwise(pool)
        n0 = size(0)
        only = [bucket, *dict.fromkeys(c for p in verdict_pairs for c in p)]
        single = new.select(F.col("id").alias("_m0"), *[F.col(c).alias(f"_v_{c}") for c in only[1:]])
        state = state.join(single, "_m0", "left")
        rejects = F.lit(False)
        for mine, yours in verdict_pairs:
            rejects = rejects | F.coalesce(F.col(mine) != F.col(f"_v_{yours}"), F.lit(False))
        tier = F.when(n0 == 0, "unmatched").when((n0 == 1) & rejects, "unmatched").when(n0 == 1, "bucketUnique").otherwise(tier)
        target = F.when(n0 == 0, F.lit(None)).when((n0 == 1) & rejects, F.lit(None)).when(n0 == 1, F.col("_m0")).otherwise(target)
        frames.append(state.select(F.col("id").alias("old_id"), target.alias("new_id"), tier.alias("tier"), F.when(n0 <= 1, 0).otherwise(pool).cast("long").alias("pool"), n0.alias("_bucket"), bucket, *[t.column for t in tiers]))
    out = settle(frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1]))
    decided = out.where("tier <> 'open'").select("old_id", "new_id", "tier", "pool", "_bucket")
    still = out.where("tier = 'open'")
    if shingles:
        keys = [bucket, *[t.column for t in tiers if not t.open_null]]
        side = new.select(F.col("id").alias("_cand"), *[F.col(k).alias(f"_k_{k}") for k in keys], *([F.col(tiers[0].column).alias("_first")] if keyless else []), F.col(shingles).alias("_s"))
        on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
        pairs = still.join(old.select(F.col("id").alias("old_id"), F.col(shingles).alias("_o")), "old_id").join(side, on)
        if keyless:
            pairs = pairs.where(F.col(tiers[0].column).isNull() | (F.col(tiers[0].column) == F.col("_first")))
        pairs = pairs.where(F.size("_o") > 0).withColumn("_score", F.size(F.array_intersect("_o", "_s")) / F.size(F.array_union("_o", "_s")))
        best = strict_best(pairs.select("old_id", "_cand", "_score"), ["old_id"], "_score", floor)
        closed = F.col("_cand").isNotNull()
        still = still.join(best, "old_id", "left").select("old_id", F.col("_cand").alias("new_id"), F.when(closed, "shingleSimilarity").otherwise("ambiguous").alias("tier"), F.when(closed, 0).otherwise(F.col("pool")).alias("pool"), "_bucket")
    else:
        still = still.select("old_id", "new_id", F.lit("ambiguous").alias("tier"), "pool", "_bucket")
    every = settle(decided.unionByName(still))
    kept, demoted = injective(every.where("new_id is not null"), "new_id")

    def reopened(rows: DataFrame, state: str) -> DataFrame:
        return rows.select("old_id", F.lit(None).cast("long").alias("new_id"), F.lit("ambiguous").alias("tier"), F.col("_bucket").alias("pool"), F.lit(state).alias("state"))

    open_ = F.lit("").alias("state")
    if parent is None:
        stays, revoked = kept, None
    else:
        kept = settle(kept)
        went = kept.select(F.col("old_id").alias("_op"), F.col("new_id").alias("_went"))
        by = kept.where("tier = 'enclosingStatement'").join(old.select(F.col("id").alias("old_id"), F.col(parent).alias("_op")), "old_id").join(new.select(F.col("id").alias("new_id"), F.col(parent).alias("_np")), "new_id")
        crossed = by.where("_np is not null").join(went, "_op").where("_went <> _np").select("old_id")
        stays, revoked = kept.join(crossed, "old_id", "left_anti"), kept.join(crossed, "old_id", "left_semi")
    result = stays.select("old_id", "new_id", "tier", F.lit(0).cast("long").alias("pool"), open_)
    result = result.unionByName(reopened(demoted, "demoted")).unionByName(every.where("new_id is null").select("old_id", "new_id", "tier", "pool", open_))
    return result if revoked is None else result.unionByName(reopened(revoked, "revoked"))


def first_of(*tiers: tuple[str, Column]) -> tuple[Column, Column]:
    """(value, tier name) of the first tier that has an answer: placement by an ordered list of columns."""
    value = F.coalesce(*[c for _, c in tiers])
    name = F.lit(None).cast("string")
    for label, c in reversed(tiers):
        name = F.when(c.isNotNull(), F.lit(label)).otherwise(name)
    return value, name


def edited_candidates(old: DataFrame, new: DataFrame, least: float = 0.5) -> DataFrame:
    """(old_id, new_id, score): pairs of one head whose sets ``words`` share at least ``least`` of the larger one.

    Records have id, head and words (without repeats). Words count under their head, so a frequent head or word does not
    bring all its records together.
    """
    under = F.transform("words", lambda w: F.struct(F.col("head"), w))
    pairs = overlapping_sets(old, new, least, lambda n, m: F.ceil(F.greatest(n, m) * least - 1e-9), under)
    score = F.col("inter") / F.greatest("n_a", "n_b")
    return pairs.select(F.col("a_id").alias("old_id"), F.col("b_id").alias("new_id"), score.alias("score")).where(F.col("score") >= least)


def greedy_in_order(pairs: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """(old_id, new_id, score): each new record, by id, takes the best old one not yet taken, ties to the lower id.

    Done for all at once: every new record asks for its best old one, an old one holds the lowest id that asked and
    refuses the others for good, and those ask for their next. That ends with the result of one after another.
    """
    pairs = settle(pairs)
    mine = Window.partitionBy("new_id").orderBy(F.desc("score"), "old_id")
    theirs = Window.partitionBy("old_id")
    for _ in range(max_rounds):
        asked = pairs.withColumn("ask", F.row_number().over(mine) == 1)
        first = F.min(F.when(F.col("ask"), F.col("new_id"))).over(theirs)
        ranked = settle(asked.withColumn("first", first))
        refused = F.col("new_id") > F.coalesce(F.col("first"), F.lit(2**63 - 1))
        if ranked.where(F.col("ask") & refused).limit(1).count() == 0:
            return ranked.where("ask").select("old_id", "new_id", "score")
        pairs = ranked.where(~refused).select("old_id", "new_id", "score")
    raise RuntimeError("pairs did not settle")


def greedy_within(pairs: DataFrame, key: str, most: int = 2_000_000) -> DataFrame:
    """What greedy_in_order gives for ``pairs`` (old_id, new_id, score, key) whose ends never compete across keys.

    The pairs of a key are worked off in order in one task; keys with more than ``most`` of them go through the rounds.
    """
    pairs = stored(pairs)
    large = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(key)

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["new_id", "score", "old_id"], ascending=[True, False, True], kind="stable")
        used: set[int] = set()
        out, last = [], None
        for old, new, score in zip(pdf["old_id"].to_numpy(), pdf["new_id"].to_numpy(), pdf["score"].to_numpy(), strict=True):
            if new != last and old not in used:
                used.add(old)
                out.append((old, new, score))
                last = new
        return pd.DataFrame(out, columns=["old_id", "new_id", "score"])

    small = pairs.join(large, key, "left_anti").groupBy(key).applyInPandas(take, "old_id long, new_id long, score double")
    rest = pairs.join(large, key, "left_semi").select("old_id", "new_id", "score")
    return small.unionByName(greedy_in_order(rest)) if large.limit(1).count() else small
