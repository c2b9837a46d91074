"""The module match cascade, alternation of two record kinds, and pools of interchangeable records."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinspark.operators.gates import mutual_best, strict_best, unique_both_sides
from kinspark.operators.graph import settle, stored
from kinspark.operators.similarity_join import agreement, clear_best, position_join, similar_sets


def _open(pairs: DataFrame, matches: DataFrame) -> DataFrame:
    """Pairs of which neither end is matched."""
    return pairs.join(matches.select("a_id"), "a_id", "left_anti").join(matches.select("b_id"), "b_id", "left_anti")


def heir_veto(pairs: DataFrame, declared: DataFrame, exports: DataFrame, matches: DataFrame, floor: float = 0.6) -> DataFrame:
    """``pairs`` (a_id, b_id, ...) without those whose exports flatly contradict while another open fresh record is the prior one's heir.

    ``declared`` (a_id, b_id) of pairs that share an export or of which one exports nothing can't contradict; ``exports`` (a_id, b_id, score) is their similarity.
    """
    heirs = exports.where(F.col("score") >= floor).join(matches.select("b_id"), "b_id", "left_anti").select("a_id").distinct().withColumn("_heir", F.lit(True))
    marked = pairs.join(heirs, "a_id", "left").join(declared.select("a_id", "b_id", F.lit(True).alias("_fits")), ["a_id", "b_id"], "left")
    return marked.where("_heir is null or _fits is not null").drop("_heir", "_fits")


def module_cascade(a: DataFrame, b: DataFrame, edges_a: DataFrame, edges_b: DataFrame, disabled: frozenset[str] = frozenset(), max_rounds: int = 64) -> DataFrame:
    """(a_id, b_id, tier): unique signature; edge corroboration or a sole high overlap, to a fixpoint; unique stem; export sets; containment; graded content; graph position.

    Records have id, signature, stem and the sets items (their statements), declared (their exports) and words; edges are
    (src, dst). Each tier sees what earlier ones left; a tier in ``disabled`` is passed over. The rounds of the edge tier
    are synchronous, and a fresh record that two prior ones claim in a round goes to neither in it. Similar pairs are found
    once; every tier only takes from them what is still open. Sets are kept as 64-bit hashes.
    """
    hashed = [F.transform(c, lambda x: F.xxhash64(x)).alias(c) for c in ("items", "declared", "words")]
    a, b, edges_a, edges_b = (stored(x) for x in (a.select("id", "signature", "stem", *hashed), b.select("id", "signature", "stem", *hashed), edges_a, edges_b))
    jaccard = (F.col("inter") / (F.col("n_a") + F.col("n_b") - F.col("inter"))).alias("score")
    content = stored(similar_sets(a, b, 0.5).select("a_id", "b_id", jaccard))
    shared = stored(similar_sets(a, b, 0.4, "declared").select("a_id", "b_id", jaccard, "inter", "n_a", "n_b"))
    matches = settle(a.select(F.col("id").alias("a_id"), F.col("id").alias("b_id"), F.lit("").alias("tier")).limit(0))

    def sets(pairs: DataFrame) -> DataFrame:
        return pairs.join(a.select(F.col("id").alias("a_id"), F.col("declared").alias("_x")), "a_id").join(b.select(F.col("id").alias("b_id"), F.col("declared").alias("_y")), "b_id")

    def allowed(pairs: DataFrame) -> DataFrame:
        fits = sets(pairs.select("a_id", "b_id")).where((F.size("_x") == 0) | (F.size("_y") == 0) | F.arrays_overlap("_x", "_y"))
        return heir_veto(pairs, fits, shared, matches)

    def one_to_one(pairs: DataFrame) -> DataFrame:
        claims = F.count(F.lit(1)).over(Window.partitionBy("b_id"))
        return pairs.withColumn("_claims", claims).where("_claims = 1").drop("_claims")

    def add(found: DataFrame, tier: str | Column) -> int:
        nonlocal matches
        new = settle(found.select("a_id", "b_id", (F.lit(tier) if isinstance(tier, str) else tier).alias("tier")))
        matches = settle(matches.unionByName(new))
        return new.limit(1).count()

    def stems(df: DataFrame, end: str) -> DataFrame:
        return df.withColumnRenamed("id", end).join(matches.select(end), end, "left_anti").select(end, "stem").where("stem is not null")

    if "uniqueSignature" not in disabled:
        add(unique_both_sides(a.withColumnRenamed("id", "a_id"), b.withColumnRenamed("id", "b_id"), "signature", "a_id", "b_id"), "uniqueSignature")
    if "edge" not in disabled:
        order = Window.partitionBy("a_id").orderBy(F.desc("agree"), F.desc("score"), "b_id")
        for _ in range(max_rounds):
            near = allowed(_open(content, matches)).join(agreement(matches, edges_a, edges_b), ["a_id", "b_id"], "left").withColumn("agree", F.coalesce("agree", F.lit(0)))
            ranked = near.select("*", F.row_number().over(order).alias("_r"), F.lead("agree").over(order).alias("_agree2"), F.lead("score").over(order).alias("_score2"))
            alone = F.col("_agree2").isNull()
            first = alone | (F.col("agree") > F.col("_agree2")) | (F.col("score") > F.col("_score2") + 1e-9)
            licensed = ((F.col("agree") >= 1) & first) | (alone & (F.col("score") >= 0.8))
            found = one_to_one(ranked.where("_r = 1").where(licensed))
            if not add(found, F.when(F.col("agree") >= 1, "edgeCorroborated").otherwise("highOverlap")):
                break
        else:
            raise RuntimeError("the edge tier did not settle")
    if "stem" not in disabled:
        unique = unique_both_sides(stems(a, "a_id"), stems(b, "b_id"), "stem", "a_id", "b_id")
        add(unique.join(content.where("score >= 0.7"), ["a_id", "b_id"]), "stem")
    if "exportSet" not in disabled:
        add(mutual_best(_open(shared, matches), "a_id", "b_id", "score", 0.6), "exportSet")
    if "containment" not in disabled:
        inside = _open(shared, matches).where(F.least("n_a", "n_b") >= 2).withColumn("score", F.col("inter") / F.least("n_a", "n_b"))
        add(mutual_best(inside, "a_id", "b_id", "score", 0.75), "containment")
    if "graded" not in disabled:
        # Only a fresh record with a pair at the floor can win; only for those are the weaker rivals looked up.
        rest_a, rest_b = (df.join(matches.select(F.col(end).alias("id")), "id", "left_anti").select("id", "words") for df, end in ((a, "a_id"), (b, "b_id")))
        able = stored(similar_sets(rest_a, rest_b, 0.5, "words").select(F.col("b_id").alias("id")).distinct())
        graded = stored(similar_sets(rest_a, rest_b.join(able, "id", "left_semi"), 0.5 / 1.5 - 1e-6, "words").select("a_id", "b_id", jaccard))
        best = clear_best(graded, 0.5, 1.5, "b_id", "a_id")
        only = F.count(F.lit(1)).over(Window.partitionBy("a_id"))
        add(allowed(best.withColumn("_n", only).where("_n = 1").drop("_n")), "graded")
    if "graphPosition" not in disabled:
        add(allowed(position_join(matches, edges_a, edges_b)), "graphPosition")
    return matches


def alternate(
    pairs_one: DataFrame, pairs_two: DataFrame, links_old: DataFrame, links_new: DataFrame, rounds: int = 3, self_old: DataFrame | None = None, self_new: DataFrame | None = None, self_rounds: int = 4
) -> DataFrame:
    """(kind, old_id, new_id, round): two kinds of records identify one another in turns until nothing grows.

    ``pairs_*`` (old_id, new_id) are candidates of each kind; ``links_*`` (one, two) say which records touch. A
    candidate pair is a match when it is the only one of both its ends, or the only one of them that a touching match of
    the other kind supports. ``self_*`` (x, y) are links among records of the second kind: after each of its turns its
    own matches support its other candidates too, in up to ``self_rounds`` rounds.
    """

    def closed(pairs: DataFrame) -> DataFrame:
        x = pairs.groupBy("old_id").agg(F.count(F.lit(1)).alias("n"))
        y = pairs.groupBy("new_id").agg(F.count(F.lit(1)).alias("m"))
        return pairs.join(x, "old_id").join(y, "new_id").where("n = 1 and m = 1").select("old_id", "new_id")

    def supported(kind: str, pairs: DataFrame, witnesses: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
        """Open pairs of a kind that touch one of the ``witnesses``; old and new are links (id, near)."""
        rest = pairs.join(found[kind].select("old_id"), "old_id", "left_anti").join(found[kind].select("new_id"), "new_id", "left_anti")
        o = old.select(F.col("id").alias("old_id"), F.col("near").alias("x")).join(witnesses.select(F.col("old_id").alias("x"), F.col("new_id").alias("y")), "x")
        n = new.select(F.col("id").alias("new_id"), F.col("near").alias("y"))
        return rest.join(o, "old_id").join(n, ["new_id", "y"]).select("old_id", "new_id").distinct()

    def grown(kind: str, agree: DataFrame, r: int) -> bool:
        new = settle(closed(agree))
        if new.limit(1).count() == 0:
            return False
        found[kind] = settle(found[kind].unionByName(new))
        out.append(new.select(F.lit(kind).alias("kind"), "old_id", "new_id", F.lit(r).alias("round")))
        return True

    links = lambda df, a, b: df.select(F.col(a).alias("id"), F.col(b).alias("near"))
    found = {k: settle(closed(p)) for k, p in (("one", pairs_one), ("two", pairs_two))}
    out = [found[k].select(F.lit(k).alias("kind"), "old_id", "new_id", F.lit(0).alias("round")) for k in found]
    for r in range(1, rounds + 1):
        grew = False
        for kind, other, pairs in (("one", "two", pairs_one), ("two", "one", pairs_two)):
            grew |= grown(kind, supported(kind, pairs, found[other], links(links_old, kind, other), links(links_new, kind, other)), r)
            if kind == "two" and self_old is not None:
                for _ in range(self_rounds):
                    if not grown(kind, supported(kind, pairs, found[kind], links(self_old, "x", "y"), links(self_new, "x", "y")), r):
                        break
                    grew = True
        if not grew:
            break
    every = out[0]
    for df in out[1:]:
        every = every.unionByName(df)
    return every


def certified_pools(old: DataFrame, new: DataFrame, matches: DataFrame, demoted: DataFrame | None = None) -> DataFrame:
    """(bucket, n) of buckets whose members are interchangeable: as many old as new, none of them matched, no old one demoted, and one evidence key for all.

    Records have id, bucket and evidence (not null). Only counts meet, so a bucket of any size is one row.
    """
    x = old.join(matches.select(F.col("old_id").alias("id"), F.lit(1).alias("_done")), "id", "left")
    x = x.withColumn("_out", F.lit(0)) if demoted is None else x.join(demoted.select(F.col("old_id").alias("id"), F.lit(1).alias("_out")), "id", "left")
    y = new.join(matches.select(F.col("new_id").alias("id"), F.lit(1).alias("_done")), "id", "left")
    a = x.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("_done"), F.max("_out"), F.lit(0)).alias("_a"), F.min("evidence").alias("_lo"), F.max("evidence").alias("_hi"), F.count("evidence").alias("_k"))
    b = y.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("_done"), F.lit(0)).alias("_b"), F.min("evidence").alias("_lo2"), F.max("evidence").alias("_hi2"), F.count("evidence").alias("_k2"))
    both = a.join(b, ["bucket", "n"])
    return both.where("_a = 0 and _b = 0 and _lo = _hi and _lo2 = _hi2 and _lo = _lo2 and _k = n and _k2 = n").select("bucket", "n")


def ordinal_pools(old: DataFrame, new: DataFrame, matches: DataFrame, demoted: DataFrame | None = None) -> DataFrame:
    """(old_id, new_id): certified pools paired by source order (``pos``, then id)."""
    pools = certified_pools(old, new, matches, demoted).select("bucket")
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("pos", "id")).alias("_k")
    x, y = (df.join(pools, "bucket", "left_semi").select("bucket", F.col("id").alias(c), place) for df, c in ((old, "old_id"), (new, "new_id")))
    return x.join(y, ["bucket", "_k"]).select("old_id", "new_id")


def greedy_pairs(pairs: DataFrame, order: tuple, max_rounds: int = 10_000) -> DataFrame:
    """Of ``pairs`` (old_id, new_id, ...) those that one after another would take in a total ``order``, each end once.

    A pair that is the first of both its ends would be taken whatever comes before it, so all of those go at once, round by round.
    """
    left = settle(pairs)
    taken = settle(pairs.limit(0))
    for _ in range(max_rounds):
        first = left.withColumn("_a", F.row_number().over(Window.partitionBy("old_id").orderBy(*order))).withColumn("_b", F.row_number().over(Window.partitionBy("new_id").orderBy(*order)))
        now = settle(first.where("_a = 1 and _b = 1").drop("_a", "_b"))
        if now.limit(1).count() == 0:
            return taken
        taken = settle(taken.unionByName(now))
        left = settle(left.join(now.select("old_id"), "old_id", "left_anti").join(now.select("new_id"), "new_id", "left_anti"))
    raise RuntimeError("pairs did not settle")


def family_moves(fresh: DataFrame, prior: DataFrame) -> DataFrame:
    """(bucket, from_name, to_name, support): fresh members of a family that take a prior name their contexts support better than their own.

    Members are rows (bucket, name, context), one for each context; names are unique in their bucket and side. Only
    buckets of two or more prior members count. A name is supported by the contexts its prior member shares; a move needs
    one at least and more than the own name has; the best supported go first, ties to the lower fresh, then prior name.
    """
    family = prior.select("bucket", "name").distinct().groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").select("bucket")
    f = fresh.select("bucket", F.col("name").alias("old_id"), "context").distinct()
    p = prior.join(family, "bucket", "left_semi").select("bucket", F.col("name").alias("new_id"), "context").distinct()
    support = settle(f.join(p, ["bucket", "context"]).groupBy("bucket", "old_id", "new_id").agg(F.count(F.lit(1)).alias("support")))
    own = support.where("old_id = new_id").select("bucket", "old_id", F.col("support").alias("_own"))
    able = support.join(own, ["bucket", "old_id"], "left").where("support > coalesce(_own, 0)").drop("_own")
    keyed = able.select(F.concat_ws("\u0001", "bucket", "old_id").alias("old_id"), F.concat_ws("\u0001", "bucket", "new_id").alias("new_id"), "bucket", F.col("old_id").alias("from_name"), F.col("new_id").alias("to_name"), "support")
    moves = greedy_pairs(keyed, (F.desc("support"), "from_name", "to_name"))
    return moves.where("from_name <> to_name").select("bucket", "from_name", "to_name", "support")


def assign_pools(old: DataFrame, new: DataFrame, scores: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(bucket, old_id, new_id, score): in each bucket the best affinity first, ties to the lower old, then new id; one to one.

    ``scores`` (bucket, old_id, new_id, score) holds the pairs with an affinity above 0 only. The others are paired in
    order of their ids, which needs no pairs at all.
    """
    taken = greedy_pairs(scores, (F.desc("score"), "old_id", "new_id"), max_rounds)
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("id")).alias("_k")
    x = old.join(taken.select(F.col("old_id").alias("id")), "id", "left_anti").select("bucket", F.col("id").alias("old_id"), place)
    y = new.join(taken.select(F.col("new_id").alias("id")), "id", "left_anti").select("bucket", F.col("id").alias("new_id"), place)
    return taken.unionByName(x.join(y, ["bucket", "_k"]).select("bucket", "old_id", "new_id", F.lit(0).cast("long").alias("score")))


def token_diff_votes(pairs: DataFrame, old: str, new: str, floor: int = 2) -> DataFrame:
    """(old_name, new_name, witnesses): renames that line-aligned token differences agree on, in at least ``floor`` lines and without a rival."""
    li = pairs.select(F.explode(F.arrays_zip(F.split(old, "\n").alias("o"), F.split(new, "\n").alias("n"))).alias("x")).select("x.o", "x.n").where("o <> n")
    t = li.select(F.regexp_extract_all("o", F.lit("[A-Za-z]+"), F.lit(0)).alias("ot"), F.regexp_extract_all("n", F.lit("[A-Za-z]+"), F.lit(0)).alias("nt")).where(F.size("ot") == F.size("nt"))
    d = t.select(F.explode(F.arrays_zip("ot", "nt")).alias("x")).select(F.col("x.ot").alias("old_name"), F.col("x.nt").alias("new_name")).where("old_name <> new_name")
    counted = d.groupBy("old_name", "new_name").agg(F.count(F.lit(1)).alias("witnesses"))
    return strict_best(counted, ["old_name"], "witnesses", floor)
