"""Golden tables: ties, unequal counts, empty sets, null keys, double claims."""

import pytest
from pyspark.sql import functions as F

from kinspark.functions import scalars, similarity
from kinspark.operators import gates, graph, matching, placement, similarity_join, votes, windows
from kinspark.sources import readers, sinks


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_unique_both_sides_never_guesses(spark):
    a = spark.createDataFrame([("h1", 0), ("twin", 1), ("twin", 2)], "k string, old long")
    b = spark.createDataFrame([("twin", 0), ("h1", 1), ("twin", 2)], "k string, new long")
    assert rows(gates.unique_both_sides(a, b, "k", "old", "new"), "old", "new") == [(0, 1)]


def test_equal_count_and_unanimity(spark):
    a = spark.createDataFrame([("f1", "x"), ("f1", "x"), ("f2", "y"), ("f1", "y")], "home string, k string")
    b = spark.createDataFrame([("x",), ("x",), ("y",)], "k string")
    assert rows(gates.equal_count_keys(a, b, ["k"]), "k", "n") == [("x", 2)]
    assert rows(gates.unanimous(a, ["k"], "home"), "k", "home") == [("x", "f1")]


def test_strict_best_abstains_on_ties(spark):
    df = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.9), (2, "a", 0.9), (2, "b", 0.8), (3, "a", 0.4)], "id long, c string, s double")
    assert rows(gates.strict_best(df, ["id"], "s", 0.5), "id", "c") == [(2, "a")]


def test_injectivity_demotes_all_claims(spark):
    df = spark.createDataFrame([(1, 9), (2, 9), (3, 8)], "old long, new long")
    kept, demoted = gates.injective(df, "new")
    assert rows(kept, "old") == [(3,)]
    assert rows(demoted, "old") == [(1,), (2,)]


def test_verdict_is_three_valued(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", None), (None, None)], "x string, y string")
    got = [r[0] for r in df.select(gates.verdict([(F.col("x"), F.col("y"))])).collect()]
    assert got == ["accept", "reject", "unguarded", "unguarded"]


def test_mutual_best(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.5), (2, 1, 0.8), (2, 2, 0.7)], "a long, b long, s double")
    assert rows(gates.mutual_best(df, "a", "b", "s"), "a", "b") == [(1, 1)]


def test_empty_sets_by_definition(spark):
    df = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b", "c"])], "x array<string>, y array<string>")
    got = df.select(similarity.jaccard_both_empty_one("x", "y"), similarity.jaccard_any_empty_zero("x", "y"), similarity.containment("x", "y"), similarity.overlap_of_larger("x", "y")).collect()
    assert [tuple(r) for r in got] == [(1.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0), (pytest.approx(1 / 3), pytest.approx(1 / 3), 0.5, 0.5)]


def test_cosine_of_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [2.0, 2.0])], "x array<double>, y array<double>")
    assert [r[0] for r in df.select(similarity.cosine("x", "y")).collect()] == [0.0, pytest.approx(1.0)]


def test_votes(spark):
    v = spark.createDataFrame([("s", "a"), ("s", "a"), ("s", "b"), ("s", "b"), ("t", "a"), ("u", "a"), ("u", "a"), ("u", "b")], "slot string, v string")
    assert rows(votes.top_vote(v, "slot", "v", 2), "slot", "v") == [("u", "a")]


def test_anchored_order(spark):
    df = spark.createDataFrame([(0, 0, None), (0, 1, 4), (0, 2, None), (0, 3, 1)], "g long, pos long, rank long")
    got = windows.anchored_order(df, ["g"], "rank", "pos").orderBy("pos").collect()
    assert [r["key"] for r in got] == [-0.5, 4.0, 4.5, 1.0]
    assert [r["pos"] for r in sorted(got, key=lambda r: r["place"])] == [0, 3, 1, 2]


def test_proximity_groups_depend_on_the_first(spark):
    df = spark.createDataFrame([(1, p) for p in (0, 60, 100, 120, 300)], "g long, p long")
    got = rows(windows.proximity_groups(df, "g", "p", 100, 10), "p", "cluster")
    assert got == [(0, 0), (60, 0), (100, 0), (120, 1), (300, 2)]


def test_merged_intervals_touch(spark):
    df = spark.createDataFrame([(1, 0, 3), (1, 4, 5), (1, 8, 9)], "g long, s long, e long")
    assert rows(windows.merged_intervals(df, "g", "s", "e"), "s", "e", "n") == [(0, 5, 2), (8, 9, 1)]


def test_spaced_valleys(spark):
    df = spark.createDataFrame([(1, p, h) for p, h in enumerate([5.0, 1.0, 0.0, 2.0, 9.0, 1.0, 3.0])], "g long, pos long, height double")
    assert rows(windows.spaced_valleys(df, "g", 3, 3), "pos") == [(2,), (5,)]


def test_greedy_abstains_on_equal_scores(spark):
    df = spark.createDataFrame([(0, 1, 1, 0.9), (0, 2, 1, 0.9), (0, 3, 2, 0.8)], "c long, a_id long, b_id long, score double")
    assert rows(similarity_join.greedy_assign(df, "c"), "a_id", "b_id") == [(3, 2)]


def test_cosine_top_keeps_the_lower_id_on_ties(spark):
    v = [1.0, 0.0]
    a = spark.createDataFrame([(1, v)], "id long, vector array<double>")
    b = spark.createDataFrame([(i, v) for i in range(50)], "id long, vector array<double>")
    assert rows(similarity_join.cosine_top(a, b, 3, 0.8), "a_id", "b_id") == [(1, 0), (1, 1), (1, 2)]


def test_edited_records_pair_by_best_overlap_in_order(spark):
    import random

    rng = random.Random(5)
    make = lambda base: [(base + i, "hot" if i % 3 else "rare", rng.sample("abcdefgh", rng.randrange(0, 6))) for i in range(40)]
    old, new = make(0), make(100)
    used, want = set(), []
    for i, head, words in new:  # one after another, as the reference does
        scored = [(-len(set(w) & set(words)) / max(len(w), len(words), 1), j) for j, h, w in old if h == head and j not in used]
        best = min(scored, default=(0, 0))
        if best[0] <= -0.5:
            used.add(best[1])
            want.append((best[1], i))
    schema = "id long, head string, words array<string>"
    pairs = matching.edited_candidates(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema))
    assert len(want) > 20 and rows(matching.greedy_in_order(pairs), "old_id", "new_id") == sorted(want)


def test_components_and_waves(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101)], "x long, y long")
    got = dict(rows(graph.connected_labels(e, "x", "y"), "node", "component"))
    assert set(got.values()) == {0, 100} and got[20] == 0
    nodes = spark.createDataFrame([(1,), (2,), (3,), (8,), (9,)], "node long")
    edges = spark.createDataFrame([(2, 1), (3, 2), (8, 9), (9, 8)], "src long, dst long")
    assert rows(graph.waves(nodes, edges), "node", "wave", "forced") == [(1, 0, False), (2, 1, False), (3, 2, False), (8, 3, True), (9, 3, True)]


def test_wave_sizes_have_every_wave_and_cycles_apart(spark):
    nodes = spark.createDataFrame([(i,) for i in [*range(1, 12), 20, 21, 22]], "node long")
    chain = [(i, i - 1) for i in range(2, 12)]
    edges = spark.createDataFrame([*chain, (20, 21), (21, 20), (22, 20), (5, 5)], "src long, dst long")
    assert sorted(map(tuple, graph.wave_sizes(nodes, edges).collect()), key=str) == sorted([(i, 1, False) for i in range(11)] + [(None, 3, True)], key=str)
    assert graph.wave_sizes(nodes.limit(0), edges).count() == 0


RECORDS, NEAR, FIXED = "id long, bucket string, parent long, pos long", "id long, kind string, near long", "kind string, near long, mapped long"


def _propagated(spark, old, new, near_old, near_new, fixed=(), sure=((0, 10),)):
    frames = [(old, RECORDS), (new, RECORDS), (sure, "old_id long, new_id long"), (near_old, NEAR), (near_new, NEAR), (fixed, FIXED)]
    return rows(graph.propagate(*[spark.createDataFrame(list(x), s) for x, s in frames]).where("round > 0"), "old_id", "new_id", "round", "rung")


def test_propagation_unlocks_in_rounds(spark):
    # 0 is matched; 1 calls 0, 2 calls 1: two rounds. 5 and 6 have no evidence and stay open, 7 is alone in its bucket without evidence.
    old = [(i, b, None, i) for i, b in ((0, "a"), (1, "b"), (2, "b"), (5, "c"), (6, "c"), (7, "d"))]
    new = [(i, b, None, i) for i, b in ((10, "a"), (11, "b"), (12, "b"), (15, "c"), (16, "c"), (17, "d"))]
    assert _propagated(spark, old, new, [(1, "callee", 0), (2, "callee", 1)], [(11, "callee", 10), (12, "callee", 11)]) == [(1, 11, 1, "callee"), (2, 12, 2, "callee")]


def test_propagation_rungs_decide_in_order(spark):
    old = [(0, "a", None, 0), *[(i, "b", 900, i) for i in (1, 2, 3)], (4, "z", 900, 4)]
    new = [(10, "a", None, 0), *[(i, "b", 901, i) for i in (11, 12, 13)], (14, "z", 902, 4), (15, "z", 903, 5)]
    fixed = [("scopeParent", 900, 901), ("externalRefs", 50, 60), ("externalRefs", 51, 61)]
    parent = lambda r: [(i, "scopeParent", p) for i, _, p, _ in r if p]
    # Position under the matched parent decides 1, 2 and 3; no candidate of 4 has that parent: a contradiction.
    assert _propagated(spark, old, new, parent(old), parent(new), fixed) == [(i, i + 10, 1, "scopeOrdinal") for i in (1, 2, 3)]
    # References come after the parent and close 2; a callee comes before it and closes 3; a caller that nobody has is a contradiction for 1.
    more_old = [*parent(old), (2, "externalRefs", 50), (3, "callee", 0), (1, "caller", 0)]
    more_new = [*parent(new), (13, "externalRefs", 60), (11, "callee", 10)]
    got = _propagated(spark, old, new, more_old, more_new, fixed)
    assert (3, 11, 1, "callee") in got and (2, 13, 1, "externalRefs") in got and not [g for g in got if g[0] in (1, 4)]


def test_propagation_refuses_a_double_claim(spark):
    old = [(0, "a", None, 0), (1, "b", None, 1), (2, "b", None, 2)]
    new = [(10, "a", None, 0), (11, "b", None, 1), (12, "b", None, 2)]
    assert _propagated(spark, old, new, [(1, "callee", 0), (2, "callee", 0)], [(11, "callee", 10)]) == []


def test_constrained_order_is_the_greedy_one(spark):
    import random

    rng = random.Random(8)
    acc = [(u, u * 100 + i, rng.choice(["read", "read", "write", "effect"]), rng.random()) for u in (1, 2) for i in range(40)]
    edges = {u: set() for u in (1, 2)}
    for u, n, mode, _ in acc:
        earlier = [(m, k) for v, m, k, _ in acc if v == u and m < n]
        writes, effects = [m for m, k in earlier if k == "write"], [m for m, k in earlier if k == "effect"]
        if mode != "effect" and writes:
            edges[u].add((n, max(writes), "WAW" if mode == "write" else "RAW"))
        if mode == "write":
            edges[u] |= {(n, m, "WAR") for m, k in earlier if k == "read" and m > max(writes, default=-1)}
        if effects:
            edges[u].add((n, max(effects), "BARRIER"))
        if mode == "effect":
            edges[u] |= {(n, m, "BARRIER") for m, k in earlier if k != "effect" and m > max(effects, default=-1)}
    df = spark.createDataFrame(acc, "u long, n long, mode string, rank double")
    got = graph.order_constraints(df, "u", "n", "mode")
    assert rows(got, "u", "node", "after", "reason") == sorted((u, *e) for u in edges for e in edges[u])
    want = []
    for u in (1, 2):
        rank, left, place = {n: r for v, n, _, r in acc if v == u}, {n for v, n, _, _ in acc if v == u}, 0
        while left:
            free = [n for n in left if not any(a in left for m, a, _ in edges[u] if m == n)]
            n = min(free, key=lambda x: (rank[x], x))
            want.append((u, n, place, False))
            left.remove(n)
            place += 1
    after = got.groupBy("node").agg(F.collect_set("after").alias("after"))
    placed = graph.nearest_topological(df.select("u", F.col("n").alias("node"), "rank").join(after, "node", "left"), "u")
    assert rows(placed, "u", "node", "place", "forced") == sorted(want)


def test_cycles_are_forced_not_lost(spark):
    df = spark.createDataFrame([(1, 1, 0.5, [2]), (1, 2, 0.1, [1]), (1, 3, 0.0, [2, 99]), (1, 4, 0.9, None)], "u long, node long, rank double, after array<long>")
    got = rows(graph.nearest_topological(df, "u"), "place", "node", "forced")
    assert got == [(0, 4, False), (1, 3, True), (2, 2, True), (3, 1, False)]


def test_nearest_position_and_global_rank(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (1, 12), (2, 7)], "k long, p long")
    right = spark.createDataFrame([(1, 0), (1, 10), (1, 14), (3, 7)], "k long, p long")
    got = rows(windows.nearest(left, right, "k", "p").na.fill({"nearest": -1}), "k", "p", "nearest")
    assert got == [(1, 5, 0), (1, 10, 10), (1, 12, 10), (2, 7, -1)]
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v")).repartition(7)
    ranked = windows.global_rank(df, [F.col("v").desc()], "place")
    assert ranked.where("place <> 1000 - v").count() == 0 and ranked.count() == 1000


def test_readers_and_registry(spark, tmp_path):
    for folder, text in (("a", "one\ntwo"), ("a/node_modules/x", "skipped"), ("node_modules_not", "three")):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "f.txt").write_text(text)
    assert sorted(r["text"] for r in readers.tree(spark, str(tmp_path)).collect()) == ["one\ntwo", "three"]
    assert readers.whole_files(spark, str(tmp_path / "a" / "f.txt")).first()["text"] == "one\ntwo"
    spark.range(3).write.orc(str(tmp_path / "o"))
    assert readers.detect_kind(spark, str(tmp_path / "o")) == "orc" and readers.read(spark, "orc", str(tmp_path / "o")).count() == 3
    spark.createDataFrame([(1, 1), (2, 2)], "k long, version int").write.json(str(tmp_path / "l"))
    assert [r["k"] for r in readers.snapshot(spark, str(tmp_path / "l"), "k long, version int", 2).collect()] == [2]


def test_cascade_conserves_and_is_order_free(spark):
    cols = "id long, bucket string, m string, p string, k string, sh array<string>"
    old = spark.createDataFrame([(1, "b", "x", "p", "k", ["a"]), (2, "b", None, "p", "q", ["a"]), (3, "c", "x", "p", "k", []), (4, "zz", "x", "p", "k", [])], cols)
    new = spark.createDataFrame([(11, "b", "x", "p", "k", ["a"]), (12, "b", "y", "p", "q", ["b"]), (13, "c", "y", "p", "k", [])], cols)
    tiers = [matching.KeyTier("memberKey", "m", open_null=True), matching.KeyTier("callee", "k")]
    run = lambda o, n: rows(matching.cascade(o, n, "bucket", [("m", "m"), ("p", "p")], tiers, "sh").na.fill({"new_id": -1}), "old_id", "new_id", "tier")
    want = [(1, 11, "memberKey"), (2, 12, "callee"), (3, -1, "unmatched"), (4, -1, "unmatched")]
    assert run(old, new) == want
    assert run(old.repartition(3).orderBy(F.rand(1)), new.repartition(2).orderBy(F.rand(2))) == want


CASCADE = "id long, bucket string, m string, p string, k1 string, k2 string, k3 string, k4 string, parent long, sh array<string>"


def _one_bucket(spark, old, new, known=(), partners=()):
    """Cascade over records given by what they have beside the bucket they share."""
    base = {"bucket": "b", "m": "m", "p": "p", "k1": "1", "k2": "2", "k3": "3", "k4": "4", "parent": None, "sh": ["x"]}
    frame = lambda rs: spark.createDataFrame([tuple({**base, **r, "id": i}[c.split()[0]] for c in CASCADE.split(", ")) for i, r in rs], CASCADE)
    pairs = lambda ps: spark.createDataFrame(list(ps), "old_id long, new_id long") if ps else None
    names = [("memberKey", "m", True, 1), ("calleeShapes", "k1", False, 1), ("callerShapes", "k2", False, 1), ("calleeHashes", "k3", False, 1), ("twoHopShapes", "k4", False, 2)]
    tiers = [matching.KeyTier(*t) for t in names]
    got = matching.cascade(frame(old), frame(new), "bucket", [("m", "m"), ("p", "p")], tiers, "sh", resolver=pairs(known), partners=pairs(partners), parent="parent")
    return {r["old_id"]: (r["new_id"], r["tier"], r["pool"], r["state"]) for r in got.collect()}


@pytest.mark.parametrize(
    ("differs", "tier"), [({"m": "o"}, "memberKey"), ({"k1": "o"}, "calleeShapes"), ({"k2": "o"}, "callerShapes"), ({"k3": "o"}, "calleeHashes"), ({"k4": "o"}, "twoHopShapes"), ({"sh": ["y"]}, "shingleSimilarity")]
)
def test_each_cascade_tier_decides_alone(spark, differs, tier):
    assert _one_bucket(spark, [(1, {})], [(11, {}), (12, differs)])[1] == (11, tier, 0, "")


def test_emptied_pools_end_the_search(spark):
    two = lambda **k: [(11, k), (12, k)]
    assert _one_bucket(spark, [(1, {})], two(m="o"))[1] == (None, "ambiguous", 2, "")
    assert _one_bucket(spark, [(1, {})], [(11, {"k1": "o"}), (12, {"k1": "o"}), (13, {"m": "o"})])[1] == (None, "ambiguous", 2, "")  # the pool of memberKey
    # Two-hop shapes empty the pool: what the caller shapes left is kept, 13 among it.
    assert _one_bucket(spark, [(1, {})], [*two(k4="o"), (13, {"k3": "o"})])[1] == (None, "ambiguous", 3, "")
    assert _one_bucket(spark, [(1, {"sh": []})], two())[1] == (None, "ambiguous", 2, "")


def test_identity_and_partners_come_before_weaker_tiers(spark):
    new = [(11, {"k1": "o"}), (12, {})]
    assert _one_bucket(spark, [(1, {})], new)[1] == (12, "calleeShapes", 0, "")
    assert _one_bucket(spark, [(1, {})], new, known=[(1, 11)])[1] == (11, "identity", 0, "")
    assert _one_bucket(spark, [(1, {})], new, partners=[(1, 11)])[1] == (11, "enclosingStatement", 0, "")
    assert _one_bucket(spark, [(1, {})], [(11, {"m": "o"}), (12, {}), (13, {"k1": "o"})], partners=[(1, 11)])[1] == (12, "calleeShapes", 0, "")  # not in the pool of its member key
    assert _one_bucket(spark, [(1, {})], new, known=[(1, 99)])[1] == (12, "calleeShapes", 0, "")  # not in the bucket


def test_crossed_parents_revoke_and_double_claims_demote(spark):
    old = [(1, {"parent": 5}), (5, {"bucket": "q"})]
    new = [(11, {"parent": 16}), (12, {}), (15, {"bucket": "q"}), (16, {"bucket": "r"})]
    assert _one_bucket(spark, old, new, partners=[(1, 11)])[1] == (None, "ambiguous", 2, "revoked")  # 5 went to 15, not to 16
    assert _one_bucket(spark, old, [(11, {"parent": 15}), *new[1:]], partners=[(1, 11)])[1] == (11, "enclosingStatement", 0, "")
    twice = _one_bucket(spark, [(1, {}), (2, {})], [(11, {}), (12, {"m": "o"})])
    assert twice == {1: (None, "ambiguous", 2, "demoted"), 2: (None, "ambiguous", 2, "demoted")}


def test_ten_placement_tiers(spark):
    cols = "id long, lang string, hash_home string, shapeless boolean, votes long, name_vote string, allsame_vote string, used_ordinal boolean, identity string, identity_real string, anchor string, anchor_strong string"
    none = [None] * 8
    rows_ = [
        (1, "x", None, False, *none), (2, "x", "A", False, 1, "B", "B", False, "C", "C", "D", "D"), (3, "x", "A", True, 1, "B", "B", False, "C", "C", "D", "D"), (4, "x", None, False, 1, "B", "B", False, "C", "B", "D", "D"),
        (5, "x", None, False, 1, "B", None, True, "B", "B", "B", "B"), (6, "x", None, False, 1, "B", "B", False, None, None, None, None), (7, "x", None, False, 2, None, "E", True, "C", "C", "D", "D"),
        (8, "x", None, False, None, None, None, None, "F", None, "G", None), (9, "x", None, False, None, None, None, None, None, None, "G", None), (10, "x", None, False, 2, None, None, True, "H", "H", None, None), (11, "x", None, False, *none),
    ]
    df = spark.createDataFrame(rows_, cols)
    got = {r["id"]: (r["home"], r["tier"]) for r in placement.place_by_evidence(df, ["lang"], "id", F.lit("first")).collect()}
    assert got == {
        1: ("first", "novote"), 2: ("A", "hash"), 3: ("C", "preempt"), 4: ("D", "anchorPreempt"), 5: ("B", "ordinal"), 6: ("B", "name"), 7: ("E", "allsame"), 8: ("F", "fill"), 9: ("G", "anchor"), 10: ("G", "conflict"), 11: ("G", "novote"),
    }


def test_names_vote_by_home_or_by_order(spark):
    prior = spark.createDataFrame([(1, 0, "a", "F"), (2, 0, "a", "F"), (3, 0, "b", "F"), (4, 0, "b", "G"), (5, 0, "c", "F"), (6, 0, "c", "G")], "id long, pos int, name string, home string")
    fresh = spark.createDataFrame([(11, 0, "a"), (12, 0, "b"), (13, 0, "b"), (14, 0, "c"), (15, 0, "a"), (15, 1, "b2")], "id long, pos int, name string")
    got = rows(placement.statement_votes(prior, fresh, "home"), "id", "name_vote", "used_ordinal")
    assert got == [(11, "F", False), (12, "F", True), (13, "G", True), (15, "F", False)]  # c: two homes, one declaration: silent


def test_self_match_is_total(spark):
    df = spark.createDataFrame([(i, f"h{i % 7}" if i < 7 else "same") for i in range(10)], "id long, h string")
    got = matching.twin_match(df, df, "h")
    assert got.where("tier = 'unique' and old_id = new_id").count() == 7
    assert got.where("tier = 'ambiguous'").count() == 3


def test_placement_tiers_and_miss_reasons(spark):
    prior = spark.createDataFrame([(1, "x", "f1"), (2, "x", "f1"), (3, "y", "f1"), (4, "y", "f2")], "id long, h string, home string")
    fresh = spark.createDataFrame([("x",), ("x",), ("y",), ("y",), ("z",)], "h string")
    got = {r["h"]: (r["home"], r["miss"]) for r in placement.hash_tier(prior, fresh, "h", "home").collect()}
    assert got == {"x": ("f1", None), "y": (None, "split"), "z": (None, "absent")}


def test_span_edits_and_names(spark):
    df = spark.createDataFrame([("hello world", [(0, 5, "HI"), (6, 7, "")])], "t string, s array<struct<start:int,end:int,value:string>>")
    assert df.select(sinks.apply_spans(F.col("t"), F.col("s"))).first()[0] == "HI orld"
    n = spark.createDataFrame([(1, "x"), (2, "X"), (3, "x-2"), (4, "x")], "o long, stem string")
    names = [r["name"].lower() for r in sinks.unique_names(n, "stem", "o").collect()]
    assert len(names) == len(set(names)) == 4


def test_detection_prefers_the_definitive(spark):
    df = spark.createDataFrame([("<nav> <!DOC>",), ("none",)], "t string")
    got = [r[0] for r in df.select(readers.detect(F.col("t"), [("nav", "hint", "<nav>"), ("doc", "definitive", "<!DOC>")])).collect()]
    assert got[0]["name"] == "doc" and got[1] is None


def test_scalars(spark):
    df = spark.createDataFrame([("1.2.3", "fooBar baz", "name12", 999)], "a string, b string, c string, d long")
    r = df.select(
        scalars.blur_string(F.col("a")), scalars.kebab(F.col("b")), scalars.camel(F.col("b")), scalars.name_stem(F.col("c")), scalars.magnitude(F.col("d")),
        scalars.conflict_free(F.lit("x"), F.array(F.lit("x"), F.lit("xVal"))), scalars.singular(F.lit("boxes")),
    ).first()
    assert tuple(r) == ("__VOLATILE_SEMVER__", "foo-bar-baz", "foobarBaz", "name", 3, "xVar", "box")


def test_exact_scalar_values(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    blurred = {"v1.2.3-rc.1+b": "__VOLATILE_SEMVER__", "2024-01-02": "__STR_10__", "2024-01-02T03:04:05Z": "__VOLATILE_ISO8601__", "A" * 16: "__VOLATILE_HEX_16__", "A" * 15: "__STR_15__"}
    for value, want in blurred.items():
        assert one(scalars.blur_string(F.lit(value))) == want
    assert one(scalars.kebab(F.lit("XMLHttpRequestID"))) == "xml-http-request-id"
    stems = {"userVal2": "user", "compareResult": "compareresult", "dataItem_3Ref": "data", "fooInstance": "foo", "Val": ""}
    for name, want in stems.items():
        assert one(scalars.name_stem(F.lit(name))) == want
    rejected = {"appInitializer17": True, "float64Error": False, "theTaskRunner": True, "themeEngine": False, "noop": True, "thingVal": True, "sha256Hasher": False}
    for name, want in rejected.items():
        assert one(scalars.is_rejected_stem(F.lit(name))) == want
    assert one(scalars.carries_no_content(F.lit("var a, b;"))) and not one(scalars.carries_no_content(F.lit("var a = 1;")))
    assert one(scalars.canonical_json_text(F.lit('{"b": [{"d": 1, "c": null}], "a": "x"}'))) == '{"a":"x","b":[{"c":null,"d":1}]}'
    assert one(scalars.leaf_paths(F.lit('{"b": [{"d": 1, "c": null}], "a": {}}'))) == ["a", "b[0].c", "b[0].d"]
    assert tuple(one(scalars.edited_line_counts(F.lit("a\na\nb"), F.lit("a\nc\nd")))) == (2, 2)
    paths = {("src/a/x.js", "src/a/y.js"): "./y.js", ("src/a/x.js", "src/b/c/y.js"): "../b/c/y.js", ("x.js", "lib/y.js"): "./lib/y.js", ("a/b/x.js", "y.js"): "../../y.js"}
    for (source, target), want in paths.items():
        assert one(scalars.relative_import(F.lit(source), F.lit(target))) == want
    assert one(scalars.mask_name(F.lit("foo(food, foo)"), F.lit("foo"))) == "_(food, _)"


def test_similar_sets_equal_all_pairs(spark):
    import random

    rng = random.Random(3)
    make = lambda base: [(base + i, rng.sample("abcdefghijkl", rng.randrange(0, 9))) for i in range(60)]
    a, b = make(0), make(100)
    frame = lambda r: spark.createDataFrame(r, "id long, items array<string>")
    for floor in (0.34, 0.5, 0.6):
        want = sorted((i, j) for i, x in a for j, y in b if x and y and set(x) & set(y) and len(set(x) & set(y)) / len(set(x) | set(y)) >= floor)
        assert rows(similarity_join.similar_sets(frame(a), frame(b), floor), "a_id", "b_id") == want


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, h string")
    assert matching.twin_match(empty, empty, "h").count() == 0
    assert matching.match_rate(matching.twin_match(empty, empty, "h")).first()["rate"] == 0.0
