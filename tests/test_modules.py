"""Composite matchers on tiny tables."""

from kinspark.operators import modules
from kinspark.streaming import streams


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


RECORD = "id long, signature string, stem string, items array<string>, declared array<string>, words array<string>"
EDGE = "src long, dst long"


def cascade(spark, a, b, edges_a=(), edges_b=(), **options):
    frame = lambda r: spark.createDataFrame([(i, s, st, list(it), list(de), list(wo)) for i, s, st, it, de, wo in r], RECORD)
    return rows(modules.module_cascade(frame(a), frame(b), spark.createDataFrame(list(edges_a), EDGE), spark.createDataFrame(list(edges_b), EDGE), **options), "a_id", "b_id", "tier")


def test_tiers_in_order_and_sole_overlap_floor(spark):
    a = [(1, "h1", "x", "pq", "", ""), (2, "t", "y", "abcde", "", ""), (3, "t", "z", "lmnop", "", "")]
    b = [(11, "h1", "q", ["zz"], "", ""), (12, "u", "y2", "abcdex", "", ""), (13, "v", "z2", "lmnxy", "", "")]
    assert cascade(spark, a, b) == [(1, 11, "uniqueSignature"), (2, 12, "highOverlap")]  # 3 against 13: 3 of 7 shared, no tier


def test_edge_tier_runs_to_a_fixpoint(spark):
    # Overlaps of 4 in 6: below 0.8, so only edges license them; 2 imports 1, 3 imports 2.
    a = [(1, "h", None, "z", "", ""), (2, "a", None, "abcde", "", ""), (3, "b", None, "lmnop", "", ""), (4, "c", None, "qrstu", "", "")]
    b = [(11, "h", None, "z", "", ""), (12, "d", None, "abcdx", "", ""), (13, "e", None, "lmnox", "", ""), (14, "f", None, "qrstx", "", "")]
    got = cascade(spark, a, b, [(2, 1), (3, 2)], [(12, 11), (13, 12)])
    assert got == [(1, 11, "uniqueSignature"), (2, 12, "edgeCorroborated"), (3, 13, "edgeCorroborated")]
    assert cascade(spark, a, b, [(2, 1), (3, 2)], [(12, 11), (13, 12)], disabled=frozenset({"edge"})) == [(1, 11, "uniqueSignature"), (2, 12, "graphPosition")]


def test_the_heir_keeps_a_neighbour_off(spark):
    # 12 shares half of 2's statements and its import, but exports nothing alike, while 13 exports the same names.
    a = [(1, "h", None, "z", "", ""), (2, "a", None, "ab", ["p", "q"], "")]
    b = [(11, "h", None, "z", "", ""), (12, "d", None, "a", ["x"], ""), (13, "e", None, "k", ["p", "q"], "")]
    assert cascade(spark, a, b, [(2, 1)], [(12, 11)]) == [(1, 11, "uniqueSignature"), (2, 13, "exportSet")]
    assert (2, 12, "edgeCorroborated") in cascade(spark, a, b[:2], [(2, 1)], [(12, 11)])


def test_stem_containment_graded_and_position(spark):
    a = [(1, "h", None, "z", "", ""), (2, "a", "s", "abcdefg", "", ""), (3, "b", None, "", "pqrs", ""), (4, "c", None, "", "", "uvwx"), (5, "d", None, "", "", "")]
    b = [(11, "h", None, "z", "", ""), (12, "e", "s", "abcdefx", "", ""), (13, "f", None, "", "pqrtuvw", ""), (14, "g", None, "", "", "uvwy"), (15, "i", None, "", "", "")]
    got = cascade(spark, a, b, [(5, 1)], [(15, 11)])
    assert got == [(1, 11, "uniqueSignature"), (2, 12, "stem"), (4, 14, "graded"), (5, 15, "graphPosition")]  # pqrs in pqrtuvw: three quarters contained, but 3 of 8 in all
    assert cascade(spark, [a[2]], [(13, "f", None, "", "pqrtu", "")]) == [(3, 13, "containment")]


def test_alternation_unlocks_the_other_kind(spark):
    one = spark.createDataFrame([(1, 11), (2, 12), (2, 13), (3, 12), (3, 13)], "old_id long, new_id long")
    two = spark.createDataFrame([(5, 15), (5, 16), (6, 15), (6, 16)], "old_id long, new_id long")
    old = spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "one long, two long")
    new = spark.createDataFrame([(11, 15), (12, 15), (13, 16)], "one long, two long")
    got = rows(modules.alternate(one, two, old, new), "kind", "old_id", "new_id")
    assert ("one", 1, 11) in got and ("two", 5, 15) in got and ("one", 2, 12) in got


def test_alternation_second_kind_supports_itself(spark):
    one = spark.createDataFrame([(1, 11)], "old_id long, new_id long")
    two = spark.createDataFrame([(5, 15), (5, 16), (6, 15), (6, 16), (7, 17), (7, 18), (8, 17), (8, 18)], "old_id long, new_id long")
    old, new = spark.createDataFrame([(1, 5)], "one long, two long"), spark.createDataFrame([(11, 15)], "one long, two long")
    x, y = spark.createDataFrame([(7, 5)], "x long, y long"), spark.createDataFrame([(17, 15)], "x long, y long")
    got = rows(modules.alternate(one, two, old, new, self_old=x, self_new=y), "kind", "old_id", "new_id", "round")
    assert ("two", 5, 15, 1) in got and ("two", 7, 17, 1) in got


def test_certified_pools_and_their_order(spark):
    rec = "id long, bucket string, evidence string, pos long"
    old = spark.createDataFrame([(1, "x", "e", 1), (2, "x", "e", 0), (3, "y", "e", 0), (4, "y", "f", 1), (5, "z", "e", 0), (6, "w", None, 0), (7, "v", "e", 0), (8, "u", "e", 0)], rec)
    new = spark.createDataFrame([(11, "x", "e", 5), (12, "x", "e", 4), (13, "y", "e", 0), (14, "y", "f", 1), (15, "z", "e", 0), (16, "z", "e", 0), (17, "w", None, 0), (18, "v", "e", 0), (19, "u", "e", 0)], rec)
    done, demoted = spark.createDataFrame([(7, 99)], "old_id long, new_id long"), spark.createDataFrame([(8,)], "old_id long")
    assert rows(modules.ordinal_pools(old, new, done, demoted), "old_id", "new_id") == [(1, 11), (2, 12)]  # y: two keys; z: counts; w: no key; v: matched; u: demoted


def test_pool_assignment_is_the_sequential_one(spark):
    import random

    rng = random.Random(4)
    olds, news = [(i, f"p{i % 3}") for i in range(30)], [(100 + i, f"p{i % 3}") for i in range(30)]
    scores = [(b, i, j, rng.randrange(1, 4)) for i, b in olds for j, c in news if b == c and rng.random() < 0.4]
    used, want = set(), []
    for s, i, j in sorted([(s, i, j) for _, i, j, s in scores] + [(0, i, j) for i, b in olds for j, c in news if b == c and not any(x[1:3] == (i, j) for x in scores)], key=lambda x: (-x[0], x[1], x[2])):
        if i not in used and j not in used:
            used |= {i, j}
            want.append((i, j, s))
    frame = lambda r: spark.createDataFrame(r, "id long, bucket string")
    got = modules.assign_pools(frame(olds), frame(news), spark.createDataFrame(scores, "bucket string, old_id long, new_id long, score long"))
    assert rows(got, "old_id", "new_id", "score") == sorted(want)


def test_family_moves_are_the_sequential_ones(spark):
    import random

    rng = random.Random(6)
    make = lambda: [(f"b{i % 3}", f"n{i // 3}", c) for i in range(18) for c in rng.sample(range(12), rng.randrange(1, 7))]
    fresh, prior = make(), [*make(), ("lone", "x", 1)]
    want = []
    for b in ("b0", "b1", "b2"):
        f, p = ({n: {c for x, m, c in rows_ if x == b and m == n} for x, n, _ in rows_ if x == b} for rows_ in (fresh, prior))
        able = sorted((-len(f[x] & p[y]), x, y) for x in f for y in p if len(f[x] & p[y]) >= 1 and len(f[x] & p[y]) > len(f[x] & p.get(x, set())))
        used_f, used_p = set(), set()
        for s, x, y in able:
            if x not in used_f and y not in used_p:
                used_f.add(x)
                used_p.add(y)
                if x != y:
                    want.append((b, x, y, -s))
    member = "bucket string, name string, context long"
    got = modules.family_moves(spark.createDataFrame([*fresh, ("lone", "y", 1)], member), spark.createDataFrame(prior, member))
    assert len(want) > 5 and rows(got, "bucket", "from_name", "to_name", "support") == sorted(want)


def test_reconcile_needs_two_witnesses_and_no_rival(spark):
    p = spark.createDataFrame([("a x\nb x\nc y\nd z", "a q\nb q\nc r\nd z")], "o string, n string")
    assert rows(modules.token_diff_votes(p, "o", "n", 2), "old_name", "new_name", "witnesses") == [("x", "q", 2)]


def test_distinct_requests_and_rate_windows(spark, tmp_path):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id * 20) AS ts, 'k' || (id % 3) AS key, 'e' AS event_type, 1.0 AS value FROM range(12)")
    df.write.parquet(str(tmp_path / "in"))
    seen = streams.run_to_table(streams.distinct_requests(streams.read_stream(spark, str(tmp_path / "in"), df.schema), "key"), spark, str(tmp_path / "out"), str(tmp_path / "state"))
    assert seen.count() == 3
    w = streams.run_to_table(streams.rate_windows(streams.read_stream(spark, str(tmp_path / "in"), df.schema), "1 minute", "0 seconds"), spark, str(tmp_path / "out2"), str(tmp_path / "state2"))
    assert {r["n"] for r in w.collect()} == {3}
