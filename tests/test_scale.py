"""Joins don't make rows that their results don't need: frequent items, heads and stems."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinspark.operators import matching
from kinspark.operators import similarity_join as sim
from kinspark.plans import registry


def most_rows(df):
    """The result, and the most rows that any step of its plan gave."""
    got = [tuple(r) for r in df.collect()]
    seen, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if p.metrics().contains("numOutputRows"):
            seen = max(seen, p.metrics().apply("numOutputRows").value())
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        else:
            todo += [p.children().apply(i) for i in range(p.children().size())]
    return got, seen


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, stem string, items array<string>")


def crowd(base, n=300):
    """Records that all hold one line, beside two of their own."""
    return [(base + i, f"s{i}", ["all hold this", f"own {base + i}", f"more {base + i}"]) for i in range(n)]


def test_f8_a_frequent_item_does_not_pair_its_multisets(spark):
    a = [*crowd(0), (900, "x", ["p", "p", "q", "all hold this"]), (901, "y", ["p", "q"])]
    b = [*crowd(1000), (1900, "x", ["p", "p", "q"]), (1901, "y", ["p", "p", "all hold this"])]
    got, rows = most_rows(sim.multiset_join(frame(spark, a), frame(spark, b)))
    assert sorted((x, y, round(s, 6)) for x, y, s in got) == [(900, 1900, 0.75), (900, 1901, 0.75), (901, 1900, round(2 / 3, 6))]
    assert rows < 10_000  # 90,000 pairs share the frequent line


@pytest.mark.parametrize("floor", [1 / 3, 0.4, 0.5, 0.8])
def test_f8_multisets_equal_all_pairs(spark, floor):
    from collections import Counter

    rng = random.Random(3)
    make = lambda base: [(base + i, None, rng.choices("abcdefghijkl", weights=range(1, 13), k=rng.randrange(0, 9))) for i in range(80)]
    a, b = make(0), make(1000)
    want = []
    for i, _, x in a:
        for j, _, y in b:
            inter = (Counter(x) & Counter(y)).total()
            if inter and inter / (len(x) + len(y) - inter) >= floor:
                want.append((i, j))
    got = sim.multiset_join(frame(spark, a), frame(spark, b), floor).collect()
    assert len(want) > 20 and sorted((r.a_id, r.b_id) for r in got) == want


def test_f10_only_unique_stems_are_compared(spark):
    a, b = [*crowd(0), (900, "x", list("abcd"))], [*crowd(1000), (1900, "x", list("abc"))]
    got, rows = most_rows(sim.stem_join(frame(spark, a), frame(spark, b)))
    assert got == [(900, 1900, 0.75)] and rows < 10_000


def documents(tmp_path, texts):
    """A table of documents: twenty ids of one side, then twenty of the other."""
    d = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "lang": "en", "source": "s", "n_chars": [len(x) for x in texts]})
    d.to_parquet(tmp_path / "documents.parquet")
    return str(tmp_path)


def test_f7_heirs_are_found_without_pairing_a_frequent_line(spark, tmp_path):
    # Lengths differ by hundreds of characters, so no two documents are candidates, but all hold one line.
    texts = ["all of them hold this line\n" + f"{i:012d} only this one\n" * 1 + "x" * (100 * i) for i in range(400)]
    got, rows = most_rows(registry.queries()["heir_veto"](spark, documents(tmp_path, texts)))
    assert got == [] and rows < 10_000  # 40,000 pairs share the line


def test_f9_shared_words_are_counted_once_a_pair(spark, tmp_path):
    df = registry.queries()["set_similarities"](spark, documents(tmp_path, ["one two three", "four"] * 20))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("array_intersect") == 1
    assert "array_union" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_f2_greedy_within_heads_is_greedy_in_order(spark):
    rng = random.Random(7)
    pairs = [(o, 1000 + n, rng.choice([0.5, 0.6, 0.8, 1.0]), (o // 20)) for o in range(60) for n in range(60) if o // 20 == n // 20 and rng.random() < 0.5]
    df = spark.createDataFrame(pairs, "old_id long, new_id long, score double, head long")
    used, want = set(), []
    for n in sorted({p[1] for p in pairs}):
        best = min(((-s, o) for o, m, s, _ in pairs if m == n and o not in used), default=None)
        if best:
            used.add(best[1])
            want.append((best[1], n))
    for most in (10**6, 0):
        got = matching.greedy_within(df, "head", most).collect()
        assert sorted((r.old_id, r.new_id) for r in got) == sorted(want)


def test_f1_a_frequent_word_under_a_head_does_not_pair_its_records(spark):
    make = lambda base: spark.createDataFrame([(base + i, "h", ["every", f"w{base + i}", f"v{base + i}", f"u{base + i}"]) for i in range(300)], "id long, head string, words array<string>")
    old, new = make(0), make(1000)
    got, rows = most_rows(matching.edited_candidates(old, new.unionByName(old.where("id = 5").withColumn("id", F.lit(2000).cast("long")))))
    assert got == [(5, 2000, 1.0)] and rows < 10_000


def test_f3_weak_rivals_are_looked_up_for_able_records_only(spark, monkeypatch):
    from kinspark.operators import modules

    asked = []

    def spy(a, b, floor, items="items"):
        if items == "words":
            asked.append((round(floor, 2), sorted(r.id for r in b.select("id").collect())))
        return sim.similar_sets(a, b, floor, items)

    monkeypatch.setattr(modules, "similar_sets", spy)
    record = "id long, signature string, stem string, items array<string>, declared array<string>, words array<string>"
    make = lambda base: [(base + i, f"h{base + i}", None, [], [], ["shared", f"w{base + i}", f"v{base + i}"]) for i in range(20)]
    a = spark.createDataFrame([*make(0), (90, "x", None, [], [], list("pqrs"))], record)
    b = spark.createDataFrame([*make(100), (190, "y", None, [], [], list("pqrt"))], record)
    none = spark.createDataFrame([], "src long, dst long")
    got = modules.module_cascade(a, b, none, none).collect()
    assert [(r.a_id, r.b_id, r.tier) for r in got] == [(90, 190, "graded")]
    assert asked == [(0.5, [*range(100, 120), 190]), (0.33, [190])]


def in_order(pairs):
    """Pairs worked off as one list, best first; equal scores that share a free end abstain."""
    done_a, done_b, out = set(), set(), []
    for level in sorted({s for _, _, s in pairs}, reverse=True):
        free = [(a, b) for a, b, s in pairs if s == level and a not in done_a and b not in done_b]
        out += [(a, b) for a, b in free if sum(x == a for x, _ in free) == 1 and sum(y == b for _, y in free) == 1]
        done_a |= {a for a, _ in free}
        done_b |= {b for _, b in free}
    return sorted(out)


@pytest.mark.parametrize("last", [0, 60])
@pytest.mark.parametrize("levels", [5, 1000])
def test_f6_greedy_in_rounds_equals_one_list(spark, monkeypatch, last, levels):
    monkeypatch.setattr(sim, "_LAST", last)
    rng = random.Random(levels)
    pairs = [(a, b, rng.randrange(levels) / levels) for a in range(60) for b in rng.sample(range(60), 3)]
    pairs += [(100 + i // 2 + i % 2, 200 + i // 2, 2 + i / 100) for i in range(8)]  # a chain: each pair waits for the next
    df = spark.createDataFrame(pairs, "a_id long, b_id long, score double")
    assert sorted((r.a_id, r.b_id) for r in sim.greedy_assign(df).collect()) == in_order(pairs)


def test_f6_no_task_holds_a_component(spark, tmp_path, monkeypatch):
    """All documents compete in one component; the choice is made without labels of components and without a group of them."""
    monkeypatch.setattr(sim, "_LAST", 8)
    rng = random.Random(5)
    texts = ["".join(rng.choices("etaoinsrhldu", k=rng.randrange(30, 90))) for _ in range(240)]
    sf = documents(tmp_path, texts)
    top = [tuple(r) for r in registry.queries()["cosine_top3"](spark, sf).collect()]
    assert len(top) == 360
    seen = []
    monkeypatch.setattr("kinspark.operators.graph.connected_labels", lambda *a, **k: seen.append(a))
    got = registry.queries()["close_match"](spark, sf)
    assert not seen and "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
    from kinspark.plans.q_sets import _vectors

    exact = [tuple(r) for r in sim.cosine_top(*_vectors(spark, sf), 3, 0.8).collect()]
    assert sorted((r.a_id, r.b_id) for r in got.collect()) == in_order(exact)


def test_f6_nothing_to_assign(spark):
    none = spark.createDataFrame([], "a_id long, b_id long, score double")
    assert sim.greedy_assign(none).collect() == []
