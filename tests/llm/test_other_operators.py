"""Embeddings, conversations and the pipeline."""

import numpy as np
import pytest

import corpus_pipeline
from kinspark.llm import nn_descent, preference, tokens
from kinspark.llm.components import connected_components
from tests.conftest import TESTDATA
from tests.llm.common import awkward, components, documents

VECTORS = "vec_id long, embedding array<float>, label int, node long, key string"


def brute(rows, threshold=0.9):
    """(n_links, component) of each vector in double precision."""
    dim = 8
    unit = {}
    for i, v, *_ in rows:
        ok = v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(v)
        if ok:
            x = np.array(v, np.float32).astype(np.float64)
            unit[i] = x / np.linalg.norm(x)
    near = lambda a, b: bool(a in unit and b in unit and unit[a] @ unit[b] >= threshold)
    ids = [r[0] for r in rows]
    return {i: sum(near(i, j) for j in ids if j != i) for i in ids}, components(ids, near)


def vectors():
    rng = np.random.default_rng(7)
    rows = []
    centers = rng.standard_normal((12, 8))
    for i in range(300):  # clusters of all tightness, one large group that saturates lists
        c = centers[0] if i < 90 else centers[i % 12]
        rows.append((i, (c + rng.standard_normal(8) * (0.05 if i < 90 else 0.3)).astype(np.float32).tolist(), i % 3, 1, "k"))
    rows += [(400 + i, rows[200][1], 0, 1, "k") for i in range(30)]  # copies
    rows += [(500, None, 0, 1, "k"), (501, [], 0, 1, "k"), (502, [0.0] * 8, 0, 1, "k"), (503, [float("nan")] * 8, 0, 1, "k"), (504, [float("inf"), *[1.0] * 7], 0, 1, "k")]
    rows += [(505, [1.0, None, *[1.0] * 6], 0, 1, "k"), (506, [1.0, 2.0], 0, 1, "k"), (507, [1e-30] * 8, 0, 1, "k"), (508, [3e38] * 8, 0, 1, "k")]
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = vectors()
    links, parts = brute(rows)
    got = nn_descent.near_duplicates(spark.createDataFrame(rows, VECTORS), k=6).collect()
    assert len(got) == len(rows)
    found = sum(r["n_links"] for r in got)
    assert found >= 0.98 * sum(links.values())
    for r in got:
        assert r["n_links"] <= links[r["vec_id"]]
        assert r["kept"] == (r["vec_id"] == r["component_id"])
    assert sum(parts[r["vec_id"]] == r["component_id"] for r in got) >= 0.98 * len(rows)
    assert {r["vec_id"]: r["n_links"] for r in got}[507] >= 1  # tiny and huge vectors keep their direction


def test_near_duplicates_across_saturated_groups(spark):
    rng = np.random.default_rng(3)
    turn = np.arccos(0.93)
    rows = []
    for g, angle in enumerate((0.0, turn, 2 * turn)):  # each group fills its lists; the outer two link only through the middle one
        centre = np.array([np.cos(angle), np.sin(angle), 0, 0, 0, 0, 0, 0])
        rows += [(50 * g + i, (centre + 0.01 * rng.standard_normal(8)).tolist(), 0, 1, "k") for i in range(50)]
    links, parts = brute(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nn_descent.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    assert len(set(parts.values())) == 1 and min(links.values()) >= 90
    assert got == {i: (links[i], parts[i]) for i in links}


def test_near_duplicates_go_on_exactly(spark, monkeypatch):
    """Where no search reaches the recall, all rows are compared."""
    rows = vectors()[:120]
    links, parts = brute(rows)
    monkeypatch.setattr(nn_descent, "_audit", lambda *_: 0.0)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nn_descent.near_duplicates(spark.createDataFrame(rows, VECTORS), k=2, tables=1, max_rounds=0).collect()}
    assert got == {i: (links[i], parts[i]) for i in links}


def test_near_duplicates_edges(spark):
    assert nn_descent.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0], 0, 1, "k"), (1, [1.0, 0.0], 0, 1, "k"), (2, [1.0, 0.01], 0, 1, "k"), (None, [1.0, 0.0], 0, 1, "k")], VECTORS)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in nn_descent.near_duplicates(one).collect()), key=str)
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 0, None, True)]


def test_near_duplicates_of_every_length(spark):
    """Vectors of a rare length link with each other, never with those of another one."""
    rows = [(i, [1.0, 0.001 * i], 0, 1, "k") for i in range(4)] + [(10, [1.0, 0.0, 0.0], 0, 1, "k"), (11, [0.9, 0.0, 0.0], 0, 1, "k"), (12, [0.0, 0.0, 1.0], 0, 1, "k"), (20, None, 0, 1, "k"), (21, [], 0, 1, "k")]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nn_descent.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 10: (1, 10), 11: (1, 10), 12: (0, 12), 20: (0, 20), 21: (0, 21)}


def test_preferences_match_their_sql_in_groups(spark, tmp_path):
    """Openings shared by one to five conversations, with ties of weight."""
    import random

    import duckdb

    from kinspark.llm import queries
    from tests.oracle import compare

    rng, rows, n = random.Random(2), [], 0
    for opening in range(12):
        for _ in range(1 + opening % 5):
            rows += [(n, 0, "user", f"open {opening}"), *[(n, t, rng.choice(["assistant", "user"]), rng.choice(["a", "bb", "ccc"])) for t in range(1, 4)]]
            n += 1
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert compare(queries.op8_preferences(spark, str(tmp_path)), con, queries.oracle_sql()["op8_preferences"]) is None


def test_components_of_long_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 180)] + [(7, 1000 + i) for i in range(200)] + [(5, 5), (None, 3), (300, 301), (301, 300)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert {got[i] for i in range(100, 181)} == {100}
    assert {got[1000 + i] for i in range(200)} == {7} and got[301] == 300 and 5 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


TURNS = "conv_id long, turn long, role string, text string, turns long, weight long"


def test_preferences(spark):
    rows = [
        (1, 0, "system", "S"), (1, 1, "user", "Q"), (1, 2, "assistant", "long answer"), (2, 0, "system", "S"), (2, 1, "user", "Q"), (2, 2, "assistant", "short"), (2, 3, "user", "more"),
        (3, 0, "user", "alone"), (4, 0, None, None), (4, None, "user", "last"), (4, 1, "assistant", "é"), (None, 0, "user", "lost"),
        (5, 0, "user", "same"), (5, 1, "assistant", "x"), (6, 0, "user", "same"), (6, 1, "assistant", "x"),
    ]
    turns = spark.createDataFrame([(*r, 1, 2) for r in rows], TURNS)
    convs = preference.conversations(turns)
    got = {r["chosen_id"]: r for r in preference.format_preferences(convs, preference.pair_by_first_turn(convs)).collect()}
    assert set(got) == {1, 3, 4, 5}
    r = got[1]
    assert (r["rejected_id"], r["prefix_turns"]) == (2, 2)
    assert r["prompt"] == "<|system|>\nS<|end|>\n<|user|>\nQ<|end|>\n"
    assert r["chosen"] == "<|assistant|>\nlong answer<|end|>\n" and r["chosen_mask"] == f"0:14,1:{11 + 8}"
    assert r["rejected"].endswith("<|user|>\nmore<|end|>\n") and r["rejected_mask"] == f"0:14,1:{5 + 8},0:{len('<|user|>') + 1 + 4 + 8}"
    for text, mask in ((r["chosen"], r["chosen_mask"]), (r["rejected"], r["rejected_mask"])):
        assert sum(int(x.split(":")[1]) for x in mask.split(",")) == len(text)
    assert got[3]["rejected_id"] is None and got[3]["chosen"] == ""
    assert got[4]["prompt"] == "<||>\n<|end|>\n<|assistant|>\né<|end|>\n<|user|>\nlast<|end|>\n"  # a turn without number comes last
    assert (got[5]["rejected_id"], got[5]["chosen"], got[5]["rejected"]) == (6, "", "")
    none = preference.conversations(spark.createDataFrame([], TURNS))
    assert preference.format_preferences(none, preference.pair_by_first_turn(none)).count() == 0


def test_large_openings_are_dealt_into_sets(spark):
    turns = spark.createDataFrame([(i, 0, "user", "hot", 1, 1) for i in range(100)], TURNS)
    pairs = preference.pair_by_first_turn(preference.conversations(turns), set_size=16).collect()
    assert sorted({i for r in pairs for i in (r["chosen_id"], r["rejected_id"])}) == list(range(100))


def test_group_size_does_not_change_pairs(spark):
    """One odd id among even ones has a partner, whatever a task holds; so have ids of one residue."""
    ids = sorted([*range(0, 66, 2), 7])
    turns = spark.createDataFrame([(i, 0, "user", "hot", 1, 1) for i in ids] + [(200 + i, 0, "user", f"o{i // 3}", 1, 1) for i in range(9)], TURNS)
    convs = preference.conversations(turns)
    want = {(a, b) for a, b in zip(ids[::2], ids[1::2], strict=True)} | {p for i in (200, 203, 206) for p in ((i, i + 1), (i + 2, None))}
    for size in (4, 1024):
        assert {(r["chosen_id"], r["rejected_id"]) for r in preference.pair_by_first_turn(convs, set_size=size).collect()} == want


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, 0, 1), (3, 0, 1), (12, 0, 1), (13, 1, 0)], "doc_id long, toxic int, quality int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.mark.parametrize("rows", [None, []])
def test_stages_take_awkward_and_empty_tables(spark, folder, rows):
    docs = documents(spark, rows, clashing=True)
    names = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names
            docs = spark.createDataFrame(out.collect(), docs.schema)
            assert docs.count() > 0 or rows == []
        else:
            assert out.count() > 0 or rows == []


def test_stage_decisions_and_kept_columns(spark, folder):
    docs = documents(spark)
    kept = {name: stage(spark, docs, folder) for name, stage in corpus_pipeline.STAGES[:3]}
    ids = {n: {r["doc_id"] for r in df.collect()} for n, df in kept.items()}
    everything = {r[0] for r in awkward()}
    assert everything - ids["exact_dedup"] == {1, 4, 7}
    assert {2, 3, 8, 10} & ids["ngram_jaccard_join"] == set() and {1, 7, 9, 11, 12} <= ids["ngram_jaccard_join"]


def test_pipeline_accounts_for_every_token(spark):
    out = corpus_pipeline.run(spark, f"{TESTDATA}/sf0.001")
    rows = out.collect()
    assert rows and all(r["length"] > 0 and r["offset"] + r["length"] <= 1024 for r in rows)
    total = {}
    for r in rows:
        total[r["sequence_id"]] = total.get(r["sequence_id"], 0) + r["length"]
    assert all(n == 1024 or n & (n - 1) == 0 for n in total.values())
    whole = {}
    for r in rows:
        whole[r["doc_id"]] = whole.get(r["doc_id"], 0) + r["length"]
    size = {r["doc_id"]: r["doc_tokens"] for r in rows}
    assert all(whole[i] % size[i] == 0 for i in whole)  # whole copies only
    assert tokens.default_path("byte_bpe_50k.json")
