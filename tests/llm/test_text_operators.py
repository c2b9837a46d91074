"""Operators over documents: awkward rows, empty tables, repeated rows, clashing names; results against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from kinspark.llm import cotrain, exact_dedup, mixing, ngram_join, ordinal_toxicity, packing, pii, queries, range_coder, token_files, tokens
from kinspark.llm.shared import text_buffers, working_path
from tests.conftest import TESTDATA
from tests.llm.common import awkward, components, documents, shingles, words
from tests.oracle import compare, connect

SF = f"{TESTDATA}/sf0.001"
BYTES, WORDS = tokens.default_path("byte_bpe_50k.json"), tokens.default_path("word_bpe_49k.json")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_sql(spark, name):
    assert compare(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name]) is None


# exact dedup


@pytest.mark.parametrize("digest_all", [True, False])
def test_exact_groups(spark, digest_all):
    rows = [*awkward(), (2, awkward()[1][1], "en", "a", 1)]  # id 2 repeats with equal text
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[fold(r[1])].append(r[0])
    got = exact_dedup.group_copies(documents(spark, rows, clashing=True), digest_all=digest_all).collect()
    assert len(got) == len(rows)
    assert sum(r["kept"] for r in got) == len(groups)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for text, ids in groups.items():
        real = [i for i in ids if i is not None]
        for i in real:
            assert by_id[i]["keep_id"] == max(real)
            assert by_id[i]["group_size"] == len(ids)
            if digest_all:
                assert by_id[i]["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_exact_drop_keeps_one_of_each(spark):
    rows = [*awkward(), (2, awkward()[1][1], "en", "a", 1)]
    docs = documents(spark, rows, clashing=True)
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    texts = Counter(fold(r["text"]) for r in got.collect())
    assert set(texts) == {fold(r[1]) for r in rows} and set(texts.values()) == {1}
    plain = documents(spark, [r for r in awkward() if r[0] is not None])
    assert sorted(r["doc_id"] for r in exact_dedup.drop_copies(plain).collect()) == [2, 3, 5, 6, 8, 9, 10, 11, 12, 13]


# n-gram join


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_ngram_components(spark, k, num):
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(80)]
    rows = awkward()
    for i in range(100, 190):  # a group of near copies with edits of all sizes, some across the threshold
        w = list(base)
        for j in rng.choice(80, rng.integers(0, 6), replace=False):
            w[j] = f"e{i}_{j}"
        rows.append((i, " ".join(w), "en", "z", 1))
    sets = {r[0]: shingles(r[1], k) for r in rows if r[0] is not None}

    def linked(a, b):
        x, y = sets[a], sets[b]
        inter = len(x & y)
        return bool(x and y) and 100 * inter >= num * (len(x) + len(y) - inter)

    want = components(sets, linked)
    got = ngram_join.ngram_components(documents(spark, rows, clashing=True), k, num, 100).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert r["component_id"] == want[r["doc_id"]]
            assert r["n_shingles"] == len(sets[r["doc_id"]])


def test_ngram_frequent_grams_and_small_windows(spark, monkeypatch):
    """With all thresholds small, frequent n-grams, salts and the last fragment are in play; the result is the same."""
    monkeypatch.setattr(ngram_join, "_LEAST_FREQUENT", 4)
    rng = np.random.default_rng(5)
    common = [f"c{i}" for i in range(30)]
    rows = []
    for i in range(120):
        own = [f"o{i % 40}_{j}" for j in range(40)]
        for j in rng.choice(40, rng.integers(0, 4), replace=False):
            own[j] = f"x{i}_{j}"
        rows.append((i, " ".join(common + own), "en", "s", 1))
    sets = {r[0]: shingles(r[1], 4) for r in rows}
    link = lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(documents(spark, rows), 4, 85, 100).collect()}
    assert got == components(sets, link)


def test_ngram_hot_bucket_of_several_components(spark, monkeypatch):
    """Thousands of rows of several components meet in the buckets of a few n-grams, which are cut into blocks."""
    monkeypatch.setattr(ngram_join, "_HOT", 300)
    rng = np.random.default_rng(9)
    rows, n = [], 3000
    for i in range(n):
        kind = int(rng.integers(0, 6))
        w = [f"c{j}" for j in range(24)] + [f"k{kind}_{j}" for j in range(3 + kind)]  # kinds share most of their n-grams
        if rng.random() < 0.4:
            w[int(rng.integers(0, len(w)))] = f"e{int(rng.integers(0, 400))}"
        rows.append((i, " ".join(w), "en", "s", 1))
    sets = [shingles(r[1], 4) for r in rows]
    place = {g: j for j, g in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((n, len(place)), np.float32)
    for i, s in enumerate(sets):
        m[i, [place[g] for g in s]] = 1
    inter, size = m @ m.T, m.sum(1)
    near = 100 * inter >= 85 * (size[:, None] + size[None, :] - inter)
    least = np.arange(n)
    while True:
        now = np.where(near, least[None, :], n).min(1)
        if (now == least).all():
            break
        least = now
    assert len(set(least.tolist())) > 3
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(documents(spark, rows), 4, 85, 100).collect()}
    assert [got[i] for i in range(n)] == least.tolist()


def test_ngram_repeated_ids(spark):
    rows = [(1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (2, "A b c d e f", "en", "s", 1)]
    got = ngram_join.ngram_components(documents(spark, rows), 4, 85, 100).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (2, 1)]
    kept = ngram_join.keep_representatives(documents(spark, rows, clashing=True), 4, 85, 100)
    assert {r["doc_id"] for r in kept.collect()} == {1}


# mixing


def _targets(sizes, weights=(1, 2, 3), cap=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed, out = sum(sizes.values()), {}, {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        out = {**fixed, **{s: rest * weight[s] / sum(weight[x] for x in free) for s in free}}
        over = [s for s in free if out[s] > cap * sizes[s] + 1e-9]
        if not over:
            return out
        fixed |= {s: cap * sizes[s] for s in over}


def test_mix_reaches_targets(spark):
    rng = np.random.default_rng(1)
    rows = [*awkward(), *[(1000 + i, " ".join(["w"] * int(rng.integers(1, 40))), "en", f"s{i % 5}", 1) for i in range(400)]]
    docs = documents(spark, rows, clashing=True)
    got = mixing.mix_to_targets(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = _targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    for s in ("s0", "s1", "s2", "s3", "s4"):
        assert abs(taken[s] - want[s]) <= 1
    again = mixing.mix_to_targets(docs.repartition(3)).collect()
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    rows_out = mixing.take_mix(docs)
    assert rows_out.columns == docs.columns
    times = Counter(r["doc_id"] for r in rows_out.select("doc_id").collect())
    assert all(times[r["doc_id"]] == r["copies"] for r in got if r["size"] and r["doc_id"] is not None)
    assert rows_out.where("doc_id = 4").count() == 1  # without words: stays once


def test_few_long_documents_fit_exactly():
    lengths, counts = np.array([69_000, 71_000, 100_000]), np.array([1, 1, 1])
    assert mixing.fit_counts(lengths, counts, 140_000).tolist() == [1, 1, 0]
    rng = np.random.default_rng(2)
    for _ in range(50):
        lengths, counts = rng.choice(np.arange(70_000, 300_000), 4, replace=False), np.ones(4, np.int64)
        budget = int(rng.integers(1, lengths.sum()))
        best = max(s for m in range(16) if (s := sum(int(lengths[b]) for b in range(4) if m >> b & 1)) <= budget)
        assert int((mixing.fit_counts(lengths, counts, budget) * lengths).sum()) == best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 5)), min_size=1, max_size=8, unique_by=lambda x: x[0]), st.integers(0, 400))
def test_knapsack_is_the_best_sum(items, budget):
    lengths, counts = (np.array(x, np.int64) for x in zip(*items, strict=True))
    picks = mixing.fit_counts(lengths, counts, budget)
    assert (picks >= 0).all() and (picks <= counts).all() and (picks * lengths).sum() <= max(budget, 0)
    found = mixing.bounded_knapsack(lengths, counts, budget, np.argsort(-lengths))
    reach = {0}
    for n, c in items:
        reach = {s + n * j for s in reach for j in range(c + 1) if s + n * j <= budget}
    assert sum(int(lengths[i]) * k for i, k in found.items()) == max(reach)
    assert all(k <= counts[i] for i, k in found.items())


# packing and token files


@pytest.mark.parametrize("weights", [None, {"a": 4.0, "b": 0.5}])
def test_pack_places_every_id_once(spark, weights):
    rows = [*awkward(), *[(100 + i, f"text number {i} " * (i % 9), "en", f"s{i % 3}", 1) for i in range(60)], (1, "repeated id", "en", "a", 1)]
    got = packing.pack(documents(spark, rows, clashing=True), BYTES, window=64, weights=weights).collect()
    from tokenizers import Tokenizer

    enc = Tokenizer.from_file(BYTES)
    want = Counter()
    for r in rows:
        ids = np.array([*enc.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want[(r[0], len(ids), zlib.crc32(ids.tobytes()))] += 1
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in seqs.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at and n > 0
            at += n
        assert at == 64 or at & (at - 1) == 0
    assert sum(r["length"] for r in got) == sum(n * c for (_, n, _), c in want.items())
    single = {k: v for k, v in want.items() if sum(c for (i, *_), c in want.items() if i == k[0]) == 1}
    for (doc, n, crc), _ in single.items():
        mine = sorted((r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == doc)
        assert [m[0] for m in mine] == [0, *np.cumsum([m[1] for m in mine]).tolist()[:-1]] and sum(m[1] for m in mine) == n
        if len(mine) == 1:
            assert mine[0][2] == crc


def test_pack_windows_follow_target_shares(spark):
    rows = [(i, "x y z " * 40, "en", f"s{i % 2}", 1) for i in range(60)]
    got = packing.pack(documents(spark, rows), BYTES, window=256, grain=16, weights={"s0": 3.0, "s1": 1.0}).collect()
    share = defaultdict(Counter)
    for r in got:
        share[r["sequence_id"]][r["doc_id"] % 2] += r["length"]
    for s in range(4, 16):
        assert abs(share[s][0] - 192) <= 48


def test_token_files_round_trip(spark):
    rows = awkward()
    path = working_path(spark, "tokens")
    token_files.write_token_files(documents(spark, rows, clashing=True), path, WORDS, end_id=2, container_ids=500)
    got = token_files.document_index(token_files.read_token_files(spark, path)).collect()
    from tokenizers import Tokenizer

    enc = Tokenizer.from_file(WORDS)
    at, want = 0, []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*enc.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted([tuple(r) for r in got], key=lambda r: r[1]) == want


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 49_407), max_size=600), st.sampled_from([256, 4096]))
def test_range_coder_round_trip(ids, block):
    x = np.array(ids, np.uint32)
    assert (range_coder.decode(range_coder.encode(x, block)) == x).all()


def test_range_coder_compresses_and_detects_damage():
    rng = np.random.default_rng(2)
    x = np.tile(rng.integers(0, 49_000, 50), 400).astype(np.uint32)
    coded = range_coder.encode(x)
    assert len(coded) < x.nbytes / 8 and (range_coder.decode(coded) == x).all()
    for at in [*range(60), *range(60, len(coded), max(1, len(coded) // 200)), len(coded) - 1]:  # head, model, index, blocks
        broken = bytearray(coded)
        broken[at] ^= 1 << at % 8
        with pytest.raises(ValueError, match="damaged"):
            range_coder.decode(bytes(broken))
    for cut in (0, 10, 40, len(coded) - 2):
        with pytest.raises(ValueError, match="damaged|short"):
            range_coder.decode(coded[:cut])


def test_range_coder_learns_contexts():
    """Ids that depend on the one before cost far less than their order-0 entropy; blocks of new symbols still come back."""
    rng = np.random.default_rng(3)
    follows = rng.integers(0, 3000, (3000, 4))
    x = np.zeros(200_000, np.uint32)
    picks = rng.integers(0, 4, len(x))
    for i in range(1, len(x)):
        x[i] = follows[x[i - 1], picks[i]]
    coded = range_coder.encode(x)
    shares = np.bincount(x)[np.unique(x)] / len(x)
    order0 = -(shares * np.log2(shares)).sum()
    assert (range_coder.decode(coded) == x).all()
    assert len(coded) * 8 / len(x) < min(4.0, 0.5 * order0)
    many = rng.permutation(60_000).astype(np.uint32)  # no id occurs twice
    assert (range_coder.decode(range_coder.encode(many)) == many).all()


def test_range_coder_mixes_only_for_candidates_that_were_right_before(monkeypatch):
    """Most ids of a text have no such candidate: the mix, the dearest part of a position, is worked out for few blocks."""
    rng = np.random.default_rng(5)
    x = np.minimum(rng.zipf(1.3, 60_000), 3000).astype(np.uint32)
    x[30_000:40_000] = np.tile(x[:50], 200)
    plain, mixed = range_coder._Adaptive.predict, []

    def predict(self, *last):
        out = plain(self, *last)
        mixed.append(len(out[0]))
        return out

    monkeypatch.setattr(range_coder._Adaptive, "predict", predict)
    coded = range_coder.encode(x)
    assert 5_000 < sum(mixed) < len(x) // 2
    assert (range_coder.decode(coded) == x).all()


def test_range_coder_with_separate_entries(monkeypatch):
    """Containers of more symbols than fit into packed entries hold the same bytes and come back."""
    x = np.random.default_rng(6).zipf(1.2, 20_000).clip(max=400).astype(np.uint32)
    packed = range_coder.encode(x)
    monkeypatch.setattr(range_coder, "_PACKED", 4)
    assert range_coder.encode(x) == packed and (range_coder.decode(packed) == x).all()


def test_token_files_remember_chunks_that_come_back():
    """200,000 different words are split once; with room for fewer they were forgotten and split anew."""
    words = pa.array(["".join(chr(97 + w // 26**i % 26) for i in range(4)) for w in range(200_000)])
    enc = tokens.encoder(WORDS, token_files.KNOWN_CHUNKS)
    first, learnt, learn = [], [], enc._learn
    try:
        for _ in range(2):
            enc._learn = lambda chunks: (learnt.append(len(chunks)), learn(chunks))
            first.append([enc.encode(words.slice(i, 20_000))[0].tolist() for i in range(0, len(words), 20_000)])
    finally:
        del enc._learn
    assert sum(learnt) <= 200_000 and first[0] == first[1]


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(alphabet=st.sampled_from(list("ab Zé×÷ß\n\t.,'’s<|>endoftxt$%09 　́ Σς\x1c")), max_size=60))
def test_chunks_give_the_tokenizers_ids(text):
    import pyarrow as pa
    from tokenizers import Tokenizer

    for path in (BYTES, WORDS):
        ids, at = tokens.encoder(path).encode(pa.array([text, None, text]))
        want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids if path not in _FULL else _FULL[path].encode(text, add_special_tokens=False).ids
        assert ids[at[0] : at[1]].tolist() == want and at[1] == at[2] and ids[at[2] : at[3]].tolist() == want


def _full():
    from tokenizers import Tokenizer

    return {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}


_FULL = _full()


# personal data


def brute_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("a0125 @.-+()é%_\n")), max_size=80))
def test_base_spans_equal_patterns(text):
    got = [s for s in pii.find_spans(text, _AUTOMATON) if s[1] < 4]
    assert got == brute_spans(text)


_AUTOMATON = pii.build_automaton()


def test_personal_query_and_masking(spark):
    card = "4111 1111 1111 1111"
    text = f"É mail a.b@c.org, call +49 (30) 1234567 or {card}; host 10.0.0.1 see https://u@ex.com/a?b=1. IBAN: DE89370400440532013000 ssn 123-45-6789"
    rows = [(1, text, "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (1, text, "en", "s", 1)]
    got = pii.personal_spans(documents(spark, rows, clashing=True)).collect()
    assert len(got) == 4
    kinds = [s["kind"] for s in got[0]["spans"]]
    assert Counter(kinds) == Counter({"email": 2, "phone": 1, "card": 1, "ip": 1, "url": 1, "account": 2}) - Counter()
    masked = [r["text"] for r in pii.mask_personal(documents(spark, rows)).collect()]
    assert masked[1] is None and masked[2] == "" and card not in masked[0] and "DE89" not in masked[0] and masked[0].startswith("É mail <EMAIL>, call <PHONE>")


def test_personal_query_digest(spark):
    r = {x["doc_id"]: x for x in queries.op6_personal_data(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    for d in docs:
        base = brute_spans(d["text"] or "")
        want = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r[d["doc_id"]]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert r[d["doc_id"]]["n_ip"] == sum(k == 1 for _, k, _ in base)


# classifiers


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{TESTDATA}/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    model = ordinal_toxicity.fit_ordinal(docs, labels.where("doc_id % 2 = 0"))
    assert (np.diff(model.thresholds) > 0).all()
    held = ordinal_toxicity.score_severity(docs, model).join(labels.where("doc_id % 2 = 1").withColumnRenamed("toxic", "label"), "doc_id")
    got = held.selectExpr("avg(cast(toxic = (label = 1) as int)) acc", "avg(case when label = 0 then cast(toxic as int) end) false_alarm", "corr(severity, label) c").first()
    assert got["acc"] > 0.97 and got["false_alarm"] < 0.005 and got["c"] > 0.6


def test_toxicity_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 0), (3, 0), (13, 1), (13, 0), (None, 1), (12, None)], "doc_id long, toxic int")
    docs = documents(spark, clashing=True)
    model = ordinal_toxicity.fit_ordinal(docs, labels)
    assert ordinal_toxicity.score_severity(docs, model).count() == 15
    assert ordinal_toxicity.drop_toxic(docs, model).columns == docs.columns
    none = ordinal_toxicity.fit_ordinal(docs, labels.limit(0))
    assert ordinal_toxicity.score_severity(docs, none).where("severity > 1e-6").count() == 0
    assert ordinal_toxicity.drop_toxic(docs, none).count() == 15


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{TESTDATA}/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    model = cotrain.fit_quality(docs, labels.where("doc_id % 2 = 0"))
    held = cotrain.score_quality(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id")
    got = held.selectExpr("avg(cast(kept = (quality = 1) as int)) acc", "avg(case when quality = 1 then cast(kept as int) end) keeps").first()
    assert got["acc"] > 0.95 and got["keeps"] > 0.97


def test_quality_gains_from_the_exchange(spark):
    """From few labels, the views that teach each other over all unlabelled documents do better than the labels alone."""
    docs, labels = (spark.read.parquet(f"{TESTDATA}/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    few, rest = labels.where("doc_id % 40 = 0"), labels.where("doc_id % 40 <> 0")

    def loss(rounds):
        held = cotrain.score_quality(docs, cotrain.fit_quality(docs, few, rounds=rounds)).join(rest, "doc_id")
        p = "least(greatest(p_quality, 1e-6), 1 - 1e-6)"
        return held.selectExpr(f"avg(case when quality = 1 then -ln({p}) else -ln(1 - {p}) end)").first()[0]

    assert loss(3) < loss(0)


def test_quality_text_view_knows_words():
    """Equal forms, other words: the view of the text tells them apart."""
    view = lambda t: cotrain.text_view(*text_buffers(pa.array([t])))[0]
    one, two = view("alpha beta gamma"), view("delta omega theta")
    plain = cotrain.FORMS + cotrain._SHARES
    assert (one[: cotrain.FORMS] == two[: cotrain.FORMS]).all() and (one[plain:] != two[plain:]).any()
    swapped = view("beta alpha gamma")
    assert (one[plain : plain + cotrain.WORDS] == swapped[plain : plain + cotrain.WORDS]).all() and (one[plain + cotrain.WORDS :] != swapped[plain + cotrain.WORDS :]).any()


def test_classifier_samples_are_bounded_by_rows(spark):
    rows = [(7, f"word {i} text", "en", "a", 10) for i in range(50)] + [(i, "other words here", "en", "b", 10) for i in range(20, 40)]
    marks = spark.createDataFrame([(7, 1, 1), *[(i, i % 2, i % 2) for i in range(20, 40)]], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows)
    assert ordinal_toxicity._labelled(docs, marks, 100, 1, "doc_id", "text", "toxic").num_rows == 21
    sample = marks.selectExpr("doc_id", "doc_id as _order", "quality as label")
    assert cotrain._views_of(cotrain._inputs(docs), sample).num_rows == 21


def test_quality_awkward_rows(spark):
    docs = documents(spark, clashing=True)
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (9, None)], "doc_id long, quality int")
    assert cotrain.score_quality(docs, cotrain.fit_quality(docs, labels)).count() == 15
    assert cotrain.score_quality(docs.drop("lang", "n_chars"), None).where("p_quality = 0.5 and kept").count() == 15


# empty tables


def test_empty_tables(spark):
    none = documents(spark, [], clashing=True)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert exact_dedup.group_copies(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0
    assert ngram_join.ngram_components(none).count() == 0 and ngram_join.keep_representatives(none).count() == 0
    assert mixing.mix_to_targets(none).count() == 0 and mixing.take_mix(none).count() == 0
    assert packing.pack(none, BYTES).count() == 0
    assert pii.personal_spans(none).count() == 0
    assert ordinal_toxicity.score_severity(none, ordinal_toxicity.fit_ordinal(none, labels)).count() == 0
    assert cotrain.score_quality(none, cotrain.fit_quality(none, labels)).count() == 0
    path = working_path(spark, "tokens")
    token_files.write_token_files(none, path, WORDS)
    assert token_files.document_index(token_files.read_token_files(spark, path)).count() == 0


def test_ngram_pairs_leave_their_first_common_bucket_only():
    """Families of similar sets share many prefix n-grams: no pair is lost, and few leave more than one bucket."""
    ng, num, den = ngram_join, 80, 100
    rng = np.random.default_rng(7)
    sets = []
    for _ in range(12):
        base = rng.integers(-(2**63), 2**63, 150)
        for _ in range(9):
            sets.append(np.unique(np.concatenate([rng.permutation(base)[: rng.integers(110, 150)], rng.integers(-(2**63), 2**63, rng.integers(0, 12))])))
    prefix = [s[: len(s) + (-len(s) * num) // den + 1] for s in sets]
    owners = {}
    for doc, grams in enumerate(prefix):
        for g in grams.tolist():
            owners.setdefault(g, []).append(doc)
    shared = [[(p, g) for p, g in enumerate(grams.tolist()) if len(owners[g]) > 1] for grams in prefix]
    rows = []
    for doc, own in enumerate(shared):
        for i, (pos, gram) in enumerate(own):
            earlier = [own[i - 1 - x][1] if x < i else 0 for x in range(ng._BEFORE)]
            rows.append((gram, 0, 0, doc, len(sets[doc]), pos, doc, -1, ng._coarse_counts(sets[doc]), min(i, ng._BEFORE), *earlier))
    rows.sort(key=lambda r: (r[0], r[4], r[3]))
    names = ["gram", "cell", "block", "doc", "n", "pos", "component", "hub", "coarse", "known", *(f"before{x}" for x in range(ng._BEFORE))]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], names)
    got = [(a, b) for out in ng._across(num, den)[0](iter([batch])) for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True)]
    want, meetings = set(), 0
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            n1, n2 = len(sets[a]), len(sets[b])
            inter = -((-num * (n1 + n2)) // (num + den))
            x, y = ({g: p for p, g in shared[d]} for d in (a, b))
            met = [min(n1 - x[g], n2 - y[g]) >= inter for g in x.keys() & y.keys()]
            most = np.minimum(*(np.frombuffer(ng._coarse_counts(sets[d]), np.uint8) for d in (a, b))).sum()
            if any(met) and min(n1, n2) * den >= max(n1, n2) * num and most >= inter:
                want.add((a, b))
                meetings += sum(met)
    assert set(got) == want and len(want) > 100
    assert meetings > 5 * len(want) and len(got) < 1.5 * len(want)


def test_ngram_short_buckets_are_compared_together(monkeypatch):
    """Thousands of buckets of a few rows give a few batches of pairs, not one each; longer buckets and any batch size give the same pairs."""
    ng, num, den = ngram_join, 85, 100
    rng = np.random.default_rng(11)
    names = ["gram", "cell", "block", "doc", "n", "pos", "component", "hub", "coarse", "known", *(f"before{x}" for x in range(ng._BEFORE))]
    sizes = rng.integers(80, 110, 400)
    coarse = rng.integers(0, 6, (400, ng._COARSE)).astype(np.uint8)
    rows = []
    for gram in range(3000):
        cell, many = (1 << 32 | 2, 8) if gram % 10 == 0 else (0, 150) if gram % 500 == 1 else (0, int(rng.integers(2, 6)))
        docs = rng.choice(400, many, replace=False).tolist()
        own = sorted((int(sizes[d]), d, int(rng.integers(0, 12)), int(rng.integers(0, 3)), rng.integers(0, 9, ng._BEFORE).tolist()) for d in docs)
        rows += [(gram, cell, 1 + d % 2, d, n, pos, d // 2, docs[0], coarse[d].tobytes(), known, *before) for n, d, pos, known, before in own]
    want = []
    for at in range(len(rows)):
        for to in range(at + 1, len(rows)):
            x, y = rows[at], rows[to]
            if x[:2] != y[:2]:
                break
            need = -((-num * (x[4] + y[4])) // (num + den))
            apart = x[6] != y[6] and x[7] != y[3] and y[7] != x[3] and (not x[1] or x[2] != y[2])
            able = x[4] * den >= y[4] * num and min(x[4] - x[5], y[4] - y[5]) >= need and np.minimum(coarse[x[3]], coarse[y[3]]).sum() >= need
            if apart and able and not set(x[10 : 10 + x[9]]) & set(y[10 : 10 + y[9]]):
                want.append((*sorted((x[3], y[3])), *(int(sizes[d]) for d in sorted((x[3], y[3])))))
    table = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], names)

    def run(step):
        return list(ng._across(num, den)[0](table.slice(x, step) for x in range(0, len(rows), step)))

    def pairs(found):
        return sorted(tuple(r.values()) for out in found for r in out.to_pylist())

    found = run(1000)
    assert len(want) > 1000 and pairs(found) == sorted(want)
    assert len(found) < 50
    monkeypatch.setattr(ng, "_TOGETHER", 60)
    monkeypatch.setattr(ng, "_FEW", 4)
    assert pairs(run(7)) == sorted(want)
