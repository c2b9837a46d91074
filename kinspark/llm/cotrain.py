"""Quality by co-training: a text-content view and a page-metadata view teach each other.

Text view: which words and pairs of words a document holds (hashed counts), how often word forms
occur (case, trailing marks, repetition of the word before) and a few shares (distinct words, word
length). Metadata view: source, language, length, lines. Both are logistic regressions. They start
from labelled documents; in each round either view gives the other its most confident pseudo-labels,
of a calibrated probability of ``sure_from`` or more, among all unlabelled documents: every round scores the whole table, and each task hands on only the
ends of its own ranking. Each view is then calibrated (a logistic map of its score) on labelled
documents kept out of the fit, and the calibrated views are added in log-odds, weighted by how well
they did there.

The fit uses at most ``max_labelled`` labelled documents, the first in the order of a seeded hash of
their id (a documented bound), and ``per_round`` pseudo-labels a view and round; of rows that share an
id the one with the least text stands for it. Every document is scored over its whole text.

Defined results: a null text counts as empty, a very long one is read whole; null source, language and
length are values of their own; labels with null id or flag are passed over, of repeated labels the
lowest flag counts; without both classes among the labels every document gets 0.5 and is kept, as is
any document with a score of exactly 0.5; equal scores are ranked by id; rows are scored one by one,
repeated ones alike; other columns, whatever their names, are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.llm.shared import map_arrow, scratch, slices, small, stored, text_buffers
from kinspark.llm.words import mix, word_hashes, word_spans

FORMS = 1024
WORDS = 1024
_SHARES = 5
_SOURCES, _LANGS, _LAYOUT = 64, 16, 5
TEXT_WIDTH, META_WIDTH = FORMS + _SHARES + 2 * WORDS, _SOURCES + _LANGS + _LAYOUT
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
_MARK = np.array([b < 128 and not chr(b).isalnum() and b > 32 for b in range(256)])


def text_view(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of TEXT_WIDTH features a text."""
    n = len(offsets) - 1
    s, e, first = word_spans(data, offsets)
    out = np.zeros((n, TEXT_WIDTH), np.float32)
    if not len(s):
        return out
    owner = np.repeat(np.arange(n), np.diff(first))
    words = word_hashes(data, s, e)
    last = data[e - 1]
    tail = np.where(_MARK[last], last, 0).astype(np.int64)
    for back in (2, 3):  # up to three marks at the end
        more = (e - s >= back) & (tail >= 256 ** (back - 2)) & _MARK[data[np.maximum(e - back, 0)]]
        tail = np.where(more, tail + data[np.maximum(e - back, 0)].astype(np.int64) * 256 ** (back - 1), tail)
    second = _UPPER[data[np.minimum(s + 1, len(data) - 1)]] & (e - s > 1)
    case = np.where(_UPPER[data[s]], np.where(second, 2, 1), np.where(_LETTER[data[s]], 0, 3))
    again = np.zeros(len(s), np.int64)
    again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    form = (mix((tail * 8 + case * 2 + again).astype(np.uint64)) % np.uint64(FORMS)).astype(np.int64)
    total = np.maximum(np.diff(first), 1)
    counts = np.bincount(owner * FORMS + form, minlength=n * FORMS).reshape(n, FORMS)
    out[:, :FORMS] = np.sqrt(counts / total[:, None])
    order = np.lexsort((words, owner))
    new = np.ones(len(s), bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    out[:, FORMS] = np.bincount(owner[order][new], minlength=n) / np.sqrt(total)
    out[:, FORMS + 1] = np.bincount(owner[order][new], minlength=n) / total
    out[:, FORMS + 2] = np.bincount(owner, weights=e - s, minlength=n) / total / 10
    out[:, FORMS + 3] = np.bincount(owner, weights=again, minlength=n) / total
    out[:, FORMS + 4] = np.log1p(np.diff(first)) / 10
    pairs = mix(words[:-1] * np.uint64(3) + words[1:])[owner[1:] == owner[:-1]]
    at = FORMS + _SHARES
    for hashes, whose in ((words, owner), (pairs, owner[1:][owner[1:] == owner[:-1]])):
        slot = (hashes >> np.uint64(20)).astype(np.int64) % WORDS
        out[:, at : at + WORDS] = np.sqrt(np.bincount(whose * WORDS + slot, minlength=n * WORDS).reshape(n, WORDS) / total[:, None])
        at += WORDS
    return out


def metadata_view(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of META_WIDTH features a document."""
    n = part.num_rows
    out = np.zeros((n, META_WIDTH), np.float32)
    for column, width, at in (("source", _SOURCES, 0), ("lang", _LANGS, _SOURCES)):
        slot = [zlib.crc32(("" if v is None else f"={v}").encode()) % width for v in part.column(column).to_pylist()]
        out[np.arange(n), at + np.array(slot, np.int64)] = 1
    size = np.diff(offsets)
    feeds = np.concatenate([[0], np.cumsum(data == 10)])
    lines = feeds[offsets[1:]] - feeds[offsets[:-1]] + 1
    declared = part.column("n_chars").fill_null(-1).to_numpy(zero_copy_only=False)
    base = _SOURCES + _LANGS
    out[:, base] = np.log1p(np.maximum(declared, 0)) / 10
    out[:, base + 1] = declared < 0
    out[:, base + 2] = np.log1p(lines) / 5
    out[:, base + 3] = np.log1p(size / lines) / 5
    out[:, base + 4] = lines <= 1
    return out


@dataclass(frozen=True)
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.bias


@dataclass(frozen=True)
class CoTrained:
    text: Logistic
    meta: Logistic
    maps: tuple[tuple[float, float], tuple[float, float]]  # slope and offset that calibrate each view's score
    shares: tuple[float, float]
    bias: float  # log-odds of the classes, counted once though both views hold it

    def probabilities(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = (m * v.score(x) + c for v, x, (m, c) in zip((self.text, self.meta), (text, meta), self.maps, strict=True))
        return _sigmoid(self.shares[0] * (a - self.bias) + self.shares[1] * (b - self.bias) + self.bias), _sigmoid(a), _sigmoid(b)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 250) -> Logistic:
    """Logistic regression with standardised features and balanced classes, by accelerated gradient steps."""
    mean, scale = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64)
    scale = np.where(scale > 1e-6, scale, 1.0)
    z = ((x - mean.astype(np.float32)) / scale.astype(np.float32)).astype(np.float32)
    share = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    share = share.astype(np.float32)
    y = y.astype(np.float32)
    rough = np.random.Generator(np.random.PCG64(5)).standard_normal(z.shape[1]).astype(np.float32)
    for _ in range(8):  # largest curvature
        rough = z.T @ (share * (z @ (rough / np.linalg.norm(rough))))
    step = 1.0 / (0.25 * np.linalg.norm(rough) + 0.25 + ridge)
    w = v = np.zeros(z.shape[1] + 1, np.float32)
    for t in range(rounds):
        p = _sigmoid(z @ v[:-1] + v[-1])
        g = np.append(z.T @ (share * (p - y)) + np.float32(ridge) * v[:-1], (share * (p - y)).sum())
        new = (v - np.float32(step) * g).astype(np.float32)
        v = new + np.float32(t / (t + 3)) * (new - w)
        w = new
    return Logistic(mean, scale, w[:-1].astype(np.float64), float(w[-1]))


def _calibrate(score: np.ndarray, y: np.ndarray) -> tuple[tuple[float, float], float]:
    """Slope and offset of a logistic map from score to class, by Newton steps, and the log loss under it."""
    m, c = 1.0, 0.0
    for _ in range(30):
        p = _sigmoid(m * score + c)
        d, h = p - y, np.maximum(p * (1 - p), 1e-6)
        a = np.array([[(h * score * score).sum() + 1e-2, (h * score).sum()], [(h * score).sum(), h.sum() + 1e-2]])
        step = np.linalg.solve(a, [(d * score).sum() + 1e-2 * (m - 1), d.sum() + 1e-2 * c])
        m, c = m - float(np.clip(step[0], -1, 1)), c - float(np.clip(step[1], -1, 1))
    m = max(m, 0.0)
    p = np.clip(_sigmoid(m * score + c), 1e-6, 1 - 1e-6)
    return (m, c), float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


#: What a view learns: ids with both views of the document and its pseudo-label.
Teacher = Callable[[list[Logistic], list[tuple[float, float]], list[set[int]]], list[dict[int, tuple[np.ndarray, np.ndarray, int]]]]


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, teach: Teacher | None, rounds: int = 3) -> CoTrained | None:
    """Both views from labelled rows. ``teach`` gives, for the models of a round and the ids each view knows, what either view learns from the other: id to (text, meta, label). Every fourth labelled row is kept for calibration."""
    held = np.arange(len(y)) % 4 == 3
    fit = ~held
    if len(np.unique(y[fit])) < 2 or len(np.unique(y[held])) < 2:
        return None
    learnt: list[dict[int, tuple[np.ndarray, np.ndarray, int]]] = [{}, {}]
    models: list[Logistic] = []
    for r in range(rounds + 1):
        models = []
        for v, own in enumerate((text, meta)):
            more = [learnt[v][i] for i in sorted(learnt[v])]
            x = np.concatenate([own[fit], *([np.stack([m[v] for m in more])] if more else [])])
            models.append(fit_logistic(x, np.concatenate([y[fit], [m[2] for m in more]])))
        if r == rounds or teach is None:
            break
        maps = [_calibrate(m.score(own[held]), y[held])[0] for m, own in zip(models, (text, meta), strict=True)]
        for mine, new in zip(learnt, teach(models, maps, [set(x) for x in learnt]), strict=True):
            mine.update(new)
    fits = [_calibrate(m.score(own[held]), y[held]) for m, own in zip(models, (text, meta), strict=True)]
    base = float(y[held].mean())
    none = -(base * np.log(base) + (1 - base) * np.log(1 - base))
    gain = np.array([max(none - loss, 0.0) for _, loss in fits])
    shares = gain / gain.max() if gain.max() > 0 else np.array([1.0, 0.0])
    return CoTrained(models[0], models[1], (fits[0][0], fits[1][0]), (float(shares[0]), float(shares[1])), float(np.log(base / (1 - base))))


def _inputs(docs: DataFrame) -> DataFrame:
    """The columns the views read; those that a table lacks are null."""
    have = {c.lower() for c in docs.columns}
    kinds = {"doc_id": "long", "text": "string", "source": "string", "lang": "string", "n_chars": "long"}
    return docs.select(*[(F.col(c).cast(t) if c in have else F.lit(None).cast(t)).alias(c) for c, t in kinds.items()])


def _view_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", 1 << 20):
        data, offsets = text_buffers(part.column("text"))
        a, b = text_view(data, offsets), metadata_view(part, data, offsets)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("_order"), part.column("label"), pa.array([r.tobytes() for r in a], pa.binary()), pa.array([r.tobytes() for r in b], pa.binary())], ["doc_id", "_order", "label", "a", "b"]
        )


def _views_of(rows: DataFrame, sample: DataFrame) -> pa.Table:
    """(doc_id, _order, label, a, b) of the documents of a bounded ``sample`` (doc_id, _order, label), one row for each id, in order."""
    row = F.min(F.struct("text", "source", "lang", "n_chars")).alias("_row")
    chosen = rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "_order", "label").agg(row).select("doc_id", "_order", "label", "_row.*")
    table = map_arrow(chosen, _view_rows, "doc_id long, _order long, label int, a binary, b binary").toArrow()
    return table.sort_by([("_order", "ascending"), ("doc_id", "ascending")])


def _matrices(table: pa.Table) -> list[np.ndarray]:
    return [np.stack([np.frombuffer(v, np.float32) for v in table.column(c).to_pylist()]) for c in ("a", "b")]


def _ends(models: list[Logistic], maps: list[tuple[float, float]], known: list[set[int]], most: int, sure_from: float):
    """Of each task's documents those that either view is surest of: (view, up, score, doc_id), ``most`` of each kind that the other view does not know, with a calibrated probability of at least ``sure_from``."""
    floor = float(np.log(sure_from / (1 - sure_from)))
    gone = [np.array(sorted(k), np.int64) for k in known]

    def best(held: tuple[np.ndarray, np.ndarray], score: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score, ids = np.concatenate([held[0], score]), np.concatenate([held[1], ids])
        keep = np.lexsort((ids, -score))[:most]
        return score[keep], ids[keep]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {(v, up): (np.zeros(0), np.zeros(0, np.int64)) for v in (0, 1) for up in (0, 1)}
        for part in slices(batches, "text", 1 << 20):
            data, offsets = text_buffers(part.column("text"))
            ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for v, x in enumerate((text_view(data, offsets), metadata_view(part, data, offsets))):
                score = maps[v][0] * models[v].score(x) + maps[v][1]
                fresh = ~np.isin(ids, gone[1 - v])
                for up, mine in ((1, score), (0, -score)):
                    sure = fresh & (mine >= floor)
                    held[v, up] = best(held[v, up], mine[sure], ids[sure])
        for (v, up), (score, ids) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), v, np.int32)), pa.array(np.full(len(ids), up, np.int32)), pa.array(score), pa.array(ids)], ["view", "up", "score", "doc_id"])

    return kernel, "view int, up int, score double, doc_id long"


def fit_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = 4000, per_round: int = 100, rounds: int = 3, sure_from: float = 0.95, seed: int = 23, flag: str = "quality") -> CoTrained | None:
    order = F.xxhash64(F.lit(seed), "doc_id")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(flag).cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.min("label").alias("label"))
    rows = _inputs(docs)
    table = _views_of(rows, marks.withColumn("_order", order).orderBy("_order", "doc_id").limit(max_labelled))
    if not table.num_rows:
        return None
    y = (table.column("label").to_numpy() > 0).astype(np.float64)
    pool = rows.where("doc_id is not null").join(small(marks.select("doc_id")), "doc_id", "left_anti")
    up = max(1, round(per_round * float(y.mean())))
    quota = {1: up, 0: max(1, per_round - up)}

    def teach(models: list[Logistic], maps: list[tuple[float, float]], known: list[set[int]]) -> list[dict[int, tuple[np.ndarray, np.ndarray, int]]]:
        kernel, schema = _ends(models, maps, known, per_round, sure_from)
        given: list[dict[int, int]] = [{}, {}]
        with scratch(docs.sparkSession):
            ends = stored(map_arrow(pool, kernel, schema), "quality_ends")
            for v in (0, 1):
                for sign, n in quota.items():
                    sure = ends.where((F.col("view") == v) & (F.col("up") == sign)).groupBy("doc_id").agg(F.max("score").alias("score"))
                    for r in sure.orderBy(F.desc("score"), "doc_id").limit(n).collect():
                        given[1 - v].setdefault(r["doc_id"], sign)
        ids = sorted({i for g in given for i in g})
        if not ids:
            return [{}, {}]
        sample = docs.sparkSession.createDataFrame([(i, 0, 0) for i in ids], "doc_id long, _order long, label int")
        found = _views_of(rows, sample)
        a, b = _matrices(found)
        at = {i: n for n, i in enumerate(found.column("doc_id").to_pylist())}
        return [{i: (a[at[i]], b[at[i]], label) for i, label in g.items()} for g in given]

    a, b = _matrices(table)
    return co_train(a, b, y, teach if rounds else None, rounds)


def score_quality(docs: DataFrame, model: CoTrained | None) -> DataFrame:
    """(doc_id, p_quality, p_text, p_meta, kept) of every row."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            data, offsets = text_buffers(part.column("text"))
            half = np.full(part.num_rows, 0.5)
            p = model.probabilities(text_view(data, offsets), metadata_view(part, data, offsets)) if model else (half, half, half)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, p), pa.array(p[0] >= 0.5)], ["doc_id", "p_quality", "p_text", "p_meta", "kept"])

    return map_arrow(_inputs(docs), kernel, "doc_id long, p_quality double, p_text double, p_meta double, kept boolean")
