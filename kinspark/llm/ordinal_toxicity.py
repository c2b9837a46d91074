"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= k | x) = sigmoid(theta_k - w.x): one weight vector w serves all ordered
thresholds theta_1 < theta_2 < theta_3. Grade 0 is clean. Labelled toxic documents
get grade 1, 2 or 3 by how many distinct toxic terms (features far more frequent
in toxic than in clean labelled documents) they hold: up to 1, 2 to 3, more.

The model is fitted on at most ``max_labelled`` labelled documents, taken in the
order of a seeded hash of their id; every document is scored over its whole text.

Defined results: a null or empty text has no features and so the grade of the
intercepts alone; null ids are scored like others; labels with a null id or a null
flag are passed over; of repeated labels the highest flag counts, of documents that
share a labelled id the greatest text is learnt from; with no toxic or no clean label
nothing can be learnt and every document gets severity 0. Each row is scored on its
own, repeated ones alike, a very long text over all of it. A document is toxic when
P(grade >= 1) is above 0.5, not at it; of equally likely grades the lowest counts.
Other columns, whatever their names, are not read, and ``drop_toxic`` returns them as
they are; an empty table gives an empty result.

Bounds of the fit: ``max_labelled`` documents and ``max_features`` features, those with
the highest odds among features of enough support.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.llm.shared import map_arrow, release_memory, slices, text_buffers
from kinspark.llm.words import letter_spans, mix, word_hashes

GRADES = 4
_PREFIX_SALT = np.uint64(0x5851F42D4C957F2D)
_SIEVE_BITS = 22


@dataclass(frozen=True)
class OrdinalModel:
    features: np.ndarray  # sorted uint64 feature hashes
    weights: np.ndarray  # one for each feature
    thresholds: np.ndarray  # GRADES - 1, ascending

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. GRADES - 1, from the linear scores w.x."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - x[:, None], -60, 60)))


def document_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All feature occurrences of some texts: (text index, feature hash). Words, and the first five bytes of longer ones."""
    s, e, first = letter_spans(data, offsets)
    words = word_hashes(data, s, e)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    long = (e - s) > 5
    stems = mix(word_hashes(data, s[long], s[long] + 5) ^ _PREFIX_SALT)
    return np.concatenate([owner, owner[long]]), np.concatenate([words, stems])


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, distinct feature hashes, their counts) of each labelled document, for the fit."""
    for part in slices(batches, "text"):
        data, offsets = text_buffers(part.column("text"))
        owner, feats = document_features(data, offsets)
        order = np.lexsort((feats, owner))
        owner, feats = owner[order], feats[order]
        cut = np.searchsorted(owner, np.arange(len(offsets)))
        hashes, counts = [], []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            u, c = np.unique(feats[a:b], return_counts=True)
            hashes.append(u.tobytes())
            counts.append(np.minimum(c, 255).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([part.column("toxic").cast(pa.int32()), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())], ["toxic", "hashes", "counts"])


def _labelled(docs: DataFrame, labels: DataFrame, max_labelled: int, seed: int, id_col: str, text_col: str, flag: str) -> pa.Table:
    clean = labels.select(F.col(id_col).cast("long").alias("_label_id"), F.col(flag).cast("int").alias("toxic")).dropna()
    sample = clean.groupBy("_label_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64(F.lit(seed), "_label_id"), "_label_id").limit(max_labelled)
    texts = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).alias("text"))
    joined = texts.join(F.broadcast(sample), F.col("_doc") == F.col("_label_id")).groupBy("_label_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text"))
    return map_arrow(joined.select("toxic", "text"), _features_of, "toxic int, hashes binary, counts binary").toArrow()


def fit_ordinal(
    docs: DataFrame, labels: DataFrame, max_labelled: int = 6000, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", flag: str = "toxic", max_features: int = 4096
) -> OrdinalModel:
    """Fit on at most ``max_labelled`` labelled documents (the documented bound of the sample)."""
    table = _labelled(docs, labels, max_labelled, seed, id_col, text_col, flag)
    y = (table.column("toxic").to_numpy() > 0).astype(np.int64) if len(table) else np.zeros(0, np.int64)
    lists = [np.frombuffer(b, np.uint64) for b in table.column("hashes").to_pylist()]
    # Rows in an order of their own content: the fit does not depend on how Spark deals the tasks.
    order = np.lexsort(([int(v.sum(dtype=np.uint64)) for v in lists], y)) if len(y) else np.zeros(0, np.int64)
    counts = [np.frombuffer(b, np.uint8) for b in table.column("counts").to_pylist()]
    model = fit_rows(y[order], [lists[i] for i in order], [counts[i] for i in order], max_features)
    del table, lists, counts
    release_memory()
    return model


def fit_rows(y: np.ndarray, hashes: list[np.ndarray], counts: list[np.ndarray], max_features: int = 4096) -> OrdinalModel:
    """The model from binary labels and, for each document, its distinct feature hashes and their counts."""
    nothing = OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES - 1, 50.0))
    n_pos, n_neg = int((y == 1).sum()), int((y == 0).sum())
    if not n_pos or not n_neg:
        return nothing
    row = np.repeat(np.arange(len(y)), [len(h) for h in hashes])
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    vocabulary, at = np.unique(flat, return_inverse=True)
    pos = np.bincount(at[y[row] == 1], minlength=len(vocabulary))
    neg = np.bincount(at[y[row] == 0], minlength=len(vocabulary))
    odds = np.log((pos + 0.25) / (n_pos + 0.5)) - np.log((neg + 0.25) / (n_neg + 0.5))
    # Shares of equal size give a log-odds of 0 with a deviation of about sqrt(1/pos + 1/neg).
    strength = odds / np.sqrt(1 / (pos + 0.25) + 1 / (neg + 0.25))
    able = np.flatnonzero((pos >= 4) & (odds >= 2.5) & (strength >= 3.0))
    able = np.sort(able[np.lexsort((vocabulary[able], -strength[able]))][:max_features])
    if not len(able):
        return nothing
    place = np.full(len(vocabulary), -1)
    place[able] = np.arange(len(able))
    col = place[at]
    hit = col >= 0
    r, c = row[hit], col[hit]
    v = np.log2(1.0 + np.concatenate(counts)[hit].astype(np.float64))
    strong = odds[able] >= 3.0
    held = np.bincount(r[strong[c]], minlength=len(y))
    grade = np.where(y == 1, 1 + (held >= 2) + (held >= 4), 0)
    w, theta = _descend(grade, r, c, v, len(able))
    return OrdinalModel(vocabulary[able], w, theta)


def _descend(grade: np.ndarray, r: np.ndarray, c: np.ndarray, v: np.ndarray, m: int, rounds: int = 1500, rate: float = 0.1, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Adam with falling steps on the cumulative-link likelihood; thresholds are a first one and positive steps, which keeps their order."""
    n = len(grade)
    p = np.concatenate([np.zeros(m), [2.0], np.full(GRADES - 2, 1.0)])
    m1, m2 = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        w, steps = p[:m], np.logaddexp(0, p[m + 1 :])
        theta = p[m] + np.concatenate([[0.0], np.cumsum(steps)])
        x = np.bincount(r, weights=v * w[c], minlength=n)
        q = 1.0 / (1.0 + np.exp(np.clip(theta[None, :] - x[:, None], -60, 60)))  # P(grade >= k)
        # Probability of the observed grade: upper - lower cumulative ends.
        hi = np.concatenate([np.ones((n, 1)), q], axis=1)[np.arange(n), grade]
        lo = np.concatenate([q, np.zeros((n, 1))], axis=1)[np.arange(n), grade]
        like = np.maximum(hi - lo, 1e-12)
        slope = q * (1 - q)
        d_hi = np.concatenate([np.zeros((n, 1)), slope], axis=1)[np.arange(n), grade]
        d_lo = np.concatenate([slope, np.zeros((n, 1))], axis=1)[np.arange(n), grade]
        g_x = (d_hi - d_lo) / like
        g_theta = np.zeros(GRADES - 1)
        for k in range(GRADES - 1):
            g_theta[k] = -(np.where(grade == k + 1, d_hi, 0.0) - np.where(grade == k, d_lo, 0.0)).dot(1 / like)
        g = np.zeros_like(p)
        g[:m] = -np.bincount(c, weights=v * g_x[r], minlength=m) / n + ridge * w
        g[m] = -g_theta.sum() / n
        tails = np.cumsum(g_theta[::-1])[::-1][1:]
        g[m + 1 :] = -tails / n / (1 + np.exp(-p[m + 1 :]))
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        p = p - rate * (1 - t / (rounds + 1)) * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    steps = np.logaddexp(0, p[m + 1 :])
    return p[:m], p[m] + np.concatenate([[0.0], np.cumsum(steps)])


def _linear_scores(model: OrdinalModel, sieve: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    if not len(model.features):
        return np.zeros(n)
    owner, feats = document_features(data, offsets)
    near = sieve[(feats >> np.uint64(64 - _SIEVE_BITS)).astype(np.int64)]
    owner, feats = owner[near], feats[near]
    at = np.minimum(np.searchsorted(model.features, feats), len(model.features) - 1)
    real = model.features[at] == feats
    pairs, times = np.unique(owner[real] * len(model.features) + at[real], return_counts=True)
    weight = model.weights[pairs % len(model.features)] * np.log2(1.0 + np.minimum(times, 255))
    return np.bincount(pairs // len(model.features), weights=weight, minlength=n)


def score_severity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, severity, p_toxic, grade, toxic) for every row: the expected grade, P(grade >= 1), the likeliest grade, and p_toxic > 0.5."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = np.zeros(1 << _SIEVE_BITS, bool)
        sieve[(model.features >> np.uint64(64 - _SIEVE_BITS)).astype(np.int64)] = True
        for part in slices(batches, "text"):
            x = _linear_scores(model, sieve, *text_buffers(part.column("text")))
            q = model.probabilities(x)
            each = -np.diff(np.concatenate([np.ones((len(x), 1)), q, np.zeros((len(x), 1))], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(q.sum(1)), pa.array(q[:, 0]), pa.array(each.argmax(1).astype(np.int32)), pa.array(q[:, 0] > 0.5)],
                ["doc_id", "severity", "p_toxic", "grade", "toxic"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, kernel, "doc_id long, severity double, p_toxic double, grade int, toxic boolean")


def drop_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that the model does not reject; one pass, no join."""
    features, schema = model, docs.schema

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = np.zeros(1 << _SIEVE_BITS, bool)
        sieve[(features.features >> np.uint64(64 - _SIEVE_BITS)).astype(np.int64)] = True
        for part in slices(batches, text_col):
            x = _linear_scores(features, sieve, *text_buffers(part.column(text_col)))
            yield part.filter(pa.array(features.probabilities(x)[:, 0] <= 0.5))

    return map_arrow(docs, kernel, schema)
