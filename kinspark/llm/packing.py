"""Packing by deficit round-robin over source queues.

Every source is a queue of its documents' ids. Serving runs in rounds of one window
each: after round r a source has been served floor(r * share * window / grain) whole
grains of its tokens, so what a round could not serve (its deficit) is carried into
the next ones, across windows and partitions. That count is a closed form of r:
where any id lies in the packed stream follows from its place in its queue alone, and
each task places its own documents without waiting for another one.

The stream is cut into sequences of ``window`` ids. What is left at the end becomes
sequences of the powers of two it is the sum of, so that nothing is padded.

With target weights, sources that run out leave their share to the others: the run
falls into phases between such moments, each with constant shares.

Defined results: a null or empty text is just its end id; rows that repeat, or share
an id, are packed one by one; a null source is a queue of its own; null ids are
allowed; a very long text is cut into as many pieces as it takes; other columns, whatever their names, are
not read; an empty table gives an empty result. One row per queue is held by the driver
and by each task (``max_sources`` bounds them).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinspark.llm import tokens
from kinspark.llm.shared import map_arrow, slices, stored

MAX_SOURCES = 100_000
#: Offsets (one for each write task and source) up to this many are broadcast, about 40 MB; more are joined by a shuffle.
BROADCAST_OFFSETS = 500_000


@dataclass(frozen=True)
class Phase:
    """A stretch with constant shares: queue s gives ``amount[s]`` ids after ``served[s]`` earlier ones, in ``rounds`` rounds from stream position ``base``."""

    served: np.ndarray
    amount: np.ndarray
    rounds: int
    base: int


def phases(sizes: np.ndarray, weights: np.ndarray | None, window: int) -> list[Phase]:
    """Stretches between the moments at which a queue runs out. Without weights queues share by size and run out together."""
    share = sizes.astype(np.float64) if weights is None else np.where(sizes > 0, weights, 0.0)
    served = np.zeros(len(sizes), np.int64)
    out: list[Phase] = []
    base = 0
    while (served < sizes).any():
        left = sizes - served
        live = left > 0
        rate = np.where(live, np.maximum(share, 1e-12), 0.0)
        time = (left[live] / rate[live]).min()
        ends = live & (left <= rate * time * (1 + 1e-9) + 0.5)
        amount = np.where(ends, left, np.minimum(left, np.floor(rate * time).astype(np.int64)))
        if weights is None:
            amount = left
        total = int(amount.sum())
        limit = window << 31  # keeps round * amount within 64 bits
        parts = -(-total // limit)
        for p in range(parts):
            piece = amount * (p + 1) // parts - amount * p // parts
            n = int(piece.sum())
            out.append(Phase(served.copy(), piece, max(1, -(-n // window)), base))
            served = served + piece
            base += n
    return out


def _served(phase: Phase, s: np.ndarray, r: np.ndarray, grain: int) -> np.ndarray:
    """Ids of queue s served in the first r rounds of a phase: whole grains, and everything at the end."""
    amount = phase.amount[s]
    q, rest = amount // phase.rounds, amount % phase.rounds
    so_far = r * q + r * rest // phase.rounds
    return np.where(r >= phase.rounds, amount, so_far // grain * grain)


def _round_of(phase: Phase, s: np.ndarray, k: np.ndarray, grain: int) -> np.ndarray:
    """The round (from 0) that serves the k-th id of queue s: the last r with served(r) <= k."""
    lo, hi = np.zeros(len(k), np.int64), np.full(len(k), phase.rounds - 1, np.int64)
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        below = _served(phase, s, mid, grain) <= k
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid - 1)
    return lo


def _round_starts(phase: Phase, s: np.ndarray, r: np.ndarray, grain: int) -> np.ndarray:
    """Stream position at which round r serves queue s: all rounds before, and the queues before s in this one."""
    out = np.empty(len(r), np.int64)
    every = np.arange(len(phase.amount))
    rounds, at = np.unique(r, return_inverse=True)
    step = max(1, (1 << 20) // max(1, len(every)))
    for lo in range(0, len(rounds), step):
        some = rounds[lo : lo + step]
        before = _served(phase, every[None, :], some[:, None], grain)
        after = _served(phase, every[None, :], some[:, None] + 1, grain)
        first = np.zeros((len(some), len(every) + 1), np.int64)
        np.cumsum(after - before, axis=1, out=first[:, 1:])
        first += before.sum(axis=1)[:, None]
        mine = (at >= lo) & (at < lo + len(some))
        out[mine] = first[at[mine] - lo, s[mine]]
    return phase.base + out


def place_ranges(plan: list[Phase], s: np.ndarray, start: np.ndarray, length: np.ndarray, grain: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut ranges [start, start + length) of queues s where a round ends: (range, offset in it, length, stream position) of each piece."""
    out: list[tuple[np.ndarray, ...]] = []
    for phase in plan:
        lo = np.maximum(start, phase.served[s]) - phase.served[s]
        hi = np.minimum(start + length, phase.served[s] + phase.amount[s]) - phase.served[s]
        which = np.flatnonzero(hi > lo)
        if not len(which):
            continue
        q, lo, hi = s[which], lo[which], hi[which]
        a, b = _round_of(phase, q, lo, grain), _round_of(phase, q, hi - 1, grain)
        n = b - a + 1
        row = np.repeat(np.arange(len(which)), n)
        r = a[row] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        sr = q[row]
        opens = _served(phase, sr, r, grain)
        x = np.maximum(opens, lo[row])
        y = np.minimum(_served(phase, sr, r + 1, grain), hi[row])
        full = y > x
        row, r, sr, x, y, opens = (v[full] for v in (row, r, sr, x, y, opens))
        at = _round_starts(phase, sr, r, grain) + x - opens
        w = which[row]
        out.append((w, x + phase.served[sr] - start[w], y - x, at))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def cut_at_sequences(at: np.ndarray, length: np.ndarray, total: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut stream ranges where a sequence ends: (range, offset in it, length, sequence, offset in the sequence)."""
    whole = total // window
    tail = [1 << i for i in range(window.bit_length() - 1, -1, -1) if (total - whole * window) >> i & 1]
    tail_starts = whole * window + np.concatenate([[0], np.cumsum(tail)]).astype(np.int64)

    def sequence(p: np.ndarray) -> np.ndarray:
        return np.where(p < whole * window, p // window, whole + np.searchsorted(tail_starts, p, side="right") - 1)

    def begin(q: np.ndarray) -> np.ndarray:
        return np.where(q < whole, q * window, tail_starts[np.clip(q - whole, 0, len(tail_starts) - 1)])

    a, b = sequence(at), sequence(at + length - 1)
    n = b - a + 1
    row = np.repeat(np.arange(len(at)), n)
    q = a[row] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    x, y = np.maximum(at[row], begin(q)), np.minimum(at[row] + length[row], begin(q + 1))
    return row, x - at[row], y - x, q, x - begin(q)


def _encode(path: str, end_id: int):
    """(doc_id, source, part, before, ids): each document's ids, and how many of its source came before it in this task."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        part_id = TaskContext.get().partitionId()
        seen: dict[str | None, int] = {}
        for part in slices(batches, "text", tokens.SLICE_BYTES):
            ids, at = enc.encode(part.column("text"))
            n = part.num_rows
            full = np.full(len(ids) + n, end_id, np.uint32)
            full[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(at))] = ids
            ends = at + np.arange(n + 1)
            before = np.empty(n, np.int64)
            for i, (source, k) in enumerate(zip(part.column("source").to_pylist(), np.diff(ends).tolist(), strict=True)):
                before[i] = seen.get(source, 0)
                seen[source] = int(before[i]) + k
            wide = full.astype(np.uint16 if len(full) == 0 or int(full.max()) < 65536 else np.uint32)
            blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends * wide.itemsize), pa.py_buffer(wide)]).cast(pa.binary())
            cols = [part.column("doc_id"), part.column("source"), pa.array(np.full(n, part_id, np.int32)), pa.array(before), pa.array(np.diff(ends)), pa.array(np.full(n, wide.itemsize, np.int32)), blob]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "source", "part", "before", "doc_tokens", "width", "ids"])

    return kernel, "doc_id long, source string, part int, before long, doc_tokens long, width int, ids binary"


def _pieces(plan: list[Phase], total: int, window: int, grain: int):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "ids"):
            size = part.column("doc_tokens").to_numpy().astype(np.int64)
            queue = part.column("queue").to_numpy().astype(np.int64)
            width = part.column("width").to_numpy()
            raw = part.column("ids").to_pylist()
            row, off, length, at = place_ranges(plan, queue, part.column("start").to_numpy().astype(np.int64), size, grain)
            piece, more, length, sequence, offset = cut_at_sequences(at, length, total, window)
            row, off = row[piece], off[piece] + more
            crc = np.empty(len(row), np.int64)
            order = np.lexsort((off, row))
            now = -1
            wide = b""
            for i, r, o, n in zip(order.tolist(), row[order].tolist(), off[order].tolist(), length[order].tolist(), strict=True):
                if r != now:
                    now = r
                    wide = memoryview(np.frombuffer(raw[r], np.uint16 if width[r] == 2 else np.uint32).astype("<u4").tobytes())
                crc[i] = zlib.crc32(wide[4 * o : 4 * (o + n)])
            ids = part.column("doc_id").take(pa.array(row))
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (off, length, crc, size[row], sequence, offset))], names)

    return kernel, ", ".join(f"{n} long" for n in names)


def pack(
    docs: DataFrame, tokenizer_path: str, window: int = 1024, end_id: int = 0, grain: int = 256, weights: dict[str | None, float] | None = None, max_sources: int = MAX_SOURCES,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    ``weights`` are target shares by source (others weigh 1); without them every window follows the
    corpus's own proportions and all queues end together.
    """
    kernel, schema = _encode(tokenizer_path, end_id)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    coded = stored(map_arrow(texts, kernel, schema), "pack_ids", compression="zstd")
    parts = stored(coded.groupBy("source", "part").agg(F.sum("doc_tokens").alias("n")), "pack_parts")
    queues = parts.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.col("source").asc_nulls_last()).limit(max_sources + 1).collect()
    if len(queues) > max_sources:
        raise ValueError(f"more than {max_sources} sources; raise max_sources or map sources to groups")
    sizes = np.array([q["n"] for q in queues], np.int64)
    wanted = None if weights is None else np.array([float(weights.get(q["source"], 1.0)) for q in queues])
    plan = phases(sizes, wanted, window)
    spark = docs.sparkSession
    names = spark.createDataFrame([(q["source"], i) for i, q in enumerate(queues)], "_source string, queue long")
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("first", F.coalesce(F.sum("n").over(ahead), F.lit(0))).join(names, F.col("source").eqNullSafe(F.col("_source")))
    offsets = offsets.select(F.col("part").alias("_part"), "_source", "queue", "first")
    if parts.limit(BROADCAST_OFFSETS + 1).count() <= BROADCAST_OFFSETS:  # then the ids themselves are not shuffled
        offsets = F.broadcast(offsets)
    placed = coded.join(offsets, (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source")))
    placed = placed.select("doc_id", "queue", (F.col("first") + F.col("before")).alias("start"), "doc_tokens", "width", "ids")
    kernel, schema = _pieces(plan, int(sizes.sum()), window, grain)
    return map_arrow(placed, kernel, schema)
