"""Adaptive context-mixing range coder for token ids, many blocks in step.

A container holds a run of ids cut into blocks of equal length (2048, longer where ids are many-valued). Each block starts from the same
state, has its own checksum and is decoded without the others. Coding goes through all blocks of a
container at once, position by position, so that each numpy call works on one id of every block.

One position: the ids that followed the last two (order 2) and the last one (order 1) earlier in the
block give a candidate. Where one has been right in its context before, whether it is right again is one
binary decision, whose probability mixes in the logistic domain an adaptive rate by the two confidences,
an adaptive rate by recent hits and the candidate's order-1 share, with weights that learn from each
outcome. All other ids are coded with the order-1 shares of the last id, or, after an escape, with order-0
counts, which grow with what the block has held (in up to ``_EPOCHS`` steps). Tables, rates, weights and counts are those of the block alone and
start anew in each; the shares they start from stand once in the container's head: the order-0 counts
and the frequent order-1 pairs. All arithmetic is on integers, so that both sides agree on any machine.

Layout, little-endian: b"KSRC", version u8, three bytes 0, block length u32, ids u64, blocks u32, bytes
of the model u32, CRC-32 of the model and index u32, CRC-32 of all these fields u32; the model (zlib:
distinct ids, count of each, pairs of each, second id and count of each pair; counts as 8 log2 in a
byte); for each block its words u32 and the CRC-32 of its bytes u32; then the blocks' words, u16 each.
Damage anywhere raises ValueError.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Callable

import numpy as np

_HEAD = struct.Struct("<4sB3xIQIII")
_MAGIC, _VERSION = b"KSRC", 3
#: Ids of a block; slots of each of its two tables of candidates; times at which its order-0 counts grow.
BLOCK = 2048
_SLOTS = 256
_EPOCHS = 2
#: Pairs that occur so often in a container stand in its head; of one first id this many at most, or only more frequent ones do.
_LEAST_PAIRS, _MOST_FOLLOWERS = 6, 1 << 14
#: Order-0 counts of all blocks together (64 MB, or 128 where blocks are many); with more distinct ids blocks get longer and fewer.
_ZERO_CELLS = 1 << 24
#: What one id of the block adds to its order-0 count, whose start sums to about 2^16.
_GAIN = 32
_LIST_BITS = 16
#: Up to so many symbols an entry of the order-1 shares is one number.
_PACKED = 1 << 22
_DENSE = 1 << 24
_ONE32, _LOW48 = 1 << 32, (1 << 48) - 1


def _logistic_tables() -> tuple[np.ndarray, np.ndarray]:
    """squash: -2048..2047 in 1/256 to 12-bit probabilities, built by integer steps of a fixed series; stretch: its inverse on 4096 values."""
    one = 1 << 40
    # e^(1/256) in fixed point, then powers by multiplication: no floating point is involved.
    term, e = one, one
    for i in range(1, 12):
        term = term // (256 * i)
        e += term
    powers = [one]
    for _ in range(2048):
        powers.append(powers[-1] * e // one)
    squash = [4096 * p // (p + one) for p in powers]
    squash = [4096 - squash[-x] if x < 0 else squash[x] for x in range(-2048, 2048)]
    squash = np.clip(np.array(squash, np.int32), 1, 4095)
    stretch = np.clip(np.searchsorted(squash, np.arange(4096)) - 2048, -2047, 2047).astype(np.int32)
    return squash, stretch


_SQUASH, _STRETCH = _logistic_tables()


def _first_rates() -> np.ndarray:
    rates = np.zeros(256, np.int32)
    for k2 in range(16):
        for k1 in range(16):
            rates[k2 * 16 + k1] = (65535 * k2) // (k2 + 2) if k2 else (65535 * k1) // (k1 + 5) if k1 else 300
    return np.maximum(rates, 300)


_RATES = _first_rates()


def _at(table: np.ndarray, index: np.ndarray) -> np.ndarray:
    return table.take(index, mode="clip")  # indexes beyond the ends saturate; within them this is the fast mode


def _hashed(k: int) -> np.ndarray:
    """For each symbol (and the one that stands for a block's start) its order-1 slot and its parts in order-2 slots as last and as last but one, 9 bits each."""
    mixed = np.arange(k + 1, dtype=np.int64) * 0x9E3779B1
    return (mixed >> 15 & _SLOTS - 1) | (mixed >> 18 & _SLOTS - 1) << 9 | (mixed >> 11 & _SLOTS - 1) << 18


class _Adaptive:
    """The state of all blocks at one position: contexts, candidates, the mixed probabilities and their update.

    A slot holds a symbol, its order-1 share and how sure it is: symbol << 12 | share << 4 | confidence. The order-1 slots of all blocks
    come first, then the order-2 slots.
    """

    def __init__(self, lanes: int, start: int):
        self.base = np.arange(lanes, dtype=np.int64) * _SLOTS
        self.base2 = self.base + lanes * _SLOTS
        self.slots = np.zeros(2 * lanes * _SLOTS, np.int32 if start < 1 << 19 else np.int64)
        self.kind = self.slots.dtype
        self.hashed = _hashed(start)
        # Of each block the rates by confidences, then those by recent hits; the first weight of all blocks, then the second and the third.
        self.rates = np.tile(np.concatenate([_RATES, np.full(32, 16384, np.int32)]), lanes)
        self.weights = np.repeat(np.array([36000, 12000, 24000], np.int32), lanes)
        self.each = np.arange(3, dtype=np.int64)[:, None] * lanes
        self.before = np.zeros(lanes, np.int64)
        self.recent = np.zeros(lanes, np.int64)
        self.at, self.other = np.empty((2, lanes), np.int64), np.empty(lanes, np.int64)
        self.steps = 0

    def predict(self, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The blocks whose candidate has been right before, the slots of these candidates and the 12-bit probabilities that they are right."""
        h, at, other = _at(self.hashed, last), self.at, self.other
        np.bitwise_and(h, _SLOTS - 1, out=at[0])
        at[0] += self.base
        np.right_shift(h, 9, out=other)
        other ^= self.before
        other &= _SLOTS - 1
        np.add(other, self.base2, out=at[1])
        np.right_shift(h, 18, out=self.before)
        self.s = s = _at(self.slots, at)
        self.k = k = s & 15
        lane = self.lane = np.flatnonzero((k[0] | k[1]) > 1)
        s1, s2 = _at(s[0], lane), _at(s[1], lane)
        k1, k2 = s1 & 15, s2 & 15
        best = np.where(k2 > 1, s2, s1)
        of = np.empty((2, len(lane)), np.int64)
        np.add(k2 << 4, k1, out=of[0])
        np.add(_at(self.recent, lane) * 2 + 256, (s1 ^ s2) < 4096, out=of[1])
        of += lane * 288
        self.of, self.r = of, _at(self.rates, of)
        inputs = np.empty((3, len(lane)), np.int64)
        np.right_shift(self.r, 4, out=inputs[:2])
        np.add(best >> 4 & 255, 4096, out=inputs[2])
        self.x = _at(_INPUTS, inputs)
        self.of_w = lane + self.each
        self.w = _at(self.weights, self.of_w)
        dot = (self.w * self.x).sum(0, np.int32)
        dot >>= 16
        dot += 2048
        self.p = _at(_SQUASH, dot)
        return lane, best, self.p

    def update(self, new: np.ndarray, hit: np.ndarray) -> None:
        """``new``: for each block symbol << 12 | share << 4 | 1; ``hit``: for each block of the last prediction whether its candidate was right."""
        lane, hits, x = self.lane, hit.astype(np.int32), self.x
        x *= (hits << 12) - self.p
        x += 4096
        x >>= 13
        x += self.w
        self.weights[self.of_w.ravel()] = x.ravel()
        self.steps += 1
        if self.steps % 8 == 0:  # eight steps can't leave the range of 32 bits
            np.minimum(self.weights, 200_000, out=self.weights)
            np.maximum(self.weights, -200_000, out=self.weights)
        aim = hits * 65535 - self.r
        aim >>= 5
        aim += self.r
        self.rates[self.of.ravel()] = aim.ravel()
        self.recent[lane] = (_at(self.recent, lane) << 1 | hits) & 15
        # Right: surer. Wrong: half as sure; once not sure at all, the new symbol takes the slot.
        s, k = self.s.ravel(), self.k
        right = (self.s ^ new) < 4096
        out = np.where(right, np.minimum(self.s + 1, self.s | 15), new).ravel()
        doubtful = np.flatnonzero((k > 1) > right)
        old = _at(s, doubtful)
        out[doubtful] = old - ((old & 15) + 1 >> 1)
        self.slots[self.at.ravel()] = out


#: 2^(q/8), rounded down, for one-byte counts.
_COUNT_OF = np.array([math.isqrt(math.isqrt(math.isqrt(1 << q))) for q in range(256)], np.int64)


def _in_byte(counts: np.ndarray) -> np.ndarray:
    """The greatest q with 2^(q/8) <= count."""
    return (np.searchsorted(_COUNT_OF, counts, side="right") - 1).astype(np.uint8)


#: An order-1 share in a byte (share of 2^16 as 8 log2, times 2 at most 255) and what it is in the logistic domain.
_SHARE_BYTE = np.concatenate([[0], _in_byte(np.arange(1, 1 << _LIST_BITS | 1))]).astype(np.int32)
_STRETCHED_SHARE = np.array([_STRETCH[min(int(_COUNT_OF[q]) >> 4, 4095)] if q else -2047 for q in range(256)], np.int32)
#: What goes into the mix: a rate (of 4096), or from 4096 on a share in a byte, in the logistic domain.
_INPUTS = np.concatenate([_STRETCH, _STRETCHED_SHARE])


class _Shares:
    """What every block starts from: order-0 counts, and for each first symbol the shares of those that often follow it."""

    def __init__(self, distinct: np.ndarray, zero: np.ndarray, followers: np.ndarray, second: np.ndarray, pairs: np.ndarray, escapes: np.ndarray):
        """zero, pairs, escapes: counts in bytes; followers: pairs of each first symbol (the last one stands for a block's start)."""
        k = len(distinct)
        self.distinct = distinct
        counts = _COUNT_OF[zero]
        self.zero = 1 + counts * (1 << 16) // max(int(counts.sum()), 1)
        first = np.repeat(np.arange(k + 1), followers)
        weight, escape = _COUNT_OF[pairs], _COUNT_OF[escapes]
        total = np.bincount(first, weight, k + 1).astype(np.int64) + escape
        full = 1 << _LIST_BITS
        share = 1 + weight * (full - followers[first] - 1) // total[first]
        # The entries of a first symbol: its escape, then its pairs.
        starts = np.cumsum(followers) - followers
        self.escapes = starts + np.arange(k + 1)
        self.pairs = np.arange(len(first)) + first + 1
        width = np.empty(len(first) + k + 1, np.int64)
        width[self.escapes], width[self.pairs] = full - np.bincount(first, share, k + 1).astype(np.int64), share
        ends = np.cumsum(width)
        self.lookup = ends - width
        at = self.lookup & full - 1
        new = np.zeros(len(width), np.int64)
        new[self.pairs] = second << 12 | _SHARE_BYTE[share].astype(np.int64) << 4 | 1
        self.kind = np.int32 if k < 1 << 19 else np.int64
        # In one number, where symbols are few enough: an escape's sign; symbol << 8 | share in a byte; width - 1 and start, 16 bits each.
        self.parts = (new.astype(self.kind), at, width) if k >= _PACKED else None
        self.entries = new >> 4 << 32 | width - 1 << 16 | at
        self.entries[self.escapes] |= -1 << 63

    def open(self) -> None:
        """For searches: of each cut of a first symbol's shares the first entry, counted from its escape, times two, plus one where another begins inside."""
        k = len(self.escapes) - 1
        self.bits = max(0, min(10, 22 - k.bit_length()))
        shift, cuts = _LIST_BITS - self.bits, (k + 1) << self.bits
        begin = np.bincount(self.lookup >> shift, minlength=cuts)
        at_edge = np.zeros(cuts, bool)
        at_edge[self.lookup[(self.lookup & (1 << shift) - 1) == 0] >> shift] = True
        hi = np.cumsum(begin)
        lo = hi - begin + at_edge - 1
        if k < 1 << 14:
            self.lookup = self.lookup.astype(np.int32)
        self.guide = (lo - np.repeat(self.escapes, 1 << self.bits) << 1 | (begin > at_edge)).astype(np.uint16)

    def read(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each entry: whether it is an escape, symbol << 12 | share << 4 | 1, where its share starts, and its share."""
        if self.parts is not None:
            new, at, width = (_at(x, entry) for x in self.parts)
            return new == 0, new, at, width
        x = _at(self.entries, entry)
        new = (x >> 28).astype(self.kind)
        new &= -16
        new |= 1
        width = x >> 16
        width &= (1 << _LIST_BITS) - 1
        width += 1
        missing = x < 0
        x &= (1 << _LIST_BITS) - 1
        return missing, new, x, width

    def find(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The entry of a first symbol in whose share ``target`` lies."""
        cut = context << self.bits
        cut += target >> (_LIST_BITS - self.bits)
        found = _at(self.guide, cut)
        entry = _at(self.escapes, context)
        entry += found >> 1
        open_ = np.flatnonzero(found & 1)
        key = (_at(context, open_) << _LIST_BITS) + _at(target, open_)
        entry[open_] = np.searchsorted(self.lookup, key.astype(self.lookup.dtype), side="right") - 1
        return entry

    @staticmethod
    def packed(symbols: np.ndarray, distinct: np.ndarray, counts: np.ndarray, block: int) -> tuple[bytes, Callable[[_Shares], np.ndarray]]:
        """The model's bytes, and what gives each position's entry in that model."""
        k = len(distinct)
        key = np.empty(len(symbols), np.int64)
        np.multiply(symbols[:-1], k, out=key[1:], dtype=np.int64)
        key[::block] = k * k
        key += symbols
        dense = (k + 1) * k <= _DENSE
        if dense:
            seen = np.bincount(key, minlength=(k + 1) * k)
            keys = np.flatnonzero(seen)
            n = seen[keys]
            del seen
        else:
            keys, of, n = np.unique(key, return_inverse=True, return_counts=True)
        least = _LEAST_PAIRS
        while True:
            keep = n >= least
            followers = np.bincount(keys[keep] // k, minlength=k + 1)
            if int(followers.max()) <= _MOST_FOLLOWERS:
                break
            least *= 2
        escapes = np.bincount(keys[~keep] // k, n[~keep], k + 1).astype(np.int64)

        def entries(shares: _Shares) -> np.ndarray:
            if dense:
                table = np.repeat(shares.escapes.astype(np.int32), k)
                table[keys[keep]] = shares.pairs
                return table[key]
            own = shares.escapes[keys // k]
            own[keep] = shares.pairs
            return own[of].astype(np.int32)

        parts = [distinct.astype("<u4"), _in_byte(counts), followers.astype("<u4"), (keys[keep] % k).astype("<u4"), _in_byte(n[keep]), _in_byte(np.maximum(escapes, 1))]
        planes = [p.view(np.uint8).reshape(-1, 4).T.tobytes() if p.dtype.itemsize == 4 else p.tobytes() for p in parts]
        return zlib.compress(struct.pack("<II", k, int(keep.sum())) + b"".join(planes), 6), entries

    @classmethod
    def unpacked(cls, model: bytes) -> _Shares:
        raw = zlib.decompress(model)
        k, m = struct.unpack_from("<II", raw)
        sizes = (4 * k, k, 4 * (k + 1), 4 * m, m, k + 1)
        if len(raw) != 8 + sum(sizes):
            raise ValueError("a model of another size than it states")
        out, at = [], 8
        for i, size in enumerate(sizes):
            x = np.frombuffer(raw, np.uint8, size, at)
            out.append(np.ascontiguousarray(x.reshape(4, -1).T).view("<u4").ravel().astype(np.int64) if i in (0, 2, 3) else x)
            at += size
        return cls(*out)


class _Zero:
    """Order-0 counts, cumulated: one row for all blocks until they have learnt, then row b for block b, in one sorted line for searches."""

    def __init__(self, shares: _Shares, lanes: int, block: int):
        self.k, self.lanes = len(shares.zero), lanes
        self.start = np.concatenate([[0], np.cumsum(shares.zero)])
        self.epoch = max(-(-block // _EPOCHS), 1)
        bits = int(self.start[-1] + _GAIN * block).bit_length()
        self.kind = np.int32 if lanes << bits < 1 << 31 else np.int64
        self.offset = np.arange(lanes, dtype=np.int64) << bits
        self.sums: np.ndarray | None = None
        #: Every so many counts one stands in a shorter line, which is searched first.
        self.stride = 32

    def learn(self, grid: np.ndarray) -> None:
        """Count the rows of ``grid`` (position, block)."""
        if self.sums is None:
            self.sums = self.start.astype(self.kind) + self.offset.astype(self.kind)[:, None]
        for b in range(self.lanes):
            seen = np.bincount(grid[:, b], minlength=self.k)
            seen *= _GAIN
            self.sums[b, 1:] += np.cumsum(seen, dtype=self.kind)
        self.short = np.ascontiguousarray(self.sums[:, :: self.stride])

    def total(self, lane: np.ndarray) -> np.ndarray | int:
        if self.sums is None:
            return int(self.start[-1])
        return self.sums[lane, -1] - self.offset[lane]

    def interval(self, lane: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.sums is None:
            at = self.start[symbol]
            return at, self.start[symbol + 1] - at
        at = self.sums[lane, symbol].astype(np.int64)
        return at - self.offset[lane], self.sums[lane, symbol + 1] - at

    def find(self, lane: np.ndarray, target: np.ndarray) -> np.ndarray:
        if self.sums is None:
            return np.searchsorted(self.start, target, side="right") - 1
        key = (target + self.offset[lane]).astype(self.kind)
        lo = np.searchsorted(self.short.ravel(), key, side="right") - 1 - lane * self.short.shape[1]
        lo *= self.stride
        # What follows a block's line, the next block's or its own sum again, is above its targets.
        line = _at(self.sums.ravel(), (lo + lane * (self.k + 1))[:, None] + np.arange(self.stride))
        return lo + (line <= key[:, None]).sum(1) - 1


def _turned(x: np.ndarray) -> np.ndarray:
    """A matrix's transpose in memory order, a few of its lines at once."""
    out = np.empty(x.shape[::-1], x.dtype)
    for i in range(0, x.shape[0], 64):
        out[:, i : i + 64] = x[i : i + 64].T
    return out


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A container of all ``ids`` (uint32)."""
    n = len(ids)
    block = int(min(max(n // 1024, 256), block))
    if n == 0:
        return _sealed(block, 0, b"", [])
    counts = np.bincount(ids)
    distinct = np.flatnonzero(counts)
    block = max(block, -(-n * len(distinct) // _ZERO_CELLS))
    lanes = -(-n // block)
    place = np.zeros(len(counts), np.int32)
    place[distinct] = np.arange(len(distinct))
    symbols = place[ids]
    model, entries = _Shares.packed(symbols, distinct, counts[distinct], block)
    shares = _Shares.unpacked(model)
    tail = [int(shares.escapes[symbols[-1]]), int(shares.escapes[0])]  # beyond the last id: symbols 0, as escapes

    def in_step(x: np.ndarray, first: int, fill: int) -> np.ndarray:
        flat = np.full(lanes * block, fill, np.int32)
        flat[:n] = x
        flat[n : n + 1] = first
        return _turned(flat.reshape(lanes, block))

    grid, pairs = in_step(symbols, 0, 0), in_step(entries(shares), *tail)
    del symbols, entries
    state, zero = _Adaptive(lanes, len(distinct)), _Zero(shares, lanes, block)
    low, span = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64)
    # Word i of all blocks, then word i + 1: blocks put out about as many in as many positions.
    room = 5 * block + 8
    words, at = np.zeros(lanes * room, np.uint16), np.arange(lanes, dtype=np.int64)

    def carry(lane: np.ndarray) -> None:
        """Carry into the words that are out."""
        low[lane] &= _LOW48
        back = at[lane] - lanes
        while len(back):
            words[back] += np.uint16(1)
            back = back[words[back] == 0] - lanes

    def settle(short: np.ndarray) -> None:
        """Put out the top words of blocks whose spans got short."""
        while len(short):
            lo = _at(low, short)
            over = lo > _LOW48
            if over.any():
                carry(short[over])
            where, sp = _at(at, short), _at(span, short)
            words[where] = lo >> 32 & 0xFFFF
            where += lanes
            at[short] = where
            lo <<= 16
            lo &= _LOW48
            low[short] = lo
            sp <<= 16
            span[short] = sp
            short = short[sp < _ONE32]

    last = np.full(lanes, len(distinct), np.int64)
    for t, (symbol, entry) in enumerate(zip(grid, pairs, strict=True)):
        if t and t % zero.epoch == 0:
            zero.learn(grid[t - zero.epoch : t])
        lane, best, p = state.predict(last)
        missing, new, first, share = shares.read(entry)
        escaped = np.flatnonzero(missing)
        last = symbol.astype(np.int64)
        new[escaped] = last[escaped] << 12 | 1
        # Whether the candidate is right; where it is, the symbol's share is everything.
        hit = (best ^ _at(new, lane)) < 4096
        sp = _at(span, lane)
        edge = (sp >> 12) * p
        sp -= edge
        np.copyto(sp, edge, where=hit)
        span[lane] = sp
        edge[hit] = 0
        low[lane] += edge
        right = lane[hit]
        new[right] = best[hit] & -16 | 1
        first[right], share[right] = 0, 1 << _LIST_BITS
        span >>= _LIST_BITS
        first *= span
        low += first
        span *= share
        settle(np.flatnonzero(span < _ONE32))
        missing[right] = False
        rest = escaped[missing[escaped]]
        if len(rest):
            unit = span[rest] // zero.total(rest)
            lo, width = zero.interval(rest, last[rest])
            low[rest] += unit * lo
            span[rest] = unit * width
            settle(rest[span[rest] < _ONE32])
        state.update(new, hit)
    carry(np.flatnonzero(low > _LOW48))
    for k in (32, 16, 0):  # all 48 bits of low
        words[at] = (low >> k).astype(np.uint16)
        at += lanes
    at //= lanes
    lines = _turned(words.reshape(room, lanes)[: int(at.max())]).astype("<u2")
    return _sealed(block, n, model, [x[:m].tobytes() for x, m in zip(lines, at.tolist(), strict=True)])


def _sealed(block: int, n: int, model: bytes, parts: list[bytes]) -> bytes:
    index = np.array([[len(x) // 2, zlib.crc32(x)] for x in parts], "<u4").tobytes()
    head = _HEAD.pack(_MAGIC, _VERSION, block, n, len(parts), len(model), zlib.crc32(model + index))
    return b"".join([head, struct.pack("<I", zlib.crc32(head)), model, index, *parts])


def decode(container: bytes) -> np.ndarray:
    """The ids of a container; damage to its head, model, index or any block raises ValueError."""
    at = _HEAD.size + 4
    if len(container) < at or zlib.crc32(container[: _HEAD.size]) != struct.unpack_from("<I", container, _HEAD.size)[0]:
        raise ValueError("the head is damaged")
    magic, version, block, n, lanes, model_size, crc = _HEAD.unpack_from(container)
    if magic != _MAGIC or version != _VERSION:
        raise ValueError("not a container of this format")
    model, index = container[at : at + model_size], container[at + model_size : at + model_size + 8 * lanes]
    if zlib.crc32(model + index) != crc:
        raise ValueError("the model or the index is damaged")
    at += model_size + 8 * lanes
    index = np.frombuffer(index, "<u4").reshape(-1, 2)
    sizes = index[:, 0].astype(np.int64)
    if len(container) != at + 2 * int(sizes.sum()):
        raise ValueError("the container is cut short or too long")
    if n == 0:
        return np.zeros(0, np.uint32)
    ends = at + 2 * np.cumsum(sizes)
    for i, (a, b) in enumerate(zip((ends - 2 * sizes).tolist(), ends.tolist(), strict=True)):
        if zlib.crc32(container[a:b]) != index[i, 1]:
            raise ValueError(f"block {i} of {lanes} is damaged")
    words = np.concatenate([np.frombuffer(container, "<u2", int(sizes.sum()), at), np.zeros(4, np.uint16)])
    stop = np.cumsum(sizes)
    place = stop - sizes
    shares = _Shares.unpacked(model)
    state, zero = _Adaptive(lanes, len(shares.distinct)), _Zero(shares, lanes, block)
    shares.open()
    code = np.zeros(lanes, np.int64)
    for _ in range(3):
        code = code << 16 | words[place]
        place += 1
    span = np.full(lanes, 1 << 48, np.int64)
    grid = np.empty((block, lanes), np.int32)

    def refill(short: np.ndarray) -> None:
        """Take the next words of blocks whose spans got short."""
        while len(short):
            where, c, sp = _at(place, short), _at(code, short), _at(span, short)
            c <<= 16
            c |= _at(words, where)
            code[short] = c
            where += 1
            place[short] = where
            sp <<= 16
            span[short] = sp
            short = short[sp < _ONE32]

    last = np.full(lanes, len(shares.distinct), np.int64)
    for t in range(block):
        if t and t % zero.epoch == 0:
            zero.learn(grid[t - zero.epoch : t])
        lane, best, p = state.predict(last)
        sp, c = _at(span, lane), _at(code, lane)
        edge = (sp >> 12) * p
        hit = c < edge
        sp -= edge
        np.copyto(sp, edge, where=hit)
        span[lane] = sp
        edge[hit] = 0
        c -= edge
        code[lane] = c
        right = lane[hit]
        span >>= _LIST_BITS
        # Below 2^52 the floor of a quotient of floating-point numbers is that of the integers.
        entry = shares.find(last, (code / span).astype(np.int64))
        missing, new, first, share = shares.read(entry)
        missing[right] = False
        new[right] = best[hit] & -16 | 1
        first[right], share[right] = 0, 1 << _LIST_BITS
        first *= span
        np.subtract(code, first, out=code)
        span *= share
        refill(np.flatnonzero(span < _ONE32))
        rest = np.flatnonzero(missing)
        if len(rest):
            total = zero.total(rest)
            unit = span[rest] // total
            c = code[rest]
            s = zero.find(rest, np.minimum(c // unit, total - 1))
            lo, width = zero.interval(rest, s)
            code[rest] = c - unit * lo
            span[rest] = unit * width
            refill(rest[span[rest] < _ONE32])
            new[rest] = s << 12 | 1
        last = (new >> 12).astype(np.int64)
        grid[t] = last
        state.update(new, hit)
    return shares.distinct.astype(np.uint32)[_turned(grid).ravel()[:n]]
