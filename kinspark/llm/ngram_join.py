"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is: by hash, with frequent n-grams after all others.
It is cut into fragments; the overlap of a pair is counted in each fragment on its
own and the partial counts are summed per pair. Which pairs are counted is decided
without loss:

* Two sets with |A & B| / |A | B| >= t share an n-gram among the first
  n - ceil(t n) + 1 of the global order in each (prefix bound), so documents meet
  in buckets of equal prefix n-grams.
* In a bucket every member is paired with a first document of about its size (its
  hub) first: a count that is linear in the bucket. The links found give components.
* Pairs of different components that share a bucket follow: first one pair of
  representatives, then all others that still lie between components. Pairs inside
  one component need no count: they can't change it.

A bucket of more than ``_HOT`` rows is cut into blocks, every two of which meet in a
task of their own, so that no task holds a bucket, however common its n-gram.

Sizes, the first common position and the counts in equal cuts of the hash range bound
the overlap from above and spare most unlike pairs the count. Equal sets are known
by a 128-bit sum of their members and link without one.

A pair that shares many prefix n-grams would leave as many buckets. Each row therefore names the
``_BEFORE`` n-grams that precede its own among its document's shared ones: where two rows have one of
these in common, the pair has met there already (both lie nearer to the start, so no bound rules the
pair out there that admits it here), and is passed over. At its first common n-gram it always stays.

Frequent n-grams are found over all documents: each task counts in windows of
about two million n-grams and reports those it saw twice or more; sums of
at least the least power of two that leaves 2^18 n-grams (16 at the least) make an
n-gram frequent, so that they can be broadcast. The order only decides how fast the
join is, not what it finds.

Defined results: a null or blank text has an empty set and links with nothing; a
text of fewer than k words is one n-gram, its whole sequence; rows with a null id
link with nothing and get a null component; rows that share an id count as one
document (its greatest text); a very long text is read whole, as a set of its own size; other columns,
whatever their names, are not read, and ``keep_representatives`` returns them as they are; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinspark.llm.components import connected_components
from kinspark.llm.shared import keep_where, map_arrow, scratch, slices, small, stored, text_buffers
from kinspark.llm.words import mix, shingle_sets

FRAGMENTS = 4
_BAND = float(np.log(1.05))
_WINDOW = 2_000_000
_LEAST_FREQUENT = 16
_MOST_FREQUENT = 1 << 18
_SALTS = 32
_SIEVE_BITS = (1 << 20, 1 << 27)
_HOT = 4096
_COARSE = 64
_BEFORE = 4
_FEW = 64
_TOGETHER = 1 << 14
_COLUMNS = ("gram", "cell", "doc", "n", "pos", "component", "hub", "block", "known")
_SEED_A, _SEED_B = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _profile(k: int):
    schema = pa.schema([("doc", pa.int64()), ("n", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("cuts", pa.binary()), ("coarse", pa.binary()), ("gram", pa.int64()), ("times", pa.int64())])

    def seen(window: list[np.ndarray]) -> pa.RecordBatch:
        grams, times = np.unique(np.concatenate(window), return_counts=True)
        keep = times >= 2
        m = int(keep.sum())
        return _batch(schema, *(pa.nulls(m, f.type) for f in list(schema)[:6]), grams[keep], times[keep])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window: list[np.ndarray] = []
        held = 0
        for part in slices(batches, "text"):
            sets = shingle_sets(*text_buffers(part.column("text")), k)
            n = np.array([len(s) for s in sets], np.int32)
            one, two = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
            flat = np.concatenate(sets)
            u = flat.view(np.uint64)
            ends = np.concatenate([[0], np.cumsum(n)])
            for out, seed in ((one, _SEED_A), (two, _SEED_B)):
                sums = np.zeros(len(flat) + 1, np.uint64)
                np.cumsum(mix(u ^ seed), out=sums[1:])
                out[:] = (sums[ends[1:]] - sums[ends[:-1]]).view(np.int64)
            cuts = [_cut_counts(x) for x in sets]
            m = len(sets)
            yield _batch(schema, part.column("doc"), n, one, two, cuts, [_coarse_counts(x) for x in sets], pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()))
            window.append(flat)
            held += len(flat)
            if held >= _WINDOW:
                yield seen(window)
                window, held = [], 0
        if held:
            yield seen(window)

    return kernel, "doc long, n int, k1 long, k2 long, cuts binary, coarse binary, gram long, times long"


def _cut_counts(grams: np.ndarray) -> bytes:
    """How many of a set lie in each of 2^i equal cuts of the hash range, four to eight on average (up to 2^16 cuts)."""
    i = min(max(len(grams).bit_length() - 3, 2), 16)
    counts = np.bincount((grams.view(np.uint64) >> np.uint64(64 - i)).astype(np.int64), minlength=1 << i)
    return counts.astype("<u4" if len(grams) > 1 << 15 else "<u2").tobytes()


def _coarse_counts(grams: np.ndarray) -> bytes:
    """How many of a set lie in each of ``_COARSE`` equal cuts of the hash range, 255 for that and more."""
    cut = (grams.view(np.uint64) >> np.uint64(65 - _COARSE.bit_length())).astype(np.int64)
    return np.minimum(np.bincount(cut, minlength=_COARSE), 255).astype(np.uint8).tobytes()


def _most_shared(a: bytes, b: bytes, n_a: int, n_b: int) -> int:
    """An upper bound of the overlap of two sets: the sum over common cuts of the smaller count."""
    x, y = (np.frombuffer(v, "<u4" if n > 1 << 15 else "<u2").astype(np.int64) for v, n in ((a, n_a), (b, n_b)))
    while len(x) > len(y):
        x = x.reshape(-1, 2).sum(1)
    while len(y) > len(x):
        y = y.reshape(-1, 2).sum(1)
    return int(np.minimum(x, y).sum())


def _bounded(num: int, den: int):
    """Pairs with both profiles: those whose bound of the overlap allows a link."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n_a", pa.int32()), ("n_b", pa.int32())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_pylist() for c in ("n_a", "n_b"))
            cuts = zip(batch.column("cuts_a").to_pylist(), batch.column("cuts_b").to_pylist(), na, nb, strict=True)
            most = np.fromiter((_most_shared(*c) for c in cuts), np.int64, len(na))
            keep = most * (num + den) >= num * (np.array(na, np.int64) + np.array(nb, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b", "n_a", "n_b")], schema=schema).filter(pa.array(keep))

    return kernel, "a long, b long, n_a int, n_b int"


def _in_order(grams: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, int]:
    """The set in the global order, and how many of it are not frequent."""
    if not len(frequent) or not len(grams):
        return grams, len(grams)
    at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
    late = frequent[at] == grams
    return np.concatenate([grams[~late], grams[late]]), int((~late).sum())


def _postings(k: int, frequent: np.ndarray, num: int, den: int):
    schema = pa.schema([("gram", pa.int64()), ("salt", pa.int32()), ("place", pa.int64()), ("doc", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            docs = part.column("doc").to_numpy(zero_copy_only=False)
            grams, salts, orders, owners, sizes, places = [], [], [], [], [], []
            for doc, grown in zip(docs.tolist(), shingle_sets(*text_buffers(part.column("text")), k), strict=True):
                n = len(grown)
                if not n:
                    continue
                p = n + (-n * num) // den + 1
                ordered, light = _in_order(grown, frequent)
                grams.append(ordered[:p])
                salt = np.full(p, -1, np.int32)
                salt[light:] = (doc * 0x9E3779B1 >> 7) % _SALTS
                salts.append(salt)
                orders.append(np.full(p, int(np.log(n) / _BAND) << 40 | light, np.int64))
                owners.append(np.full(p, doc, np.int64))
                sizes.append(np.full(p, n, np.int32))
                places.append(np.arange(p, dtype=np.int32))
            if grams:
                yield _batch(schema, *(np.concatenate(c) for c in (grams, salts, orders, owners, sizes, places)))

    return kernel, "gram long, salt int, place long, doc long, n int, pos int"


def _name_hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (gram, salt, place, doc): drop buckets of one row, give each other row a hub and the hub's size.

    A place is a band of sizes (5 % wide), then how many n-grams of the document are not frequent. So the hub,
    the first row of its band, is the one most made of what the bucket's documents share. Only one row of an
    open bucket is held, however long the bucket is. Salted buckets of frequent n-grams keep single rows, as
    they meet the other salts' hubs later. A row without a document tells how many rows a batch has of a long bucket.
    """
    schema = pa.schema([("gram", pa.int64()), ("salt", pa.int32()), ("doc", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("light", pa.int32()), ("hub", pa.int64()), ("hub_n", pa.int32())])
    open_key: tuple[int, int] | None = None
    open_band = hub = hub_n = 0
    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "salt", "doc", "n", "pos", "place")]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            held = None
        g, s, d, n, _, place = cols
        if not len(g):
            continue
        band = place >> 40
        start = np.ones(len(g), bool)
        start[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1])
        part = start.copy()
        part[1:] |= band[1:] != band[:-1]
        at, sub = np.flatnonzero(start), np.flatnonzero(part)
        run, piece = np.cumsum(start) - 1, np.cumsum(part) - 1
        many = (np.diff(np.append(at, len(g))) > 1) | (s[at] >= 0)
        hubs, hub_ns = d[sub].copy(), n[sub].copy()
        if open_key == (int(g[0]), int(s[0])):
            many[0] = True
            if band[0] == open_band:
                hubs[0], hub_ns[0] = hub, hub_n
        if not many[-1]:
            held = [c[-1:] for c in cols]
            open_key = None
        else:
            open_key, open_band, hub, hub_n = (int(g[-1]), int(s[-1])), int(band[-1]), int(hubs[-1]), int(hub_ns[-1])
        keep = many[run]
        if keep.any():
            yield _batch(schema, *(c[keep] for c in cols[:5]), (place[keep] & ((1 << 40) - 1)).astype(np.int32), hubs[piece][keep], hub_ns[piece][keep])
        rows = np.diff(np.append(at, len(g)))
        tell = np.flatnonzero(rows >= min(len(g), _HOT // _SALTS) // 2)
        if len(tell):
            none = [pa.nulls(len(tell), f.type) for f in list(schema)[4:]]
            yield _batch(schema, g[at[tell]], s[at[tell]], pa.nulls(len(tell), pa.int64()), rows[tell].astype(np.int32), *none)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], bool]]:
    """Rows of buckets as columns, about ``_TOGETHER`` at a time, and whether they are the last (these may be none)."""
    none = {c: np.zeros(0, np.int64) for c in _COLUMNS} | {"coarse": np.zeros((0, _COARSE), np.uint8), "before": np.zeros((0, _BEFORE), np.int64)}
    parts, held = [none], 0
    for batch in batches:
        part = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in _COLUMNS}
        part["before"] = np.stack([batch.column(f"before{x}").to_numpy(zero_copy_only=False) for x in range(_BEFORE)], axis=1)
        part["coarse"] = np.frombuffer(b"".join(batch.column("coarse").to_pylist()), np.uint8).reshape(-1, _COARSE)
        parts.append(part)
        held += batch.num_rows
        if held >= _TOGETHER:
            yield {c: np.concatenate([x[c] for x in parts]) for c in none}, False
            parts, held = [none], 0
    yield {c: np.concatenate([x[c] for x in parts]) for c in none}, True


def _across(num: int, den: int):
    """Rows of open buckets sorted by (gram, cell, n, doc): pairs of different components that size, position and the coarse counts allow. In a cell of two blocks only rows of different blocks meet, and a pair that has met at an n-gram before is passed over.

    Most buckets have a few rows: those of up to ``_FEW`` are compared together, each row of all of them with the next one, the next but one
    and so on of its bucket. Longer ones are worked off one by one, in blocks.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n_a", pa.int32()), ("n_b", pa.int32())])

    def admitted(old: dict[str, np.ndarray], i: np.ndarray, new: dict[str, np.ndarray], j: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of the pairs of rows i and j those that the coarse counts allow and that have not met before."""
        for x in range(0, len(i), _TOGETHER):
            p, q = i[x : x + _TOGETHER], j[x : x + _TOGETHER]
            low = np.minimum(old["coarse"][p], new["coarse"][q])
            able = (low.sum(1, dtype=np.int64) * (num + den) >= num * (old["n"][p] + new["n"][q])) | (low == 255).any(1)
            p, q = p[able], q[able]
            met = np.zeros(len(p), bool)
            mine, yours, known, given = old["before"][p], new["before"][q], old["known"][p], new["known"][q]
            for x1 in range(_BEFORE):
                for x2 in range(_BEFORE):
                    met |= (mine[:, x1] == yours[:, x2]) & (known > x1) & (given > x2)
            p, q = p[~met], q[~met]
            if len(p):
                d, e, n_d, n_e = old["doc"][p], new["doc"][q], old["n"][p], new["n"][q]
                swap = d > e
                yield _batch(schema, np.where(swap, e, d), np.where(swap, d, e), np.where(swap, n_e, n_d).astype(np.int32), np.where(swap, n_d, n_e).astype(np.int32))

    def few(cols: dict[str, np.ndarray], ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pairs inside the buckets whose end is given with each row (0: not these)."""
        n, component, hub, doc, block = (cols[c] for c in ("n", "component", "hub", "doc", "block"))
        left = n - cols["pos"]
        crossing = cols["cell"] >> 32 != cols["cell"] & 0xFFFFFFFF
        i, step, found, count = np.arange(len(n)), 0, [], 0
        while len(i):
            step += 1
            i = i[i + step < ends[i]]
            i = i[n[i] * den >= n[i + step] * num]  # sizes grow along a bucket: no later row fits either
            j = i + step
            ok = (component[i] != component[j]) & (hub[i] != doc[j]) & (hub[j] != doc[i])
            ok &= np.minimum(left[i], left[j]) * (num + den) >= num * (n[i] + n[j])
            ok &= ~crossing[i] | (block[i] != block[j])
            found.append((i[ok], j[ok]))
            count += len(found[-1][0])
            if count >= _TOGETHER or not len(i):
                yield from admitted(cols, np.concatenate([x for x, _ in found]), cols, np.concatenate([y for _, y in found]))
                found, count = [], 0

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = held = past = None
        for cols, last in _gathered(batches):
            if held is not None:
                cols = {c: np.concatenate([held[c], v]) for c, v in cols.items()}
                held = None
            size = len(cols["n"])
            if not size:
                continue
            cut = np.flatnonzero((np.diff(cols["gram"]) != 0) | (np.diff(cols["cell"]) != 0)) + 1
            starts, stops = np.concatenate([[0], cut]), np.concatenate([cut, [size]])
            long = stops - starts > _FEW
            long[0] |= bucket == (int(cols["gram"][0]), int(cols["cell"][0]))
            ends = np.where(long, 0, stops)
            if not last and not long[-1]:  # it may go on
                held = {c: v[starts[-1] :] for c, v in cols.items()}
                ends[-1] = 0
            yield from few(cols, np.repeat(ends, stops - starts))
            for at, to in zip(starts[long].tolist(), stops[long].tolist(), strict=True):
                cell = int(cols["cell"][at])
                if bucket != (int(cols["gram"][at]), cell):
                    bucket, past = (int(cols["gram"][at]), cell), {c: v[:0] for c, v in cols.items()}
                crossing = cell >> 32 != cell & 0xFFFFFFFF
                for lo in range(at, to, 256):  # a block of later rows against the earlier ones of fitting size
                    hi = min(lo + 256, to)
                    new = {c: cols[c][lo:hi] for c in past}
                    fit = past["n"] * den >= new["n"][0] * num
                    past = {c: np.concatenate([v[fit], new[c]]) for c, v in past.items()}
                    first = len(past["n"]) - (hi - lo)
                    for x in range(0, len(past["n"]), 4096):
                        old = {c: v[x : x + 4096] for c, v in past.items()}
                        n1, n2 = old["n"][:, None], new["n"][None, :]
                        inter = -((-num * (n1 + n2)) // (num + den))
                        ok = (n1 * den >= n2 * num) & (old["component"][:, None] != new["component"][None, :])
                        ok &= np.minimum(n1 - old["pos"][:, None], n2 - new["pos"][None, :]) >= inter
                        ok &= (old["hub"][:, None] != new["doc"][None, :]) & (new["hub"][None, :] != old["doc"][:, None])
                        if crossing:
                            ok &= old["block"][:, None] != new["block"][None, :]
                        ok &= (x + np.arange(len(old["n"])))[:, None] < first + np.arange(hi - lo)[None, :]
                        i, j = np.nonzero(ok)
                        yield from admitted(old, i, new, j)

    return kernel, "a long, b long, n_a int, n_b int"


def _segments(k: int, frequent: np.ndarray, sieve: np.ndarray):
    """(doc, fragment, items): the sets of the documents in the sieve, cut along the global order."""
    schema = pa.schema([("doc", pa.int64()), ("fragment", pa.int32()), ("items", pa.list_(pa.int64()))])
    light = FRAGMENTS - 1
    pivots = np.array([-(2**63) + (2**64 * i) // light for i in range(1, light)], np.int64)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            v = part.column("doc").to_numpy(zero_copy_only=False) % (len(sieve) << 3)
            part = part.filter(pa.array((sieve[v >> 3] >> (v & 7).astype(np.uint8) & 1).astype(bool)))
            docs, fragments, items = [], [], []
            for doc, grams in zip(part.column("doc").to_pylist(), shingle_sets(*text_buffers(part.column("text")), k), strict=True):
                ordered, n = _in_order(grams, frequent)
                ends = [0, *np.searchsorted(ordered[:n], pivots).tolist(), n, len(ordered)]
                for f in range(FRAGMENTS):
                    if ends[f + 1] > ends[f]:
                        docs.append(doc)
                        fragments.append(f)
                        items.append(ordered[ends[f] : ends[f + 1]])
            if docs:
                ends = np.concatenate([[0], np.cumsum([len(i) for i in items])])
                yield _batch(schema, docs, fragments, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(items))))

    return kernel, "doc long, fragment int, items array<long>"


def _sieve(ids: DataFrame) -> np.ndarray:
    """A bitmap (16 MB at most) that holds every id's remainder; others may pass it by chance, which the joins that follow mend."""
    least, most = _SIEVE_BITS
    size = min(max(least, 1 << (16 * ids.count()).bit_length()), most)
    v = F.pmod(F.col("doc"), F.lit(size)) + 1
    bits = ids.select(F.bitmap_bucket_number(v).alias("bucket"), F.bitmap_bit_position(v).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(size >> 3, np.uint8)
    for bucket, piece in bits.toLocalIterator():  # 4096 rows of 4 KB at most
        out[(bucket - 1) * 4096 : (bucket - 1) * 4096 + len(piece)] = np.frombuffer(bytes(piece), np.uint8)
    return out


def _possible(pairs: DataFrame, profile: DataFrame, num: int, den: int, name: str) -> DataFrame:
    """Of pairs (a, b, n_a, n_b) those that the counts in cuts of the hash range don't rule out."""
    side = profile.select("doc", "cuts")
    two = pairs.join(side.select(F.col("doc").alias("a"), F.col("cuts").alias("cuts_a")), "a").join(side.select(F.col("doc").alias("b"), F.col("cuts").alias("cuts_b")), "b")
    kernel, schema = _bounded(num, den)
    return stored(map_arrow(two.select("a", "b", "n_a", "n_b", "cuts_a", "cuts_b"), kernel, schema), name)


def _counted(texts: DataFrame, pairs: DataFrame, k: int, frequent: np.ndarray, num: int, den: int) -> DataFrame:
    """(a, b) of the pairs that link: overlaps are counted fragment by fragment and summed."""
    ids = stored(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct(), "ngram_ids")
    kernel, schema = _segments(k, frequent, _sieve(ids))
    segments = stored(map_arrow(texts, kernel, schema), "ngram_segments")
    left = pairs.select("a", "b", "n_a", "n_b").withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))))
    left = left.join(segments.select(F.col("doc").alias("a"), "fragment", F.col("items").alias("items_a")), ["a", "fragment"])
    both = left.join(segments.select(F.col("doc").alias("b"), "fragment", F.col("items").alias("items_b")), ["b", "fragment"])
    partial = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("items_a", "items_b")).cast("long").alias("partial"))
    summed = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("partial").alias("inter"))
    # inter >= t (n_a + n_b - inter)  <=>  inter (den + num) >= num (n_a + n_b)
    return summed.where(F.col("inter") * (num + den) >= (F.col("n_a") + F.col("n_b")).cast("long") * num).select("a", "b")


def _renamed(label: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after more links: components of components."""
    mine = label.select("node", "component")
    ends = links.join(mine.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(mine.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    merged = connected_components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), "a", "b").select(F.col("node").alias("was"), F.col("component").alias("now"))
    old = mine.join(merged, F.col("component") == F.col("was"), "left").select("node", F.coalesce("now", "component").alias("component"))
    new = merged.join(mine.select(F.col("node").alias("was")), "was", "left_anti").select(F.col("was").alias("node"), F.col("now").alias("component"))
    return old.unionByName(new)


def _met(shared: DataFrame, profile: DataFrame, label: DataFrame, hot: DataFrame, num: int, den: int, representatives: bool) -> DataFrame:
    """Pairs (a, b, n_a, n_b) of different components that meet in a bucket; ``representatives``: one row of each component in it only.

    ``hot`` (gram, blocks) are the long buckets: their rows are dealt to cells, one for every two blocks.
    """
    kernel, schema = _across(num, den)
    before = ["known", *(f"before{x}" for x in range(_BEFORE))]
    columns = ["gram", "cell", "block", "doc", "n", "pos", "component", "hub", "coarse", *before]
    here = shared.join(small(label.select(F.col("node").alias("doc"), "component")), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    here = here.join(small(profile.select("doc", "coarse")), "doc").select("gram", "doc", "n", "pos", "light", "hub", "component", "coarse", *before)

    def first_of_each(rows: DataFrame, *keys: str) -> DataFrame:
        first = F.min(F.struct("light", "doc", "n", "pos", "hub", "coarse", *before)).alias("x")
        return rows.groupBy(*keys, "component").agg(first).select(*keys, "component", "x.*")

    all_of = Window.partitionBy("gram")
    plain = here.join(small(hot), "gram", "left_anti").repartition("gram")
    plain = plain.withColumn("lo", F.min("component").over(all_of)).withColumn("hi", F.max("component").over(all_of)).where("lo < hi").drop("lo", "hi")
    if representatives:
        plain = first_of_each(plain, "gram")
    plain = plain.withColumn("cell", F.lit(0).cast("long")).withColumn("block", F.lit(0)).select(*columns).sortWithinPartitions("gram", "cell", "n", "doc")
    if not hot.limit(1).count():
        return map_arrow(plain, kernel, schema).distinct()
    busy = here.join(small(hot), "gram")
    mixed = busy.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("gram")
    busy = busy.join(mixed, "gram", "left_semi")
    if representatives:
        busy = first_of_each(busy, "gram", "blocks")
    busy = busy.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    busy = busy.withColumn("cell", F.shiftleft(F.least("block", "other"), 32) + F.greatest("block", "other")).select(*columns)
    busy = busy.repartition("gram", "cell").sortWithinPartitions("gram", "cell", "n", "doc")
    return map_arrow(plain, kernel, schema).unionByName(map_arrow(busy, kernel, schema)).distinct()


def ngram_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_shingles, component_id); a link is den * |A & B| >= num * |A | B|."""
    with scratch(docs.sparkSession) as keep:
        return keep(_components(docs, k, num, den, id_col, text_col), "ngram_components")


def _frequent(scanned: DataFrame) -> np.ndarray:
    """The frequent n-grams, sorted: those seen so often that no more than _MOST_FREQUENT are."""
    seen = stored(scanned.where("gram is not null").groupBy("gram").agg(F.sum("times").alias("times")).where(F.col("times") >= _LEAST_FREQUENT), "ngram_seen")
    power = F.floor(F.log2("times")).cast("int")
    by_power = {r["power"]: r["n"] for r in seen.groupBy(power.alias("power")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 64 rows at most
    least, held = 64, 0
    for p in sorted(by_power, reverse=True):
        held += by_power[p]
        if held > _MOST_FREQUENT:
            break
        least = p
    return np.sort(seen.where(power >= least).select("gram").toArrow().column("gram").to_numpy().astype(np.int64))


def _components(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    kernel, schema = _profile(k)
    scanned = stored(map_arrow(texts, kernel, schema), "ngram_profile")
    rows = scanned.where("n is not null")
    sums = rows.agg(F.count("doc"), F.count_distinct("doc")).first()
    if sums[0] > sums[1]:  # ids repeat: one document each, with its greatest text
        one = texts.groupBy("doc").agg(F.max("text").alias("text"))
        found = ngram_components(one, k, num, den, "doc", "text")
        mine = texts.select("doc")
        return mine.join(found, F.col("doc").eqNullSafe(F.col("doc_id"))).select("doc_id", "n_shingles", "component_id")
    frequent = _frequent(scanned)
    usable = texts.where("doc is not null")
    profile = rows.where("doc is not null and n > 0")
    spark = docs.sparkSession
    # Equal sets are one node from here on: the least document that has the set.
    classes = profile.groupBy("n", "k1", "k2").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("size")).where("size > 1")
    rep_of = stored(profile.join(classes, ["n", "k1", "k2"]).where("doc <> rep").select(F.col("doc").alias("copy"), "rep"), "ngram_copies")
    with scratch(spark) as keep:
        kernel, schema = _postings(k, frequent, num, den)
        dealt = map_arrow(usable, kernel, schema).repartition("gram", "salt").sortWithinPartitions("gram", "salt", "place", "doc")
        found = stored(map_arrow(dealt, _name_hubs, "gram long, salt int, doc long, n int, pos int, light int, hub long, hub_n int"), "ngram_buckets")
        hot = found.where("doc is null").groupBy("gram").agg(F.sum("n").alias("rows")).where(F.col("rows") > _HOT)
        hot = keep(hot.select("gram", F.ceil(F.col("rows") / _HOT).cast("long").alias("blocks")), "ngram_hot")
        copies = small(rep_of)
        shared = found.where("doc is not null").join(copies.select(F.col("copy").alias("doc")), "doc", "left_anti")
        shared = shared.join(copies, F.col("hub") == F.col("copy"), "left").withColumn("hub", F.coalesce("rep", "hub")).drop("copy", "rep")
        along = Window.partitionBy("doc").orderBy("pos")
        shared = shared.withColumn("known", F.least(F.row_number().over(along) - 1, F.lit(_BEFORE)))
        shared = keep(shared.withColumns({f"before{x}": F.lag("gram", x + 1, 0).over(along) for x in range(_BEFORE)}), "ngram_shared")

    with scratch(spark) as keep:
        near = (F.least("n", "hub_n").cast("long") * den) >= (F.greatest("n", "hub_n").cast("long") * num)
        to_hub = shared.where("doc <> hub").where(near).select(F.col("hub").alias("a"), F.col("doc").alias("b"), F.col("hub_n").alias("n_a"), F.col("n").alias("n_b"))
        heads = shared.where("salt >= 0 and doc = hub").select("gram", "doc", "n").distinct()
        top = heads.groupBy("gram").agg(F.min(F.struct("doc", "n")).alias("top"))
        heads = heads.join(top, "gram").where("doc <> top.doc").select(F.col("top.doc").alias("a"), F.col("doc").alias("b"), F.col("top.n").alias("n_a"), F.col("n").alias("n_b"))
        heads = heads.where(F.least("n_a", "n_b").cast("long") * den >= F.greatest("n_a", "n_b").cast("long") * num)
        hubs = _possible(to_hub.union(heads).distinct(), profile, num, den, "ngram_hub_pairs")
        label = keep(connected_components(_counted(usable, hubs, k, frequent, num, den), "a", "b"), "ngram_labels")

    # Components that share a bucket first try one pair of members, those most made of shared n-grams; then all pairs
    # of the components that are still apart.
    with scratch(spark) as keep:
        tried = _possible(_met(shared, profile, label, hot, num, den, True), profile, num, den, "ngram_rep_pairs")
        label = keep(_renamed(label, _counted(usable, tried, k, frequent, num, den)), "ngram_labels")
    with scratch(spark) as keep:
        rest = _possible(_met(shared, profile, label, hot, num, den, False), profile, num, den, "ngram_pairs")
        label = keep(_renamed(label, _counted(usable, rest, k, frequent, num, den)), "ngram_labels")
    named = label
    own = rows.select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"))
    own = own.join(rep_of, F.col("doc_id") == F.col("copy"), "left").withColumn("own_node", F.coalesce("rep", "doc_id"))
    own = own.join(named, F.col("own_node") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "own_node").alias("component_id"))
    return own


def keep_representatives(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, of which each group of linked documents keeps its least id."""
    with scratch(docs.sparkSession) as keep:
        found = ngram_components(docs, k, num, den, id_col, text_col)
        gone = keep(found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)), "ngram_gone")
    return keep_where(docs, id_col, gone, "left_anti")
