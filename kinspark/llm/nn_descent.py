"""Embedding near-dedup by NN-descent.

1. Equal vectors become one node that carries how many there are.
2. A first neighbour graph comes from windows over several orders, each along sign
   codes of random hyperplanes: rows of a window are compared with each other.
3. Rounds of NN-descent: at every node its neighbours and a sample of the nodes that
   list it are compared with each other, where one of the two is new; lists keep the k
   best. Rounds stop when few entries change.
4. A node whose whole list lies above the threshold is saturated: links may be missing
   from its list. Components with saturated nodes are cut into balls (centre, radius) and
   every row outside is compared with each ball that can reach it; what links joins the
   component. This goes on until nothing joins, then these components are compared whole,
   in blocks of matrix products of which only the counts leave.
5. Links are entries at or above the threshold in double precision.
6. An audit compares bounded samples (``audit_size`` of all, of linked and of saturated
   vectors) with all rows by brute force; each vector counts alike, the worst sample
   decides. Below ``min_recall`` the search goes on with more orders and longer lists,
   after three attempts with every component as one with saturated nodes, which is exact.

Defined results: vectors that are null, empty, zero, hold null or non-finite components
link with nothing: n_links 0, themselves their component. Vectors of different lengths
don't link; those of each length are searched on their own, one after another. A row with a null id likewise, with a null component. Rows that share an id
count as one vector (the greatest), repeated rows too. Other columns, whatever their names, are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinspark.llm.components import connected_components
from kinspark.llm.shared import map_arrow, stored

log = logging.getLogger(__name__)
_WINDOW_ROWS = 96
_BLOCK = 256
_CENTRES = 4096
_EDGE = "u long, v long, sim float"


def _rows(batch: pa.RecordBatch, column: str, kind: str) -> np.ndarray:
    """A binary column of equally long vectors as a matrix."""
    values = batch.column(column)
    if len(values) == 0:
        return np.zeros((0, 1), kind)
    return np.frombuffer(b"".join(values.to_pylist()), kind).reshape(len(values), -1)


def _units(dim: int):
    """(vec_id, key, unit): the vector of length 1 and a 128-bit key of its bytes; null where it can't link."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, units = [], []
            for v in batch.column("embedding"):
                x = None if not v.is_valid or len(v) != dim or v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                scale = float(np.abs(x).max()) if x is not None else 0.0
                if x is None or not np.isfinite(scale) or scale == 0.0:
                    keys.append(None)
                    units.append(None)
                    continue
                x = x / scale
                unit = (x / np.sqrt(x @ x)).tobytes()
                keys.append(hashlib.blake2b(unit, digest_size=16).digest())
                units.append(unit)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(units, pa.binary())], ["vec_id", "key", "unit"])

    return kernel, "vec_id long, key binary, unit binary"


def _orders(dim: int, tables: range, bits: int, seed: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = {t: np.random.Generator(np.random.PCG64([seed, t])).standard_normal((dim, bits + 1)) for t in tables}
        for batch in batches:
            x = _rows(batch, "unit", "<f8")
            if not len(x):
                continue
            small = pa.array([r.tobytes() for r in x.astype("<f4")], pa.binary())
            for t, p in planes.items():
                y = x @ p
                code = ((y[:, :bits] > 0) * (np.int64(1) << np.arange(bits - 1, -1, -1))).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(code), pa.array(y[:, bits]), batch.column("node"), small], ["t", "code", "along", "node", "unit"])

    return kernel, "t int, code long, along double, node long, unit binary"


def _best_in_windows(k: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("sim", pa.float32())])

    def compare(nodes: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        s = x @ x.T
        np.fill_diagonal(s, -2)
        m = min(k, len(nodes) - 1)
        best = np.argpartition(-s, m - 1, axis=1)[:, :m]
        u = np.repeat(nodes, m)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(nodes[best].ravel()), pa.array(np.take_along_axis(s, best, 1).ravel().astype(np.float32))], schema=schema)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while held.num_rows >= 2 * _WINDOW_ROWS:
                yield from cut(held.slice(0, _WINDOW_ROWS))
                held = held.slice(_WINDOW_ROWS)
        if held is not None:
            yield from cut(held)

    def cut(table: pa.Table) -> Iterator[pa.RecordBatch]:
        batch = table.combine_chunks().to_batches()
        for b in batch:
            t, nodes, x = b.column("t").to_numpy(), b.column("node").to_numpy(), _rows(b, "unit", "<f4")
            for one in np.unique(t).tolist():
                mine = t == one
                if mine.sum() > 1:
                    yield compare(nodes[mine], x[mine])

    return kernel, _EDGE


def _keep_best(edges: DataFrame, k: int) -> DataFrame:
    """At most k neighbours of each node. A pair found twice counts once."""
    distinct = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.col("sim").desc(), "v"))
    return distinct.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def _local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by the node u that lists them: compare the members of each list; give pairs that beat an end's worst entry."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("sim", pa.float32())])
    held: pa.Table | None = None

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for b in table.combine_chunks().to_batches():
            owner, member = b.column("u").to_numpy(), b.column("v").to_numpy()
            fresh = b.column("fresh").to_numpy(zero_copy_only=False)
            worst = b.column("worst").to_numpy()
            x = _rows(b, "unit", "<f4")
            cut = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]])
            us, vs, sims = [], [], []
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if hi - lo < 2 or not fresh[lo:hi].any():
                    continue
                s = x[lo:hi] @ x[lo:hi].T
                ok = (fresh[lo:hi, None] | fresh[None, lo:hi]) & (s > worst[lo:hi, None]) & (member[lo:hi, None] != member[None, lo:hi])
                i, j = np.nonzero(ok)
                us.append(member[lo + i])
                vs.append(member[lo + j])
                sims.append(s[i, j])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs)), pa.array(np.concatenate(sims).astype(np.float32))], schema=schema)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        owner = table.column("u").to_numpy()
        if not len(owner):
            continue
        at = int(np.searchsorted(owner, owner[-1]))  # the last list may go on; lists are at most 2k long
        held = table.slice(at)
        if at:
            yield from compare(table.slice(0, at))
    if held is not None:
        yield from compare(held)


def _round(graph: DataFrame, nodes: DataFrame, k: int, seed: int) -> DataFrame:
    worst = graph.groupBy("u").agg(F.when(F.count(F.lit(1)) >= k, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
    back = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "fresh")
    turn = F.row_number().over(Window.partitionBy("u").orderBy(F.xxhash64(F.lit(seed), "v"), "v"))
    back = back.withColumn("_turn", turn).where(F.col("_turn") <= k).drop("_turn")
    lists = graph.select("u", "v", "fresh").union(back).groupBy("u", "v").agg(F.max("fresh").alias("fresh"))
    sides = nodes.select(F.col("node").alias("v"), F.col("small").alias("unit")).join(worst.withColumnRenamed("u", "v"), "v")
    dealt = lists.join(sides, "v").select("u", "v", "fresh", "worst", "unit").repartition("u").sortWithinPartitions("u")
    found = map_arrow(dealt, _local_join, _EDGE)
    return _keep_best(graph.withColumn("fresh", F.lit(False)).unionByName(found.withColumn("fresh", F.lit(True))), k)


def _exact(threshold: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cosine = np.einsum("ij,ij->i", _rows(batch, "unit_a", "<f8"), _rows(batch, "unit_b", "<f8"))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=schema).filter(pa.array(cosine >= threshold))

    return kernel, "a long, b long"


def _pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (component, block) to one row a block: node ids, multiplicities, unit vectors. At most 2 * _BLOCK rows go into one."""
    names = ["component", "block", "nodes", "times", "units"]
    now: tuple[int, int] | None = None
    nodes: list[int] = []
    times: list[int] = []
    units: list[bytes] = []

    def close() -> pa.RecordBatch:
        cols = [[now[0]], [now[1]], [np.array(nodes, "<i8").tobytes()], [np.array(times, "<i8").tobytes()], [b"".join(units)]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names)

    for batch in batches:
        for c, b, n, t, u in zip(*(batch.column(x).to_pylist() for x in ("component", "block", "node", "times", "unit")), strict=True):
            if now != (c, b):
                if now is not None:
                    yield close()
                now, nodes, times, units = (c, b), [], [], []
            nodes.append(n)
            times.append(t)
            units.append(u)
    if now is not None:
        yield close()


def _count_blocks(threshold: float):
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                na, nb = np.frombuffer(row["nodes_a"], "<i8"), np.frombuffer(row["nodes_b"], "<i8")
                ta, tb = np.frombuffer(row["times_a"], "<i8"), np.frombuffer(row["times_b"], "<i8")
                a, b = np.frombuffer(row["units_a"], "<f8").reshape(len(na), -1), np.frombuffer(row["units_b"], "<f8").reshape(len(nb), -1)
                near = a @ b.T >= threshold
                if row["a"] == row["b"]:
                    np.fill_diagonal(near, False)
                    yield pa.RecordBatch.from_arrays([pa.array(na), pa.array(near @ tb)], schema=schema)
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([na, nb])), pa.array(np.concatenate([near @ tb, near.T @ ta]))], schema=schema)

    return kernel, "node long, links long"


def _whole_components(members: DataFrame, threshold: float) -> DataFrame:
    """(node, links) inside each component of ``members`` (component, node, times, unit), all members compared in blocks."""
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / _BLOCK).cast("long").alias("blocks"))
    dealt = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.select("component", "block", "node", "times", "unit").repartition("component", "block").sortWithinPartitions("component", "block", "node")
    blocks = stored(map_arrow(dealt, _pack_blocks, "component long, block long, nodes binary, times binary, units binary"), "nn_blocks")
    pairs = sizes.withColumn("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("b", F.explode(F.sequence(F.col("a"), F.col("blocks") - 1)))
    for side in ("a", "b"):
        pairs = pairs.join(blocks.select("component", F.col("block").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("nodes", "times", "units")]), ["component", side])
    kernel, schema = _count_blocks(threshold)
    return map_arrow(pairs.drop("blocks", "component"), kernel, schema).groupBy("node").agg(F.sum("links").alias("links"))


def _pack_balls(threshold: float):
    """Rows sorted by component to balls of at most _BLOCK rows: unit vectors, centre, the row nearest to it, and the least cosine with the centre that a link into the ball can have."""
    names = ["component", "ball", "units", "centre", "middle", "reach"]
    theta = float(np.arccos(np.clip(threshold, -1, 1)))

    def ball(component: int, nodes: list[int], units: list[bytes]) -> pa.RecordBatch:
        x = np.frombuffer(b"".join(units), "<f8").reshape(len(units), -1)
        mean = x.mean(0)
        length = float(np.sqrt(mean @ mean))
        centre = mean / length if length > 1e-6 else x[0]
        cosine = np.clip(x @ centre, -1, 1)
        angle = theta + float(np.arccos(cosine.min())) + 1e-6
        reach = float(np.cos(angle)) - 1e-9 if angle < np.pi else -2.0
        cols = [[component], [nodes[0]], [x.tobytes()], [centre.tobytes()], [units[int(cosine.argmax())]], [reach]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64()), strict=True)], names)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, units = None, [], []
        for batch in batches:
            for c, n, u in zip(*(batch.column(x).to_pylist() for x in ("component", "node", "unit")), strict=True):
                if nodes and (now != c or len(nodes) == _BLOCK):
                    yield ball(now, nodes, units)
                    nodes, units = [], []
                now = c
                nodes.append(n)
                units.append(u)
        if nodes:
            yield ball(now, nodes, units)

    return kernel, "component long, ball long, units binary, centre binary, middle binary, reach double"


def _within(rows: DataFrame, balls: DataFrame, point: str, reach: str | float) -> DataFrame:
    """(node, own, ball, component): rows (node, component, full, unit) and the balls of other components whose ``point`` has a cosine of at least ``reach``. Two full components meet from one side only."""
    dim_bytes = balls.select(F.max(F.length(point))).first()[0]
    chunk = min(_CENTRES, max(64, (8 << 20) // dim_bytes))
    chunks = -(-balls.count() // chunk)
    bound = F.col(reach) if isinstance(reach, str) else F.lit(reach)
    out = None
    for i in range(chunks):
        held = balls.where(F.pmod(F.xxhash64("ball"), F.lit(chunks)) == i).select("component", "ball", point, bound.alias("bound")).collect()
        if not held:
            continue
        component, ball, least = (np.array([r[c] for r in held]) for c in ("component", "ball", "bound"))
        points = np.stack([np.frombuffer(bytes(r[point]), "<f8") for r in held])

        def kernel(batches: Iterator[pa.RecordBatch], component=component, ball=ball, least=least, points=points) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                if not batch.num_rows:
                    continue
                node, own = batch.column("node").to_numpy(), batch.column("component").to_numpy()
                full = batch.column("full").to_numpy(zero_copy_only=False)
                other = np.where(full[:, None], component[None, :] < own[:, None], component[None, :] != own[:, None])
                r, c = np.nonzero((_rows(batch, "unit", "<f8") @ points.T >= least) & other)
                yield pa.RecordBatch.from_arrays([pa.array(node[r]), pa.array(own[r]), pa.array(ball[c]), pa.array(component[c])], ["node", "own", "ball", "component"])

        found = stored(map_arrow(rows, kernel, "node long, own long, ball long, component long"), "nn_within")
        out = found if out is None else out.unionByName(found)
    return out


def _linked_to_balls(rows: DataFrame, balls: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of components between which a row (node, component, full, unit) links with a member of a ball, all that can link compared."""
    near = _within(rows, balls, "centre", "reach")
    parts = near.groupBy("ball").agg(F.ceil(F.count(F.lit(1)) / _BLOCK).cast("long").alias("parts"))
    dealt = near.join(parts, "ball").join(rows.select("node", "unit"), "node")
    dealt = dealt.select(F.col("ball").alias("component"), F.pmod(F.xxhash64("node"), F.col("parts")).alias("block"), "node", F.col("own").alias("times"), "unit")
    dealt = dealt.repartition("component", "block").sortWithinPartitions("component", "block", "node")
    packed = map_arrow(dealt, _pack_blocks, "component long, block long, nodes binary, times binary, units binary")
    packed = packed.select(F.col("component").alias("ball"), F.col("times").alias("owners"), F.col("units").alias("rows"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own, members = np.frombuffer(row["owners"], "<i8"), row["units"]
                x = np.frombuffer(row["rows"], "<f8").reshape(len(own), -1)
                linked = np.unique(own[(x @ np.frombuffer(members, "<f8").reshape(-1, x.shape[1]).T >= threshold).any(1)])
                yield pa.RecordBatch.from_arrays([pa.array(linked), pa.array(np.full(len(linked), row["component"], np.int64))], ["a", "b"])

    return map_arrow(packed.join(balls.select("ball", "component", "units"), "ball"), kernel, "a long, b long").distinct()


def _merged(label: DataFrame, joins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``label`` (node, component) with components joined along ``joins`` (a, b), and the new component of each old one that has joined."""
    moved = connected_components(joins, "a", "b").select(F.col("node").alias("was"), F.col("component").alias("now"))
    old = label.join(moved, F.col("component") == F.col("was"), "left").select("node", F.coalesce("now", "component").alias("component"))
    new = moved.join(label.select(F.col("node").alias("was")), "was", "left_anti").select(F.col("was").alias("node"), F.col("now").alias("component"))
    return stored(old.unionByName(new), "nn_label"), moved


def _join_outside(nodes: DataFrame, label: DataFrame, full: DataFrame, threshold: float, dim: int) -> tuple[DataFrame, bool]:
    """``label`` after the components of ``full`` (component) were compared with all rows outside them, and whether any joined."""
    joined = False
    of = nodes.select("node", "unit").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = stored(of.join(full.withColumn("full", F.lit(True)), "component", "left").select("node", "component", F.coalesce("full", F.lit(False)).alias("full"), "unit"), "nn_rows")
    kernel, schema = _orders(dim, range(1), 32, 0)
    along = map_arrow(rows.where("full").select("node", "unit"), kernel, schema).select("node", "code")
    dealt = rows.where("full").join(along, "node").repartitionByRange("component", "code", "node").sortWithinPartitions("component", "code", "node")
    kernel, schema = _pack_balls(threshold)
    balls = stored(map_arrow(dealt.select("component", "node", "unit"), kernel, schema), "nn_balls")
    middles = balls.select(F.col("ball").alias("node"), "component", F.lit(True).alias("full"), F.col("middle").alias("unit"))
    joins = stored(_within(middles, balls, "middle", threshold).select(F.col("own").alias("a"), F.col("component").alias("b")).distinct(), "nn_joins")
    if joins.limit(1).count():  # middles that link spare the comparison of their components' rows
        joined = True
        label, moved = _merged(label, joins)
        rename = lambda df: df.join(moved, F.col("component") == F.col("was"), "left").withColumn("component", F.coalesce("now", "component")).drop("was", "now")
        rows, balls = stored(rename(rows), "nn_rows"), stored(rename(balls), "nn_balls")
    joins = stored(_linked_to_balls(rows, balls, threshold), "nn_joins")
    if joins.limit(1).count():
        joined = True
        label, _ = _merged(label, joins)
    return label, joined


def _audit(nodes: DataFrame, found: DataFrame, saturated: DataFrame, threshold: float, audit_size: int, seed: int) -> float:
    """Share of a vector's true links that the search has, on average in the worst of three samples (all, linked, saturated nodes), by brute force against all rows."""
    order = [F.xxhash64(F.lit(seed), "node"), "node"]
    samples = [[r["node"] for r in df.select("node").orderBy(*order).limit(audit_size).collect()] for df in (nodes, found, saturated)]
    picked = sorted({n for s in samples for n in s})
    sample = nodes.where(F.col("node").isin(picked)).select("node", "unit").collect() if picked else []
    if not sample:
        return 1.0
    ids = np.array([r["node"] for r in sample])
    x = np.stack([np.frombuffer(bytes(r["unit"]), "<f8") for r in sample])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            if batch.num_rows:
                near = (x @ _rows(batch, "unit", "<f8").T >= threshold) & (ids[:, None] != batch.column("node").to_numpy()[None, :])
                total += near @ batch.column("times").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["node", "true_links"])

    true = map_arrow(nodes.select("node", "times", "unit"), kernel, "node long, true_links long").groupBy("node").agg(F.sum("true_links").alias("true_links"))
    got = true.join(found, "node", "left").where("true_links > 0").select("node", (F.least("true_links", F.coalesce("links", F.lit(0))) / F.col("true_links")).alias("share"))
    share = {r["node"]: r["share"] for r in got.collect()}
    means = [np.mean([share[n] for n in s if n in share]) for s in samples if any(n in share for n in s)]
    return float(min(means, default=1.0))


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.9, k: int = 10, tables: int = 5, max_rounds: int = 6, seed: int = 29,
    audit_size: int = 64, min_recall: float = 0.97, id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """One row per row of ``vectors``: (vec_id, n_links, component_id, kept)."""
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("embedding"))
    lengths = [r["d"] for r in raw.groupBy(F.size("embedding").alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).collect()]  # one row a length
    dim = lengths[0] if lengths else 1
    counts = raw.agg(F.count("vec_id"), F.count_distinct("vec_id")).first()
    if counts[0] > counts[1]:  # ids repeat: one vector each, then back to the rows
        one = raw.groupBy("vec_id").agg(F.max("embedding").alias("embedding"))
        found = near_duplicates(one, threshold, k, tables, max_rounds, seed, audit_size, min_recall, "vec_id", "embedding")
        found = found.withColumnRenamed("vec_id", "_vec")
        return raw.select("vec_id").join(found, F.col("vec_id").eqNullSafe(F.col("_vec"))).drop("_vec")
    if len(lengths) > 1:
        size, out = F.size("embedding"), None
        for d in lengths:  # null and empty vectors go with the most frequent length
            own_length = (size == d) if d != dim else (size.isNull() | (size <= 0) | (size == d))
            part = near_duplicates(raw.where(own_length), threshold, k, tables, max_rounds, seed, audit_size, min_recall, "vec_id", "embedding")
            out = part if out is None else out.unionByName(part)
        return out
    kernel, schema = _units(dim)
    units = stored(map_arrow(raw.repartition("vec_id"), kernel, schema), "nn_units")
    usable = units.where("key is not null and vec_id is not null")
    nodes = stored(usable.groupBy("key").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("times"), F.first("unit").alias("unit")), "nn_nodes")
    own = usable.select("vec_id", "key").join(nodes.select("key", "node"), "key").select("vec_id", "node")

    for attempt in range(3):
        edges = stored(_search(nodes, threshold, k << attempt, tables + 4 * attempt, max_rounds, seed + attempt, dim), "nn_edges")
        label, degree, saturated = _resolve(nodes, edges, threshold, k << attempt, dim)
        recall = _audit(nodes, degree, saturated, threshold, audit_size, seed)
        log.info("near duplicates: recall %.4f on samples of %d audited vectors with lists of %d", recall, audit_size, k << attempt)
        if recall >= min_recall:
            break
    else:
        label, degree, _ = _resolve(nodes, edges, threshold, k << attempt, dim, everything=True)
    rows = own.join(nodes.select("node", "times"), "node").join(degree, "node", "left").join(label, "node", "left")
    rows = rows.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    rest = units.where("key is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return rows.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _search(nodes: DataFrame, threshold: float, k: int, tables: int, max_rounds: int, seed: int, dim: int) -> DataFrame:
    n = nodes.count()
    bits = min(max((n // _WINDOW_ROWS).bit_length(), 1), 48)
    kernel, schema = _orders(dim, range(tables), bits, seed)
    dealt = map_arrow(nodes.select("node", "unit"), kernel, schema).repartitionByRange("t", "code", "along").sortWithinPartitions("t", "code", "along", "node")
    kernel, schema = _best_in_windows(k)
    graph = stored(_keep_best(map_arrow(dealt, kernel, schema).withColumn("fresh", F.lit(True)), k), "nn_graph")
    vectors = stored(nodes.select("node", _narrow("unit").alias("small")), "nn_small")
    for r in range(max_rounds):
        graph = stored(_round(graph, vectors, k, seed + r), "nn_graph")
        changed = graph.where("fresh").count()
        if changed <= 0.005 * n * k:
            break
    return graph.select("u", "v", "sim")


def _narrow(column: str):
    """The float32 bytes of a float64 vector."""

    @F.pandas_udf("binary")
    def narrow(values):  # noqa: ANN001, ANN202
        return values.map(lambda b: np.frombuffer(b, "<f8").astype("<f4").tobytes())

    return narrow(F.col(column))


def _resolve(nodes: DataFrame, edges: DataFrame, threshold: float, k: int, dim: int, everything: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node, component) of linked nodes, (node, links) of all that link, and the saturated nodes, whose components are compared with all rows (``everything``: all components are)."""
    near = edges.where(F.col("sim") >= threshold - 1e-4).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    for side in ("a", "b"):
        near = near.join(nodes.select(F.col("node").alias(side), F.col("unit").alias(f"unit_{side}")), side)
    kernel, schema = _exact(threshold)
    links = stored(map_arrow(near, kernel, schema), "nn_links")
    label = connected_components(links, "a", "b")
    both = links.union(links.select("b", "a"))
    times = nodes.select(F.col("node").alias("b"), "times")
    plain = both.join(times, "b").groupBy(F.col("a").alias("node")).agg(F.sum("times").alias("links"))
    saturated = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("worst")).where((F.col("n") >= k) & (F.col("worst") >= threshold - 1e-4))
    saturated = stored(nodes.select("node") if everything else saturated.select(F.col("u").alias("node")), "nn_saturated")
    more = saturated.limit(1).count() > 0
    while True:
        of = saturated.join(label, "node", "left").select(F.coalesce("component", "node").alias("component"))
        full = stored(of.distinct(), "nn_full")
        if not more:
            break
        label, more = _join_outside(nodes, label, full, threshold, dim)
    of = nodes.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    members = of.join(full, "component", "left_semi")
    whole = stored(_whole_components(members.select("component", "node", "times", "unit"), threshold), "nn_whole")
    whole = whole.where("links > 0")
    degree = whole.unionByName(plain.join(whole.select("node"), "node", "left_anti"))
    return label, stored(degree, "nn_degree"), saturated
