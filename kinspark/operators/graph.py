"""Graph operators on edge tables: components, closures, waves, propagation of matches to a fixpoint."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: what spark.checkpoint.dir names, else one in the warehouse, which they share too."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/kinspark-work"


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of a loop into the shared folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Written once into the shared folder and read back: unlike a checkpoint, computed once, and read by columns."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def forget(df: DataFrame) -> None:
    """Delete what ``stored`` wrote for ``df``; nothing that is still to be computed may read it."""
    jvm = df.sparkSession._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName().startswith("stored-"):
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def connected_labels(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable. Labels jump to the label of their label, so rounds grow with the logarithm of a chain."""
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(b, a)).where("x <> y").distinct()
    both = settle(both)
    label = settle(both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("x"), F.min("y")).alias("component")))
    for _ in range(max_rounds):
        near = both.join(label.select(F.col("node").alias("y"), "component"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("near"))
        step = label.join(near, "node", "left").withColumn("next", F.least("component", F.coalesce("near", "component")))
        jump = step.select(F.col("node").alias("via"), F.col("next").alias("far"))
        new = step.join(jump, step.next == jump.via, "left").select("node", F.col("component").alias("was"), F.least("next", F.coalesce("far", "next")).alias("component"))
        new = settle(new)
        if new.where("was <> component").limit(1).count() == 0:
            return new.select("node", "component")
        label = new.select("node", "component")
    raise RuntimeError("labels did not settle")


def ancestors(parents: DataFrame, start: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node): all nodes on the way up from ``start`` (node) along ``parents`` (node, parent), start included."""
    seen = settle(start.select("node").distinct())
    front = seen
    for _ in range(max_rounds):
        front = settle(front.join(parents, "node").select(F.col("parent").alias("node")).where("node is not null").distinct().join(seen, "node", "left_anti"))
        if front.limit(1).count() == 0:
            return seen
        seen = settle(seen.union(front))
    raise RuntimeError("closure did not settle")


def waves(nodes: DataFrame, edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, wave): a node's wave is the first in which all it depends on (src depends on dst) are settled; nodes on a cycle are forced last, with forced true."""
    edges = settle(edges.where("src <> dst").distinct())
    open_nodes = settle(nodes.select("node").distinct())
    out = None
    for level in range(max_rounds):
        blocked = edges.join(open_nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        ready = settle(open_nodes.join(blocked, "node", "left_anti").select("node", F.lit(level).cast("long").alias("wave"), F.lit(False).alias("forced")))
        if ready.limit(1).count() == 0:
            if open_nodes.limit(1).count():
                rest = open_nodes.select("node", F.lit(level).cast("long").alias("wave"), F.lit(True).alias("forced"))
                out = rest if out is None else out.unionByName(rest)
            return out if out is not None else ready
        out = ready if out is None else out.unionByName(ready)
        open_nodes = settle(open_nodes.join(ready, "node", "left_anti"))
    raise RuntimeError("waves did not end")


def propagate(
    old: DataFrame, new: DataFrame, matches: DataFrame, near_old: DataFrame, near_new: DataFrame, fixed: DataFrame, kinds: tuple[str, ...] = ("callee", "caller", "scopeParent", "externalRefs"),
    max_iterations: int = 10,
) -> DataFrame:
    """(old_id, new_id, round, rung): ambiguous records identified by their matched neighbours until nothing changes.

    Records have id, bucket, parent and pos; an open record's pool are the unclaimed fresh records of its bucket.
    ``near_*`` (id, kind, near) are its neighbours; a neighbour is known through ``matches`` (old_id, new_id), which grow,
    or through ``fixed`` (kind, near, mapped). Kind by kind, in order: without a known neighbour there is no evidence and
    the pool stays; else only candidates stay that have all of them mapped; none left is a contradiction and ends the
    record's round; one left closes it, with the kind as its rung. A pool that is still open is decided by position among
    the records of its bucket under a matched parent (rung scopeOrdinal), where both parents have equally many.
    A pool of one without evidence is no match.

    Pools are never enumerated: candidates come from the neighbours' side, so cost follows the evidence, not the buckets.
    Rounds are synchronous, and a fresh record claimed twice in a round stays open.
    """
    kind = F.col("kind")
    old, new, near_old, near_new, fixed = (settle(x) for x in (old.select("id", "bucket", "parent", "pos"), new.select("id", "bucket", "parent", "pos"), near_old.distinct(), near_new.distinct(), fixed))
    rank = lambda df: df.where("parent is not null").select("id", "bucket", "parent", F.row_number().over(Window.partitionBy("parent", "bucket").orderBy("pos", "id")).alias("_k"), F.count(F.lit(1)).over(Window.partitionBy("parent", "bucket")).alias("_n"))
    sib_old, sib_new = settle(rank(old)), settle(rank(new))
    known = settle(matches.select("old_id", "new_id", F.lit(0).alias("round"), F.lit("given").alias("rung")))
    per_old = Window.partitionBy("old_id")
    for r in range(1, max_iterations + 1):
        open_old = old.join(known.select(F.col("old_id").alias("id")), "id", "left_anti").select(F.col("id").alias("old_id"), "bucket")
        free = new.join(known.select(F.col("new_id").alias("id")), "id", "left_anti").select(F.col("id").alias("new_id"), "bucket")
        sizes = free.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n0"))
        mapped = near_old.join(known.select(F.col("old_id").alias("near"), F.col("new_id").alias("mapped")), "near").select("id", "kind", "mapped")
        mapped = mapped.unionByName(near_old.join(fixed, ["kind", "near"]).select("id", "kind", "mapped")).withColumnRenamed("id", "old_id").distinct()
        expected = settle(mapped.join(open_old.join(sizes, "bucket"), "old_id"))
        wanted = expected.groupBy("old_id").agg(*[F.count_if(kind == k).alias(f"_e{i}") for i, k in enumerate(kinds)])
        hits = expected.join(near_new.select(F.col("id").alias("new_id"), "kind", F.col("near").alias("mapped")), ["kind", "mapped"]).join(free, ["new_id", "bucket"])
        pairs = hits.groupBy("old_id", "new_id", "_n0").agg(*[F.count_if(kind == k).alias(f"_h{i}") for i, k in enumerate(kinds)]).join(wanted, "old_id")
        passes, evidence, size = F.lit(True), F.lit(False), F.col("_n0")
        closed, rung, target = F.lit(False), F.lit(None).cast("string"), F.lit(False)
        for i, k in enumerate(kinds):
            asked = F.col(f"_e{i}") > 0
            passes = passes & (~asked | (F.col(f"_h{i}") == F.col(f"_e{i}")))
            evidence = evidence | asked
            pairs = pairs.withColumn(f"_q{i}", passes).withColumn(f"_s{i}", F.when(evidence, F.count_if(F.col(f"_q{i}")).over(per_old)).otherwise(size))
            now = ~closed & asked & (F.col(f"_s{i}") == 1)
            rung = F.coalesce(rung, F.when(now, F.lit(k)))
            target = F.when(now, F.col(f"_q{i}")).otherwise(target)
            closed = closed | now
        last = len(kinds) - 1
        pairs = settle(pairs.select("old_id", "new_id", closed.alias("closed"), target.alias("target"), rung.alias("rung"), F.col(f"_q{last}").alias("stays")))
        found = pairs.where("closed and target").select("old_id", "new_id", "rung")
        parents = expected.where(kind == "scopeParent").select(F.col("old_id").alias("id"), F.col("mapped").alias("parent_new"))
        beside = sib_old.join(parents, "id").select(F.col("id").alias("old_id"), "bucket", F.col("parent_new").alias("parent"), "_k", "_n")
        beside = beside.join(sib_new.withColumnRenamed("id", "new_id"), ["parent", "bucket", "_k", "_n"]).select("old_id", "new_id")
        ordinal = beside.join(pairs.where("stays and not closed").select("old_id", "new_id"), ["old_id", "new_id"]).select("old_id", "new_id", F.lit("scopeOrdinal").alias("rung"))
        claims = F.count(F.lit(1)).over(Window.partitionBy("new_id"))
        one = found.unionByName(ordinal).withColumn("_claims", claims).where("_claims = 1")
        one = settle(one.select("old_id", "new_id", F.lit(r).alias("round"), "rung"))
        if one.limit(1).count() == 0:
            break
        known = settle(known.unionByName(one))
    return known


def wave_sizes(nodes: DataFrame, edges: DataFrame, max_waves: int = 100_000) -> DataFrame:
    """(wave, n, deadlocked): size of every wave, and in a row without wave, if there are any, of the nodes on or behind cycles. One job a wave."""
    edges = settle(edges.where("src <> dst").distinct())
    open_nodes = settle(nodes.select("node").distinct())
    sizes, before = [], open_nodes.count()
    while before and len(sizes) < max_waves:
        blocked = edges.join(open_nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        open_nodes = settle(open_nodes.join(blocked, "node", "left_semi"))
        after = open_nodes.count()
        if after == before:
            sizes.append((None, before, True))
            break
        sizes.append((len(sizes), before - after, False))
        before = after
    else:
        if before:
            raise RuntimeError("waves did not end")
    return nodes.sparkSession.createDataFrame(sizes, "wave long, n long, deadlocked boolean")


def nearest_topological(rows: DataFrame, group: str) -> DataFrame:
    """(group, node, place, forced): always the node with the lowest desired rank, then id, whose constraints (array ``after``) are placed.

    Constraints on nodes outside the group don't hold it up. Where a cycle leaves none free, the lowest of all that are
    left is placed all the same and marked as forced. Sequential inside a group, groups in parallel.
    """
    import heapq

    import pandas as pd

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        rank = dict(zip(pdf["node"], pdf["rank"], strict=True))
        wait: dict[int, int] = {}
        follow: dict[int, list[int]] = {}
        for n, after in zip(pdf["node"], pdf["after"], strict=True):
            need = {int(a) for a in (after if after is not None else ()) if int(a) in rank and int(a) != n}
            wait[n] = len(need)
            for a in need:
                follow.setdefault(a, []).append(n)
        ready = [(rank[n], n) for n in wait if wait[n] == 0]
        held = [(rank[n], n) for n in wait]
        heapq.heapify(ready)
        heapq.heapify(held)
        out, placed = [], set()
        while held:
            forced = not ready
            _, n = heapq.heappop(held if forced else ready)
            if n in placed:
                continue
            placed.add(n)
            out.append((n, forced))
            for m in follow.get(n, ()):
                wait[m] -= 1
                if wait[m] == 0 and m not in placed:
                    heapq.heappush(ready, (rank[m], m))
            while held and held[0][1] in placed:
                heapq.heappop(held)
        return pd.DataFrame({group: [pdf[group].iloc[0]] * len(out), "node": [n for n, _ in out], "place": range(len(out)), "forced": [f for _, f in out]})

    return rows.groupBy(group).applyInPandas(order, f"{group} long, node long, place long, forced boolean")


def order_constraints(accesses: DataFrame, key: str, node: str, mode: str) -> DataFrame:
    """(key, node, after, reason): what must come first. ``mode`` is read, write or effect; ``node`` gives the order.

    RAW and WAW: after the last write before; WAR: a write after the reads since the one before it; BARRIER: an effect
    after all since the last effect, and all after the effect before them. Each access has at most four such edges.
    """
    before = Window.partitionBy(key).orderBy(node).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(key).orderBy(node).rowsBetween(1, Window.unboundedFollowing)
    is_write, is_effect = F.col(mode) == "write", F.col(mode) == "effect"
    last = lambda cond: F.last(F.when(cond, F.col(node)), ignorenulls=True).over(before)
    following = lambda cond: F.first(F.when(cond, F.col(node)), ignorenulls=True).over(ahead)
    at = accesses.select(key, F.col(node).alias("node"), F.col(mode).alias("mode"), last(is_write).alias("lw"), following(is_write).alias("nw"), last(is_effect).alias("le"), following(is_effect).alias("ne"))
    edge = lambda cond, n, a, reason: F.when(cond & F.col(n).isNotNull() & F.col(a).isNotNull(), F.struct(F.col(n).alias("node"), F.col(a).alias("after"), reason.alias("reason")))
    mine = F.col("mode")
    edges = F.array(
        edge(mine.isin("read", "write"), "node", "lw", F.when(mine == "write", "WAW").otherwise("RAW")), edge(mine == "read", "nw", "node", F.lit("WAR")),
        edge(F.lit(True), "node", "le", F.lit("BARRIER")), edge(mine != "effect", "ne", "node", F.lit("BARRIER")),
    )
    return at.select(key, F.explode(F.filter(edges, lambda x: x.isNotNull())).alias("x")).select(key, "x.*")
