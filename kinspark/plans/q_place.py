"""Queries: placement tiers, graphs, waves, propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinspark.functions import scalars
from kinspark.operators import gates, graph, placement
from kinspark.plans.common import UNITS, sides, t, units
from kinspark.plans.q_sets import _ANCHOR, anchors
from kinspark.plans.registry import query

_REJECTED = r"""(len(list_filter(regexp_extract_all({0}, '[0-9]+'), lambda r: length(r) >= 2 AND r NOT IN ('8', '16', '32', '64', '128', '256', '512', '1024'))) > 0
  OR regexp_matches({0}, '^(?:no[-_]?ops?\w*|doNothing\w*|silent[-_]?noops?\w*|empty(?:function|callback|operation|handler)s?\d*|idle[-_]?operation\d*|initializeModule\d+|placeholder\w*|_+\d*|reactLib\d+|\w+Val\d*)$', 'i')
  OR regexp_matches({0}, '^(?:and|or|but|nor|the|an|a)(?:[A-Z0-9]|$)'))"""

_PLACE = _ANCHOR + """,
nm AS (
  SELECT id, side, source, unnest(names) AS name, unnest(generate_series(1, len(names))) AS pos FROM (
    SELECT id, side, source, [lang || CAST(n_chars % 90 AS VARCHAR)] || list_distinct(regexp_extract_all(text, '[A-Z][a-z]{3,}')[1:2]) AS names FROM u)),
hm AS (SELECT name, count(*) AS n, min(source) AS lo, max(source) AS hi FROM nm WHERE side = 0 GROUP BY name),
fc AS (SELECT name, count(*) AS m FROM nm WHERE side = 1 GROUP BY name),
pk AS (SELECT name, source, row_number() OVER (PARTITION BY name ORDER BY id, pos) AS k FROM nm WHERE side = 0),
fk AS (SELECT id, name, row_number() OVER (PARTITION BY name ORDER BY id, pos) AS k FROM nm WHERE side = 1),
cast_votes AS (
  SELECT fk.id, CASE WHEN lo = hi THEN lo WHEN n = m THEN pk.source END AS home, lo = hi AS same
  FROM fk JOIN hm USING (name) JOIN fc USING (name) LEFT JOIN pk ON pk.name = fk.name AND pk.k = fk.k),
votes AS (
  SELECT id, count(DISTINCT home) AS votes, CASE WHEN min(home) = max(home) THEN min(home) END AS name_vote,
    CASE WHEN min(home) FILTER (same) = max(home) FILTER (same) THEN min(home) FILTER (same) END AS allsame_vote, bool_or(NOT same) AS used_ordinal
  FROM cast_votes WHERE home IS NOT NULL GROUP BY id),
xs AS (SELECT lower(substr(name, 1, 5)) AS stem, min(name) AS prior_name FROM (SELECT DISTINCT name FROM nm WHERE side = 0) GROUP BY 1 HAVING count(*) = 1),
ys AS (SELECT lower(substr(name, 1, 5)) AS stem, min(name) AS name FROM (SELECT DISTINCT name FROM nm WHERE side = 1) GROUP BY 1 HAVING count(*) = 1),
mapped AS (SELECT nm.id, nm.name, lo AS home FROM nm JOIN ys USING (name) JOIN xs USING (stem) JOIN hm ON hm.name = xs.prior_name AND lo = hi WHERE side = 1),
ident AS (SELECT id, min(home) AS identity FROM mapped GROUP BY id HAVING min(home) = max(home)),
ident_real AS (SELECT id, min(home) AS identity_real FROM mapped WHERE NOT """ + _REJECTED.format("name") + """ GROUP BY id HAVING min(home) = max(home)),
minted AS (SELECT id, bool_and(len(list_filter(regexp_extract_all(name, '[0-9]+'), lambda r: length(r) >= 2 AND r NOT IN ('8', '16', '32', '64', '128', '256', '512', '1024'))) > 0) AS all_minted FROM nm GROUP BY id),
anc AS (
  SELECT b_id AS id, a.source AS anchor, len(list_filter(string_split(new_text, chr(10)), lambda l: NOT list_contains(string_split(old_text, chr(10)), l))) / greatest(len(string_split(new_text, chr(10))), 1) <= 0.1 AS near
  FROM anchored JOIN a ON a.id = a_id),
pa AS (SELECT h, count(*) AS na, min(source) AS lo, max(source) AS hi FROM a GROUP BY h), pb AS (SELECT h, count(*) AS nb FROM b GROUP BY h),
ht AS (SELECT h, CASE WHEN na = nb AND lo = hi THEN lo END AS home, CASE WHEN na IS NULL THEN 'absent' WHEN na <> nb THEN 'count' WHEN lo <> hi THEN 'split' END AS miss FROM pb LEFT JOIN pa USING (h)),
e AS (
  SELECT b.id, b.lang, CASE WHEN n_chars >= 60 THEN ht.home END AS t1, coalesce(votes, 0) AS votes, name_vote, allsame_vote, used_ordinal, identity,
    CASE WHEN identity_real <> name_vote THEN identity_real END AS t2, CASE WHEN (near OR all_minted) AND anc.anchor <> name_vote THEN anc.anchor END AS t3,
    CASE WHEN used_ordinal THEN name_vote END AS t4, CASE WHEN NOT used_ordinal THEN name_vote END AS t5, allsame_vote AS t6, CASE WHEN votes IS NULL THEN identity END AS t7, anc.anchor AS t8
  FROM b JOIN ht USING (h) LEFT JOIN votes USING (id) LEFT JOIN ident USING (id) LEFT JOIN ident_real USING (id) LEFT JOIN minted USING (id) LEFT JOIN anc USING (id)),
f AS (
  SELECT id, coalesce(last_value(coalesce({answers}) IGNORE NULLS) OVER (PARTITION BY lang ORDER BY id ROWS UNBOUNDED PRECEDING), (SELECT arg_min(source, id) FROM a)) AS home,
    CASE {labels} WHEN votes > 1 THEN 'conflict' ELSE 'novote' END AS tier, concat_ws(';', {trail}) AS trail FROM e)
"""
_TIERS = ("hash", "preempt", "anchorPreempt", "ordinal", "name", "allsame", "fill", "anchor")


def _place_sql(disabled: str = "") -> str:
    on = [(f"t{i}", name) for i, name in enumerate(_TIERS, 1) if name != disabled]
    parts = {
        "{answers}": ", ".join(c for c, _ in on), "{labels}": " ".join(f"WHEN {c} IS NOT NULL THEN '{n}'" for c, n in on), "{trail}": ", ".join(f"'{n}=' || {c}" for c, n in on),
    }
    out = _PLACE
    for k, v in parts.items():
        out = out.replace(k, v)
    return out.replace("WHEN votes > 1 THEN 'conflict' ", "") if disabled == "conflict" else out


def declared_names(u: DataFrame) -> DataFrame:
    """(id, side, source, pos, name): a slot name that counters make, and the first capitalised words of each document."""
    words = F.array_distinct(F.slice(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), F.lit(0)), 1, 2))
    names = F.concat(F.array(F.concat("lang", (F.col("n_chars") % 90).cast("string"))), words)
    return u.select("id", "side", "source", F.posexplode(names).alias("pos", "name"))


def _placed(spark: SparkSession, sf: str, disabled: frozenset[str] = frozenset()) -> DataFrame:
    u = units(spark, sf)
    a, b = sides(u)
    prior, fresh = (s.drop("side") for s in sides(declared_names(u)))
    votes = placement.statement_votes(prior, fresh.drop("source"), "source")
    stem = F.lower(F.substring("name", 1, 5)).alias("stem")
    x, y = (s.select("name").distinct().select(stem, "name") for s in (prior, fresh))
    matched = gates.unique_both_sides(x.withColumnRenamed("name", "prior_name"), y, "stem", "prior_name", "name").select("name", "prior_name")
    identity = placement.identity_votes(prior, fresh.drop("source"), matched, "source")
    real = placement.identity_votes(prior, fresh.drop("source").where(~scalars.is_rejected_stem(F.col("name"))), matched, "source").withColumnRenamed("identity", "identity_real")
    minted = fresh.groupBy("id").agg(F.bool_and(scalars.has_minted_number(F.col("name"))).alias("all_minted"))
    found = anchors(spark, sf).select("a_id", F.col("b_id").alias("id")).join(a.select(F.col("id").alias("a_id"), F.col("source").alias("anchor"), F.col("text").alias("old_text")), "a_id")
    hashes = placement.hash_tier(a, b, "h", "source").select("h", F.col("source").alias("hash_home"))
    rows = b.join(hashes, "h")
    for side in (votes, identity, real, minted, found.drop("a_id")):
        rows = rows.join(side, "id", "left")
    strong = F.col("all_minted") | (scalars.changed_line_share(F.col("text"), F.col("old_text")) <= 0.1)
    rows = rows.withColumn("anchor_strong", F.when(strong, F.col("anchor"))).withColumn("shapeless", F.col("n_chars") < 60).drop("source", "text", "old_text")
    first = a.agg(F.min_by("source", "id")).first()[0]
    return placement.place_by_evidence(rows, ["lang"], "id", F.lit(first), disabled)


@query("placement_cascade", _place_sql() + " SELECT id, home, tier FROM f")
def placement_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """The home of each fresh record by the first of ten tiers with an answer."""
    return _placed(spark, sf).select("id", "home", "tier")


@query("placement_trails", _place_sql() + " SELECT id, tier, trail, len(list_distinct(list_transform(string_split(trail, ';'), lambda x: split_part(x, '=', 2)))) > 1 AS dissent FROM f")
def placement_trails(spark: SparkSession, sf: str) -> DataFrame:
    """What every tier said about each record, and whether two of them differ."""
    said = F.array_distinct(F.transform(F.split("trail", ";"), lambda x: F.split_part(x, F.lit("="), F.lit(2))))
    return _placed(spark, sf).select("id", "tier", "trail", (F.size(said) > 1).alias("dissent"))


@query("placement_stats", _place_sql() + " SELECT tier, count(*) AS n, tier IN ('conflict', 'novote') AS residue FROM f GROUP BY tier")
def placement_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _placed(spark, sf).groupBy("tier").agg(F.count(F.lit(1)).alias("n")).select("tier", "n", F.col("tier").isin("conflict", "novote").alias("residue"))


def _ablation(tier: str) -> None:
    @query(f"placement_without_{tier}", _place_sql(tier) + " SELECT id, home, tier FROM f")
    def ablated(spark: SparkSession, sf: str) -> DataFrame:
        return _placed(spark, sf, frozenset({tier})).select("id", "home", "tier")


for _tier in (*_TIERS, "conflict"):  # the cascade with one tier switched off
    _ablation(_tier)


@query(
    "hash_tier_misses",
    UNITS
    + """, pa AS (SELECT h, count(*) AS na, min(source) AS lo, max(source) AS hi FROM a GROUP BY h), fb AS (SELECT id, h, n_chars < 60 AS bare, count(*) OVER (PARTITION BY h) AS nb FROM b)
SELECT CASE WHEN bare THEN 'shapeless' WHEN na IS NULL THEN 'absent' WHEN na <> nb THEN 'count' WHEN lo <> hi THEN 'split' END AS miss, count(*) AS n, 'ledger' AS prior FROM fb LEFT JOIN pa USING (h) GROUP BY 1
UNION ALL SELECT 'no-prior-hashes', count(*), 'none' FROM b""",
)
def hash_tier_misses(spark: SparkSession, sf: str) -> DataFrame:
    """Why the hash tier placed a record or not, against a prior ledger with hashes and against one without."""
    a, b = sides(units(spark, sf))
    tier = placement.hash_tier(a, b, "h", "source").select("h", "miss")
    rows = b.join(tier, "h").select(F.when(F.col("n_chars") < 60, "shapeless").otherwise(F.col("miss")).alias("miss"))
    out = rows.groupBy("miss").agg(F.count(F.lit(1)).alias("n")).withColumn("prior", F.lit("ledger"))
    return out.unionByName(b.agg(F.count(F.lit(1)).alias("n")).select(F.lit("no-prior-hashes").alias("miss"), "n", F.lit("none").alias("prior")))


@query("identity_tier", UNITS + ", m AS (SELECT id, split_part(unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')), ' ', 1) AS name, source, side FROM u), home AS (SELECT name, min(source) AS source FROM m WHERE side = 0 GROUP BY name HAVING min(source) = max(source)), v AS (SELECT m.id, h.source FROM m JOIN home h USING (name) WHERE side = 1 GROUP BY ALL) SELECT id, min(source) AS home FROM v GROUP BY id HAVING count(*) = 1")
def identity_tier(spark: SparkSession, sf: str) -> DataFrame:
    """Names a record declares, mapped to their one prior home; the homes must be unanimous."""
    u = units(spark, sf)
    m = u.select("id", "side", "source", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), F.lit(0)))).alias("name"))
    home = m.where("side = 0").groupBy("name").agg(F.min("source").alias("home"), F.max("source").alias("hi")).where("home = hi").drop("hi")
    v = m.where("side = 1").join(home, "name").groupBy("id").agg(F.min("home").alias("home"), F.max("home").alias("hi"))
    return v.where("home = hi").select("id", "home")


@query("graph_edges", "SELECT 'customer-order' AS kind, count(*) AS edges, count(DISTINCT o_custkey) AS sources FROM orders UNION ALL SELECT 'order-part', count(*), count(DISTINCT l_orderkey) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) UNION ALL SELECT 'part-supplier', count(*), count(DISTINCT l_partkey) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) UNION ALL SELECT 'nation-region', count(*), count(DISTINCT n_nationkey) FROM nation")
def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The edge kinds of the star schema's graph."""
    li, o, n = t(spark, sf, "lineitem"), t(spark, sf, "orders"), t(spark, sf, "nation")
    kinds = [("customer-order", o, "o_custkey", "o_orderkey"), ("order-part", li, "l_orderkey", "l_partkey"), ("part-supplier", li, "l_partkey", "l_suppkey"), ("nation-region", n, "n_nationkey", "n_regionkey")]
    out = None
    for kind, df, a, b in kinds:
        e = df.select(F.col(a).cast("long").alias("src"), F.col(b).cast("long").alias("dst")).distinct().agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("src").alias("sources"))
        e = e.select(F.lit(kind).alias("kind"), "edges", "sources")
        out = e if out is None else out.unionByName(e)
    return out


@query("graph_closure_check", "SELECT 'orders' AS edge, count(*) AS dangling FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'lineitem-part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'lineitem-supplier', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)")
def graph_closure_check(spark: SparkSession, sf: str) -> DataFrame:
    """Every edge must end in a vertex: anti-joins that should be empty."""
    li, o = t(spark, sf, "lineitem"), t(spark, sf, "orders")
    checks = [("orders", o, "o_custkey", "customer", "c_custkey"), ("lineitem-part", li, "l_partkey", "part", "p_partkey"), ("lineitem-supplier", li, "l_suppkey", "supplier", "s_suppkey")]
    out = None
    for name, df, k, vertex, key in checks:
        n = df.join(t(spark, sf, vertex), df[k] == F.col(key), "left_anti").agg(F.count(F.lit(1)).alias("dangling")).select(F.lit(name).alias("edge"), "dangling")
        out = n if out is None else out.unionByName(n)
    return out


@query(
    "relational_fingerprint",
    """WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem), shape AS (SELECT s_suppkey AS id, CAST(s_nationkey AS VARCHAR) || ':' || CAST(floor(s_acctbal / 1000) AS BIGINT) AS shape, n_regionkey AS region FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT src AS id, array_to_string(list_sort(list(shape)), ',') AS callees, array_to_string(list_sort(list(DISTINCT CAST(region AS VARCHAR))), ',') AS two_hop FROM e JOIN shape ON shape.id = dst GROUP BY src""",
)
def relational_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Shapes of a vertex's neighbours, duplicates kept, and the distinct shapes a second hop away."""
    e = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), "l_suppkey").distinct()
    s = t(spark, sf, "supplier").join(t(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    s = s.select("s_suppkey", F.concat(F.col("s_nationkey").cast("string"), F.lit(":"), F.floor(F.col("s_acctbal") / 1000).cast("string")).alias("shape"), F.col("n_regionkey").cast("string").alias("region"))
    return e.join(s, e.l_suppkey == s.s_suppkey).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("shape")), ",").alias("callees"), F.array_join(F.array_sort(F.collect_set("region")), ",").alias("two_hop"))


_REPLY = "WITH RECURSIVE e AS (SELECT event_id AS src, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS dst FROM events), w(node, wave) AS (SELECT src, 0 FROM e WHERE dst IS NULL UNION ALL SELECT e.src, w.wave + 1 FROM e JOIN w ON e.dst = w.node)"


def _order_chains(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders as nodes, each depending on the customer's order before it."""
    o = t(spark, sf, "orders")
    prev = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    e = o.select(F.col("o_orderkey").alias("src"), prev.alias("dst"))
    return o.select(F.col("o_orderkey").alias("node")), e.where("dst is not null")


@query(
    "wave_levels",
    """WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER w - 1 AS wave, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
l AS (SELECT *, o_custkey % 10 = 0 AND n > 1 AS stuck FROM o)
SELECT CASE WHEN stuck THEN NULL ELSE wave END AS wave, count(*) AS n, stuck AS deadlocked FROM l GROUP BY ALL""",
)
def wave_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Every wave of orders that depend on the customer's order before; for some customers the first depends on the last, and all of them are deadlocked."""
    nodes, edges = _order_chains(spark, sf)
    o = t(spark, sf, "orders").where("o_custkey % 10 = 0").groupBy("o_custkey").agg(F.min("o_orderkey").alias("src"), F.max("o_orderkey").alias("dst")).where("src <> dst")
    return graph.wave_sizes(nodes, edges.unionByName(o.select("src", "dst")))


@query("wave_sizes", "WITH o AS (SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS wave FROM orders) SELECT wave, count(*) AS n, false AS deadlocked FROM o GROUP BY wave")
def wave_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """The size of every wave of the customers' orders; nodes on cycles would be counted apart."""
    return graph.wave_sizes(*_order_chains(spark, sf))


@query("taint_closure", "SELECT r_regionkey AS node, 'region' AS kind FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal < 0) UNION SELECT 100 + n_nationkey, 'nation' FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal < 0 UNION SELECT 1000 + s_suppkey, 'supplier' FROM supplier WHERE s_acctbal < 0")
def taint_closure(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers in debt taint all that encloses them: closure along the parent edges."""
    s, n = t(spark, sf, "supplier"), t(spark, sf, "nation")
    parents = s.select((F.col("s_suppkey") + 1000).alias("node"), (F.col("s_nationkey") + 100).cast("long").alias("parent")).unionByName(n.select((F.col("n_nationkey") + 100).cast("long").alias("node"), F.col("n_regionkey").cast("long").alias("parent")))
    found = graph.ancestors(parents, s.where("s_acctbal < 0").select((F.col("s_suppkey") + 1000).alias("node")))
    kind = F.when(F.col("node") < 100, "region").when(F.col("node") < 1000, "nation").otherwise("supplier")
    return found.select("node", kind.alias("kind"))


_ORDERS = """
WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus || '/' || o_orderpriority || '/' || CAST(floor(o_totalprice / 20000) AS BIGINT) AS bucket FROM orders),
oa AS (SELECT o_orderkey AS id, bucket, -o_custkey AS parent, o_orderkey AS pos FROM o),
ob AS (SELECT o_orderkey + 1000000000 AS id, bucket, -o_custkey - 1000000000 AS parent, o_orderkey AS pos FROM o WHERE o_orderkey % 17 <> 0),
fixed AS (
  SELECT 'scopeParent' AS kind, -c_custkey AS near, -c_custkey - 1000000000 AS mapped FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT 'externalRefs', 5000000000 + p_partkey, 5000000000 + p_partkey FROM part WHERE p_partkey % 5 = 0),
na AS (
  SELECT id, 'callee' AS kind, lead(id) OVER (PARTITION BY parent ORDER BY id) AS near FROM oa UNION SELECT id, 'caller', lag(id) OVER (PARTITION BY parent ORDER BY id) FROM oa
  UNION SELECT id, 'scopeParent', parent FROM oa UNION SELECT l_orderkey, 'externalRefs', 5000000000 + l_partkey FROM lineitem WHERE l_orderkey IN (SELECT id FROM oa)),
nb AS (
  SELECT id, 'callee' AS kind, lead(id) OVER (PARTITION BY parent ORDER BY id) AS near FROM ob UNION SELECT id, 'caller', lag(id) OVER (PARTITION BY parent ORDER BY id) FROM ob
  UNION SELECT id, 'scopeParent', parent FROM ob UNION SELECT l_orderkey + 1000000000, 'externalRefs', 5000000000 + l_partkey FROM lineitem WHERE l_orderkey + 1000000000 IN (SELECT id FROM ob)),
sa AS (SELECT id, bucket, parent, row_number() OVER (PARTITION BY parent, bucket ORDER BY pos, id) AS k, count(*) OVER (PARTITION BY parent, bucket) AS n FROM oa),
sb AS (SELECT id, bucket, parent, row_number() OVER (PARTITION BY parent, bucket ORDER BY pos, id) AS k, count(*) OVER (PARTITION BY parent, bucket) AS n FROM ob),
k0 AS (
  SELECT x.id AS old_id, y.id AS new_id, 0 AS round, 'given' AS rung FROM (SELECT bucket, min(id) AS id FROM oa GROUP BY 1 HAVING count(*) = 1) x
  JOIN (SELECT bucket, min(id) AS id FROM ob GROUP BY 1 HAVING count(*) = 1) y USING (bucket))"""
_KINDS = ("callee", "caller", "scopeParent", "externalRefs")


def _propagation_sql(rounds: int) -> str:
    """The fixpoint with every round written out."""
    out = _ORDERS
    for r in range(1, rounds + 1):
        k = f"k{r - 1}"
        stays = [" AND ".join(f"(e{j} = 0 OR h{j} = e{j})" for j in range(i + 1)) for i in range(4)]
        some = [" OR ".join(f"e{j} > 0" for j in range(i + 1)) for i in range(4)]
        out += f""",
x{r} AS MATERIALIZED (
  SELECT m.*, bucket, n0 FROM (
    SELECT na.id AS old_id, na.kind, new_id AS mapped FROM na JOIN {k} ON na.near = old_id UNION SELECT na.id, na.kind, fixed.mapped FROM na JOIN fixed USING (kind, near)) m
  JOIN oa ON oa.id = m.old_id JOIN (SELECT bucket, count(*) AS n0 FROM ob WHERE id NOT IN (SELECT new_id FROM {k}) GROUP BY 1) USING (bucket) WHERE m.old_id NOT IN (SELECT old_id FROM {k})),
p{r} AS MATERIALIZED (
  SELECT *, {', '.join(f"CASE WHEN {some[i]} THEN count(*) FILTER ({stays[i]}) OVER w ELSE n0 END AS s{i}" for i in range(4))}
  FROM (SELECT x.old_id, nb.id AS new_id, n0, {', '.join(f"count(*) FILTER (x.kind = '{c}') AS h{i}" for i, c in enumerate(_KINDS))}
    FROM x{r} x JOIN nb ON nb.kind = x.kind AND nb.near = x.mapped JOIN ob ON ob.id = nb.id AND ob.bucket = x.bucket WHERE nb.id NOT IN (SELECT new_id FROM {k}) GROUP BY ALL)
  JOIN (SELECT old_id, {', '.join(f"count(*) FILTER (kind = '{c}') AS e{i}" for i, c in enumerate(_KINDS))} FROM x{r} GROUP BY 1) USING (old_id) WINDOW w AS (PARTITION BY old_id)),
c{r} AS MATERIALIZED (
  SELECT *, CASE {' '.join(f"WHEN e{i} > 0 AND s{i} = 1 THEN '{c}'" for i, c in enumerate(_KINDS))} END AS rung,
    CASE {' '.join(f"WHEN e{i} > 0 AND s{i} = 1 THEN {stays[i]}" for i in range(4))} ELSE false END AS target, {stays[3]} AS stays FROM p{r}),
f{r} AS (
  SELECT old_id, new_id, rung FROM c{r} WHERE target
  UNION ALL SELECT c.old_id, c.new_id, 'scopeOrdinal' FROM sa JOIN x{r} x ON x.old_id = sa.id AND x.kind = 'scopeParent' JOIN sb ON sb.parent = x.mapped AND sb.bucket = sa.bucket AND sb.k = sa.k AND sb.n = sa.n
    JOIN c{r} c ON c.old_id = sa.id AND c.new_id = sb.id WHERE c.stays AND c.rung IS NULL),
k{r} AS MATERIALIZED (SELECT * FROM {k} UNION ALL SELECT old_id, new_id, {r}, rung FROM (SELECT *, count(*) OVER (PARTITION BY new_id) AS claims FROM f{r}) WHERE claims = 1)"""
    return out


def order_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, ...]:
    """Two snapshots of the orders (the second lacks some) as a graph: (old, new, given matches, neighbours of old, of new, fixed correspondences)."""
    o, li = t(spark, sf, "orders"), t(spark, sf, "lineitem")
    bucket = F.concat_ws("/", "o_orderstatus", "o_orderpriority", F.floor(F.col("o_totalprice") / 20000).cast("string"))
    shift = 1_000_000_000

    def snapshot(rows: DataFrame, by: int) -> tuple[DataFrame, DataFrame]:
        rec = rows.select((F.col("o_orderkey") + by).alias("id"), bucket.alias("bucket"), (-F.col("o_custkey") - by).alias("parent"), F.col("o_orderkey").alias("pos"))
        w = Window.partitionBy("parent").orderBy("id")
        near = rec.select("id", F.lit("callee").alias("kind"), F.lead("id").over(w).alias("near")).unionByName(rec.select("id", F.lit("caller").alias("kind"), F.lag("id").over(w).alias("near")))
        near = near.where("near is not null").unionByName(rec.select("id", F.lit("scopeParent").alias("kind"), F.col("parent").alias("near")))
        refs = li.join(rows.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
        return rec, near.unionByName(refs.select((F.col("l_orderkey") + by).alias("id"), F.lit("externalRefs").alias("kind"), (F.col("l_partkey") + 5_000_000_000).alias("near")))

    (old, near_old), (new, near_new) = snapshot(o, 0), snapshot(o.where("o_orderkey % 17 <> 0"), shift)
    c, p = t(spark, sf, "customer").where("c_custkey % 3 = 0"), t(spark, sf, "part").where("p_partkey % 5 = 0")
    fixed = c.select(F.lit("scopeParent").alias("kind"), (-F.col("c_custkey")).alias("near"), (-F.col("c_custkey") - shift).alias("mapped"))
    fixed = fixed.unionByName(p.select(F.lit("externalRefs").alias("kind"), (F.col("p_partkey") + 5_000_000_000).alias("near"), (F.col("p_partkey") + 5_000_000_000).alias("mapped")))
    given = gates.unique_both_sides(old.withColumnRenamed("id", "old_id"), new.withColumnRenamed("id", "new_id"), "bucket", "old_id", "new_id").select("old_id", "new_id")
    return old, new, given, near_old, near_new, fixed


@query("propagation_fixpoint", _propagation_sql(10) + " SELECT * FROM k10")
def propagation_fixpoint(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of two snapshots: the few with a bucket of their own identify their neighbours, those the next, for up to ten rounds."""
    return graph.propagate(*order_graph(spark, sf))


@query("propagation_rungs", _propagation_sql(10) + " SELECT round, rung, count(*) AS n, CAST(sum(CASE WHEN new_id = old_id + 1000000000 THEN 1 ELSE 0 END) AS BIGINT) AS truly FROM k10 GROUP BY ALL")
def propagation_rungs(spark: SparkSession, sf: str) -> DataFrame:
    """Which rung closed how many records in each round, and how many of them are the same order."""
    k = graph.propagate(*order_graph(spark, sf))
    return k.groupBy("round", "rung").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("new_id") == F.col("old_id") + 1_000_000_000).alias("truly"))


@query("co_importers", "WITH e AS (SELECT DISTINCT o_custkey AS importer, l_suppkey AS target FROM orders JOIN lineitem ON l_orderkey = o_orderkey), s AS (SELECT target, count(*) AS importers FROM e GROUP BY target), n AS (SELECT e.target, c_nationkey AS folder, count(*) AS votes FROM e JOIN customer ON c_custkey = importer GROUP BY ALL) SELECT target, importers, folder, votes FROM n JOIN s USING (target) WHERE votes >= 0.05 * importers")
def co_importers(spark: SparkSession, sf: str) -> DataFrame:
    """Folders (nations) that hold a share of a target's importers."""
    o, li, c = (t(spark, sf, x) for x in ("orders", "lineitem", "customer"))
    e = o.join(li, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("importer"), F.col("l_suppkey").alias("target")).distinct()
    s = e.groupBy("target").agg(F.count(F.lit(1)).alias("importers"))
    n = e.join(c, F.col("c_custkey") == F.col("importer")).groupBy("target", F.col("c_nationkey").alias("folder")).agg(F.count(F.lit(1)).alias("votes"))
    return n.join(s, "target").where(F.col("votes") >= 0.05 * F.col("importers")).select("target", "importers", "folder", "votes")


@query("folder_consensus", "WITH e AS (SELECT DISTINCT o_custkey AS importer, l_suppkey AS target FROM orders JOIN lineitem ON l_orderkey = o_orderkey), n AS (SELECT target, r_name AS folder, count(*) AS votes FROM e JOIN customer ON c_custkey = importer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL) SELECT target, first(folder ORDER BY votes DESC, folder) AS folder, max(votes) >= 0.5 * sum(votes) AS agreed FROM n GROUP BY target")
def folder_consensus(spark: SparkSession, sf: str) -> DataFrame:
    """A target goes to the folder most of its importers are in; ties by folder name."""
    o, li, c, n, r = (t(spark, sf, x) for x in ("orders", "lineitem", "customer", "nation", "region"))
    e = o.join(li, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("importer"), F.col("l_suppkey").alias("target")).distinct()
    where = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey")).select("c_custkey", F.col("r_name").alias("folder"))
    v = e.join(where, F.col("c_custkey") == F.col("importer")).groupBy("target", "folder").agg(F.count(F.lit(1)).alias("votes"))
    return v.groupBy("target").agg(F.min(F.struct(-F.col("votes"), "folder")).getField("folder").alias("folder"), (F.max("votes") >= 0.5 * F.sum("votes")).alias("agreed"))


_ACCESS = """WITH a AS (SELECT user_id, event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'write' WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'effect' ELSE 'read' END AS mode FROM events),
x AS (
  SELECT *, last_value(CASE WHEN mode = 'write' THEN event_id END IGNORE NULLS) OVER p AS lw, last_value(CASE WHEN mode = 'effect' THEN event_id END IGNORE NULLS) OVER p AS le,
    first_value(CASE WHEN mode = 'write' THEN event_id END IGNORE NULLS) OVER n AS nw, first_value(CASE WHEN mode = 'effect' THEN event_id END IGNORE NULLS) OVER n AS ne
  FROM a WINDOW p AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), n AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
"""


def _accesses(spark: SparkSession, sf: str) -> DataFrame:
    """Events as reads, writes and effects of their user's state."""
    kind = F.col("event_type")
    mode = F.when(kind.isin("purchase", "signup"), "write").when((kind == "error") & (F.col("event_id") % 4 == 0), "effect").otherwise("read")
    return t(spark, sf, "events").select("user_id", "event_id", mode.alias("mode"), "value")


@query(
    "load_order_edges",
    _ACCESS
    + """SELECT user_id, event_id AS node, lw AS after, CASE WHEN mode = 'write' THEN 'WAW' ELSE 'RAW' END AS reason FROM x WHERE mode <> 'effect' AND lw IS NOT NULL
UNION ALL SELECT user_id, nw, event_id, 'WAR' FROM x WHERE mode = 'read' AND nw IS NOT NULL
UNION ALL SELECT user_id, event_id, le, 'BARRIER' FROM x WHERE le IS NOT NULL
UNION ALL SELECT user_id, ne, event_id, 'BARRIER' FROM x WHERE mode <> 'effect' AND ne IS NOT NULL""",
)
def load_order_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Order constraints: reads and writes after writes, writes after reads, and effects as barriers."""
    return graph.order_constraints(_accesses(spark, sf), "user_id", "event_id", "mode")


@query("constrained_order")
def constrained_order(spark: SparkSession, sf: str) -> DataFrame:
    """Topological order nearest to the desired ranks, per user, under all constraints. A greedy choice, step by step: tests compare it with one done in full."""
    e = _accesses(spark, sf)
    after = graph.order_constraints(e, "user_id", "event_id", "mode").groupBy("node").agg(F.collect_set("after").alias("after"))
    rows = e.select("user_id", F.col("event_id").alias("node"), F.col("value").alias("rank")).join(after, "node", "left")
    return graph.nearest_topological(rows, "user_id")


@query(
    "constrained_order_holds",
    _ACCESS + "SELECT CAST(count(*) AS BIGINT) AS nodes, CAST(0 AS BIGINT) AS broken, CAST(0 AS BIGINT) AS forced FROM a",
)
def constrained_order_holds(spark: SparkSession, sf: str) -> DataFrame:
    """Every node has a place and no constraint is broken."""
    placed = constrained_order(spark, sf)
    edges = load_order_edges(spark, sf).select("node", "after")
    at = placed.select(F.col("node"), F.col("place").alias("here")), placed.select(F.col("node").alias("after"), F.col("place").alias("there"))
    broken = edges.join(at[0], "node", "left").join(at[1], "after", "left").agg(F.count_if(~F.coalesce(F.col("there") < F.col("here"), F.lit(False))).alias("broken"))
    return placed.agg(F.count(F.lit(1)).alias("nodes"), F.count_if("forced").alias("forced")).crossJoin(broken).select("nodes", "broken", "forced")


@query("components", "WITH RECURSIVE e AS (SELECT DISTINCT p_size AS x, CAST(substr(p_brand, -1) AS INT) + 1000 AS y FROM part WHERE regexp_matches(p_brand, '[0-9]$')), b AS (SELECT x, y FROM e UNION SELECT y, x FROM e), r(a, b) AS (SELECT x, x FROM b UNION SELECT r.a, b.y FROM r JOIN b ON r.b = b.x) SELECT a AS node, min(b) AS component FROM r GROUP BY a")
def components(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "part").where(F.col("p_brand").rlike("[0-9]$")).select(F.col("p_size").cast("long").alias("x"), (F.expr("substr(p_brand, -1)").cast("long") + 1000).alias("y")).distinct()
    return graph.connected_labels(e, "x", "y")
