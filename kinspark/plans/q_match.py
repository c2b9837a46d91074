"""Queries: buckets, twins, ordinal pairing, cascades and accounting of matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinspark.functions import scalars
from kinspark.operators import gates, matching
from kinspark.plans.common import UNITS, sides, t, units
from kinspark.plans.registry import query

_TWINS = UNITS + """,
ca AS (SELECT h, count(*) AS n FROM a GROUP BY h), cb AS (SELECT h, count(*) AS n, min(id) AS new_id FROM b GROUP BY h),
twins AS (
  SELECT a.id AS old_id, CASE WHEN ca.n = 1 AND cb.n = 1 THEN cb.new_id END AS new_id,
    CASE WHEN cb.n IS NULL THEN 'unmatched' WHEN ca.n = 1 AND cb.n = 1 THEN 'unique' ELSE 'ambiguous' END AS tier
  FROM a JOIN ca USING (h) LEFT JOIN cb USING (h))
"""


def _twins(spark: SparkSession, sf: str) -> DataFrame:
    a, b = sides(units(spark, sf))
    return matching.twin_match(a, b, "h")


@query("exact_twin_match", _TWINS + "SELECT * FROM twins")
def exact_twin_match(spark: SparkSession, sf: str) -> DataFrame:
    return _twins(spark, sf)


@query(
    "match_rate",
    _TWINS
    + """SELECT count(new_id) AS matched, count(*) FILTER (tier = 'ambiguous') AS ambiguous, count(*) FILTER (tier = 'unmatched') AS unmatched,
  count(*) AS total, CASE WHEN count(*) = 0 THEN 0.0 ELSE count(new_id) / count(*) END AS rate FROM twins""",
)
def match_rate(spark: SparkSession, sf: str) -> DataFrame:
    return matching.match_rate(_twins(spark, sf))


@query("resolution_stats", _TWINS + "SELECT tier, count(*) AS n FROM twins GROUP BY tier")
def resolution_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _twins(spark, sf).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query("bucket_join", UNITS + " SELECT a.id AS old_id, b.id AS new_id FROM a JOIN b USING (h)")
def bucket_join(spark: SparkSession, sf: str) -> DataFrame:
    a, b = sides(units(spark, sf))
    return matching.bucket_candidates(a, b, "h")


@query("bucket_join_excluding", UNITS + " SELECT a.id AS old_id, b.id AS new_id FROM a JOIN b USING (h) WHERE a.id NOT IN (SELECT doc_id FROM labels) AND b.id NOT IN (SELECT doc_id FROM labels)")
def bucket_join_excluding(spark: SparkSession, sf: str) -> DataFrame:
    u = units(spark, sf)
    a, b = sides(u.join(t(spark, sf, "labels").select(F.col("doc_id").alias("id")), "id", "left_anti"))
    return matching.bucket_candidates(a, b, "h")


@query("unmatched_old", UNITS + " SELECT id AS old_id, source FROM a WHERE h NOT IN (SELECT h FROM b)")
def unmatched_old(spark: SparkSession, sf: str) -> DataFrame:
    a, b = sides(units(spark, sf))
    return a.join(b.select("h"), "h", "left_anti").select(F.col("id").alias("old_id"), "source")


@query("new_records", UNITS + " SELECT id AS new_id FROM b WHERE h NOT IN (SELECT h FROM a)")
def new_records(spark: SparkSession, sf: str) -> DataFrame:
    """Fresh records that no prior one matches or has among its candidates."""
    a, b = sides(units(spark, sf))
    pairs = matching.bucket_candidates(a, b, "h").select("new_id").distinct()
    return b.select(F.col("id").alias("new_id")).join(pairs, "new_id", "left_anti")


@query("close_match_pool", _TWINS + " SELECT id AS new_id FROM b WHERE id NOT IN (SELECT new_id FROM twins WHERE new_id IS NOT NULL)")
def close_match_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Fresh records left for the fuzzy tiers: not matched, though they may be candidates of ambiguous rows."""
    _, b = sides(units(spark, sf))
    done = _twins(spark, sf).where("new_id is not null").select("new_id")
    return b.select(F.col("id").alias("new_id")).join(done, "new_id", "left_anti")


@query(
    "ordinal_pairing",
    UNITS
    + """,
k AS (SELECT h FROM (SELECT h, count(*) AS n FROM a GROUP BY h) JOIN (SELECT h, count(*) AS n FROM b GROUP BY h) USING (h, n)),
ra AS (SELECT h, id, row_number() OVER (PARTITION BY h ORDER BY n_chars, id) AS r FROM a WHERE h IN (SELECT h FROM k)),
rb AS (SELECT h, id, row_number() OVER (PARTITION BY h ORDER BY n_chars, id) AS r FROM b WHERE h IN (SELECT h FROM k))
SELECT ra.id AS old_id, rb.id AS new_id FROM ra JOIN rb USING (h, r)""",
)
def ordinal_pairing(spark: SparkSession, sf: str) -> DataFrame:
    a, b = sides(units(spark, sf))
    return matching.ordinal_pairs(a, b, ["h"], ["n_chars", "id"])


_CONTEXT = UNITS + """,
n AS (
  SELECT id, side, h, source, lag(h) OVER w AS p, lead(h) OVER w AS q FROM u WINDOW w AS (PARTITION BY source, side ORDER BY id)),
c AS (SELECT *, CASE WHEN p IS NULL AND q IS NULL THEN NULL ELSE coalesce(p, '^') || '|' || coalesce(q, '$') END AS context FROM n)
"""


def _contexts(spark: SparkSession, sf: str) -> DataFrame:
    u = units(spark, sf).withColumn("g", F.concat_ws("/", "source", F.col("side").cast("string")))
    return matching.neighbor_context(u, "g", "id", "h")


@query("neighbor_context", _CONTEXT + "SELECT id, context FROM c")
def neighbor_context(spark: SparkSession, sf: str) -> DataFrame:
    return _contexts(spark, sf).select("id", "context")


@query(
    "context_pairing",
    _CONTEXT
    + """,
v AS (SELECT id, side, h, source, row_number() OVER (PARTITION BY side, h, source ORDER BY id) AS r FROM c),
k AS (SELECT h, source FROM (SELECT h, source, count(*) AS n FROM v WHERE side = 0 GROUP BY ALL) JOIN (SELECT h, source, count(*) AS n FROM v WHERE side = 1 GROUP BY ALL) USING (h, source, n))
SELECT x.id AS old_id, y.id AS new_id FROM v x JOIN v y USING (h, source, r) JOIN k USING (h, source) WHERE x.side = 0 AND y.side = 1""",
)
def context_pairing(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs by (hash, enclosing source, rank) where both sides hold the pair of keys equally often."""
    a, b = sides(_contexts(spark, sf))
    return matching.ordinal_pairs(a, b, ["h", "source"], ["id"])


@query(
    "statement_twins",
    UNITS
    + """,
s AS (SELECT h, count(*) FILTER (side = 0) AS na, count(*) FILTER (side = 1) AS nb FROM u GROUP BY h),
one AS (SELECT x.id AS old_id, y.id AS new_id, 'hash' AS tier FROM a x JOIN b y USING (h) JOIN s USING (h) WHERE na = 1 AND nb = 1),
r AS (SELECT h, lang, count(*) FILTER (side = 0) AS ra, count(*) FILTER (side = 1) AS rb FROM u GROUP BY h, lang),
two AS (
  SELECT x.id AS old_id, y.id AS new_id, 'reference' AS tier FROM a x JOIN b y USING (h, lang) JOIN s USING (h) JOIN r USING (h, lang)
  WHERE na = nb AND na > 1 AND ra = 1 AND rb = 1)
SELECT * FROM one UNION ALL SELECT * FROM two""",
)
def statement_twins(spark: SparkSession, sf: str) -> DataFrame:
    """Hashes that occur once on each side; in buckets of equal size, records whose reference key (language) is claimed once a side."""
    a, b = sides(units(spark, sf))
    one = gates.unique_both_sides(a.withColumnRenamed("id", "old_id"), b.withColumnRenamed("id", "new_id"), "h", "old_id", "new_id")
    shared = gates.equal_count_keys(a, b, ["h"]).where("n > 1").select("h")
    x, y = (s.join(shared, "h", "left_semi").withColumn("k", F.concat_ws("/", "h", "lang")) for s in (a, b))
    two = gates.unique_both_sides(x.withColumnRenamed("id", "old_id"), y.withColumnRenamed("id", "new_id"), "k", "old_id", "new_id")
    return one.select("old_id", "new_id", F.lit("hash").alias("tier")).unionByName(two.select("old_id", "new_id", F.lit("reference").alias("tier")))


@query(
    "module_context_twins",
    """
WITH s AS (SELECT conv_id, string_agg(role, '-' ORDER BY turn) AS signature, count(*) AS n FROM conversations GROUP BY conv_id),
one AS (
  SELECT x.conv_id AS old_conv, y.conv_id AS new_conv FROM
    (SELECT signature || '/' || first_len AS k, min(conv_id) AS conv_id FROM (SELECT s.*, (SELECT min(length(text)) FROM conversations c WHERE c.conv_id = s.conv_id AND turn = 0) AS first_len FROM s WHERE conv_id % 2 = 0) GROUP BY 1 HAVING count(*) = 1) x
  JOIN (SELECT signature || '/' || first_len AS k, min(conv_id) AS conv_id FROM (SELECT s.*, (SELECT min(length(text)) FROM conversations c WHERE c.conv_id = s.conv_id AND turn = 0) AS first_len FROM s WHERE conv_id % 2 = 1) GROUP BY 1 HAVING count(*) = 1) y USING (k))
SELECT old_conv, new_conv, p.turn AS turn FROM one JOIN conversations p ON p.conv_id = old_conv JOIN conversations q ON q.conv_id = new_conv AND q.turn = p.turn WHERE p.role = q.role""",
)
def module_context_twins(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations with one signature on each side pair their turns by position where the roles agree."""
    c = t(spark, sf, "conversations")
    first = F.min(F.when(F.col("turn") == 0, F.length("text")))
    roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), "-")
    s = c.groupBy("conv_id").agg(roles.alias("sig"), first.alias("fl")).withColumn("k", F.concat(F.col("sig"), F.lit("/"), F.col("fl").cast("string")))
    a, b = s.where("conv_id % 2 = 0").withColumnRenamed("conv_id", "old_conv"), s.where("conv_id % 2 = 1").withColumnRenamed("conv_id", "new_conv")
    pairs = gates.unique_both_sides(a, b, "k", "old_conv", "new_conv").select("old_conv", "new_conv")
    p = c.select(F.col("conv_id").alias("old_conv"), "turn", F.col("role").alias("r1"))
    q = c.select(F.col("conv_id").alias("new_conv"), "turn", F.col("role").alias("r2"))
    return pairs.join(p, "old_conv").join(q, ["new_conv", "turn"]).where("r1 = r2").select("old_conv", "new_conv", "turn")


_PARTS = """
WITH e AS (SELECT DISTINCT l_partkey, s_nationkey, n_regionkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
callee AS (SELECT l_partkey AS id, list_sort(list(DISTINCT n_regionkey)) AS regions, list_sort(list(DISTINCT s_nationkey % 5)) AS nations FROM e GROUP BY 1),
caller AS (SELECT l_partkey AS id, list_sort(list(DISTINCT l_returnflag || l_linestatus)) AS flags, list_sort(list(DISTINCT l_linenumber)) AS places FROM lineitem GROUP BY 1),
p AS (
  SELECT p_partkey AS id, p_partkey % 2 AS side, p_name || '/' || p_type || CASE WHEN p_partkey % 11 < 2 THEN '/' || (p_partkey // 22) ELSE '' END AS bucket, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_brand END AS member, CAST(p_size % 2 AS VARCHAR) AS props, p_size,
    coalesce(array_to_string(regions, ','), '') AS regions, coalesce(array_to_string(flags, ','), '') AS flags, coalesce(array_to_string(nations, ','), '') AS nations,
    coalesce(array_to_string(places, ','), '') AS places, p_name || '/' || p_type || '/' || p_brand AS known,
    nullif(min(p_partkey) OVER (PARTITION BY p_partkey % 2, p_name, p_type, p_size % 2), p_partkey) AS parent,
    list_sort(list_distinct(regexp_extract_all(lower(p_type || ' ' || p_brand), '[a-z0-9]{2,}'))) AS sh
  FROM part LEFT JOIN callee ON callee.id = p_partkey LEFT JOIN caller ON caller.id = p_partkey)
"""


def parts_as_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as graph vertices: bucket (name and type, some of a few parts only), member key (brand, sometimes absent), features, an enclosing part, and what their suppliers and sales look like."""
    li, s, n, p = (t(spark, sf, x) for x in ("lineitem", "supplier", "nation", "part"))
    e = li.select("l_partkey", "l_suppkey").distinct().join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("n_nationkey") == F.col("s_nationkey"))
    key = lambda c: F.array_join(F.array_sort(F.collect_set(c)).cast("array<string>"), ",")
    callee = e.groupBy(F.col("l_partkey").alias("id")).agg(key("n_regionkey").alias("regions"), key(F.col("s_nationkey") % 5).alias("nations"))
    caller = li.groupBy(F.col("l_partkey").alias("id")).agg(key(F.concat("l_returnflag", "l_linestatus")).alias("flags"), key("l_linenumber").alias("places"))
    words = F.array_sort(F.array_distinct(scalars.tokens(F.concat_ws(" ", "p_type", "p_brand"), 2)))
    own = F.when(F.col("p_partkey") % 11 < 2, F.concat(F.lit("/"), F.floor(F.col("p_partkey") / 22).cast("string"))).otherwise("")
    bucket = F.concat("p_name", F.lit("/"), "p_type", own)
    enclosing = F.min("p_partkey").over(Window.partitionBy(F.col("p_partkey") % 2, "p_name", "p_type", F.col("p_size") % 2))
    v = p.select(
        F.col("p_partkey").alias("id"), (F.col("p_partkey") % 2).alias("side"), bucket.alias("bucket"), F.when(F.col("p_size") % 7 != 0, F.col("p_brand")).alias("member"),
        (F.col("p_size") % 2).cast("string").alias("props"), "p_size", F.concat_ws("/", "p_name", "p_type", "p_brand").alias("known"), F.nullif(enclosing, F.col("p_partkey")).alias("parent"), words.alias("sh"),
    )
    return v.join(callee, "id", "left").join(caller, "id", "left").fillna("", ["regions", "flags", "nations", "places"])


_CASCADE = _PARTS + """,
known AS (
  SELECT x.id AS old_id, y.id AS res_id FROM (SELECT known, min(id) AS id FROM p WHERE side = 0 AND p_size % 5 = 0 GROUP BY known HAVING count(*) = 1) x
  JOIN (SELECT known, min(id) AS id FROM p WHERE side = 1 AND p_size % 5 = 0 GROUP BY known HAVING count(*) = 1) y USING (known)),
held AS (SELECT side, bucket, props, p_size % 8 AS ctx, id, row_number() OVER (PARTITION BY side, bucket, props, p_size % 8 ORDER BY id) AS r, count(*) OVER (PARTITION BY side, bucket, props, p_size % 8) AS holders FROM p),
partner AS (SELECT x.id AS old_id, y.id AS par_id FROM held x JOIN held y USING (bucket, props, ctx, r, holders) WHERE x.side = 0 AND y.side = 1),
c AS (
  SELECT o.id AS old_id, n.id AS new_id, o.props AS op, n.props AS np, o.member AS om, n.member AS nm,
    (o.member IS NULL OR coalesce(n.member = o.member, false)) AS k1,
    o.regions = n.regions AS k2, o.flags = n.flags AS k3, o.nations = n.nations AS k4, o.places = n.places AS k5, o.sh AS osh, n.sh AS nsh,
    coalesce(n.id = res_id, false) AS is_known, coalesce(n.id = par_id, false) AS is_partner
  FROM p o JOIN p n USING (bucket) LEFT JOIN known ON known.old_id = o.id LEFT JOIN partner ON partner.old_id = o.id WHERE o.side = 0 AND n.side = 1),
s AS (
  SELECT *, count(*) OVER w AS n0, sum(CAST(k1 AS INT)) OVER w AS n1, sum(CAST(k1 AND k2 AS INT)) OVER w AS n2,
    sum(CAST(k1 AND k2 AND k3 AS INT)) OVER w AS n3, sum(CAST(k1 AND k2 AND k3 AND k4 AS INT)) OVER w AS n4, sum(CAST(k1 AND k2 AND k3 AND k4 AND k5 AS INT)) OVER w AS n5,
    bool_or(is_known) OVER w AS some_known, bool_or(is_partner AND k1) OVER w AS some_partner FROM c WINDOW w AS (PARTITION BY old_id)),
d AS (
  SELECT *, CASE WHEN n0 = 1 THEN (CASE WHEN coalesce(om <> nm, false) OR coalesce(op <> np, false) THEN 'unmatched' ELSE 'bucketUnique' END)
      WHEN some_known THEN 'identity' WHEN om IS NOT NULL AND n1 = 0 THEN 'ambiguous' WHEN om IS NOT NULL AND n1 = 1 THEN 'memberKey' WHEN some_partner THEN 'enclosingStatement'
      WHEN n2 = 0 THEN 'ambiguous' WHEN n2 = 1 THEN 'calleeShapes' WHEN n3 = 0 THEN 'ambiguous' WHEN n3 = 1 THEN 'callerShapes'
      WHEN n4 = 0 THEN 'ambiguous' WHEN n4 = 1 THEN 'calleeHashes' WHEN n5 = 0 THEN 'ambiguous' WHEN n5 = 1 THEN 'twoHopShapes' ELSE 'open' END AS tier,
    CASE WHEN om IS NOT NULL AND n1 = 0 THEN n0 WHEN n2 = 0 THEN n1 WHEN n3 = 0 THEN n2 WHEN n4 = 0 THEN n3 WHEN n5 = 0 THEN n3 ELSE n5 END AS kept_pool,
    len(list_intersect(osh, nsh)) / len(list_distinct(osh || nsh)) AS score
  FROM s),
closed AS (
  SELECT old_id, tier, min(n0) AS n0, min(kept_pool) AS kept_pool, min(CASE WHEN tier = 'bucketUnique' OR (tier = 'identity' AND is_known) OR (tier = 'memberKey' AND k1) OR (tier = 'enclosingStatement' AND is_partner)
    OR (tier = 'calleeShapes' AND k1 AND k2) OR (tier = 'callerShapes' AND k1 AND k2 AND k3) OR (tier = 'calleeHashes' AND k1 AND k2 AND k3 AND k4)
    OR (tier = 'twoHopShapes' AND k1 AND k2 AND k3 AND k4 AND k5) THEN new_id END) AS new_id
  FROM d WHERE tier <> 'open' GROUP BY old_id, tier),
o AS (SELECT old_id, new_id, score FROM d WHERE tier = 'open' AND k1 AND k2 AND k3 AND k4 AND k5),
top AS (SELECT old_id, new_id FROM (SELECT *, max(score) OVER w AS best, count(*) OVER (PARTITION BY old_id, score) AS ties FROM o WINDOW w AS (PARTITION BY old_id)) WHERE score = best AND ties = 1 AND score >= 0.5),
everything AS (
  SELECT old_id, new_id, tier, n0, CASE WHEN tier = 'ambiguous' THEN kept_pool ELSE 0 END AS pool FROM closed
  UNION ALL SELECT x.old_id, top.new_id, CASE WHEN top.new_id IS NULL THEN 'ambiguous' ELSE 'shingleSimilarity' END, n0, CASE WHEN top.new_id IS NULL THEN kept_pool ELSE 0 END
    FROM (SELECT DISTINCT old_id, n0, kept_pool FROM d WHERE tier = 'open') x LEFT JOIN top USING (old_id)
  UNION ALL SELECT id, NULL, 'unmatched', 0, 0 FROM p WHERE side = 0 AND id NOT IN (SELECT old_id FROM c)),
one AS (SELECT *, new_id IS NOT NULL AND count(*) OVER (PARTITION BY new_id) > 1 AS demoted FROM everything),
kept AS (SELECT old_id, new_id, tier FROM one WHERE new_id IS NOT NULL AND NOT demoted),
crossed AS (
  SELECT k.old_id FROM kept k JOIN p a ON a.id = k.old_id JOIN p b ON b.id = k.new_id JOIN kept q ON q.old_id = a.parent
  WHERE k.tier = 'enclosingStatement' AND b.parent IS NOT NULL AND q.new_id <> b.parent),
final AS (
  SELECT old_id, CASE WHEN demoted OR old_id IN (SELECT old_id FROM crossed) THEN NULL ELSE new_id END AS new_id,
    CASE WHEN demoted OR old_id IN (SELECT old_id FROM crossed) THEN 'ambiguous' ELSE tier END AS tier,
    CAST(CASE WHEN demoted OR old_id IN (SELECT old_id FROM crossed) THEN n0 ELSE pool END AS BIGINT) AS pool,
    CASE WHEN demoted THEN 'demoted' WHEN old_id IN (SELECT old_id FROM crossed) THEN 'revoked' ELSE '' END AS state FROM one)
"""


def part_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Every tier, with the identity resolver, partners by enclosing context and the parents that revoke them."""
    a, b = sides(parts_as_functions(spark, sf))
    tiers = [
        matching.KeyTier("memberKey", "member", open_null=True), matching.KeyTier("calleeShapes", "regions"), matching.KeyTier("callerShapes", "flags"),
        matching.KeyTier("calleeHashes", "nations"), matching.KeyTier("twoHopShapes", "places", falls_to=2),
    ]
    x, y = (s.where("p_size % 5 = 0") for s in (a, b))
    known = gates.unique_both_sides(x.withColumnRenamed("id", "old_id"), y.withColumnRenamed("id", "new_id"), "known", "old_id", "new_id")
    x, y = (s.withColumn("ctx", F.col("p_size") % 8) for s in (a, b))
    partners = matching.ordinal_pairs(x, y, ["bucket", "props", "ctx"], ["id"])
    return matching.cascade(a, b, "bucket", [("member", "member"), ("props", "props")], tiers, "sh", resolver=known, partners=partners, parent="parent")


@query("cascade_match", _CASCADE + "SELECT * FROM final")
def cascade_match(spark: SparkSession, sf: str) -> DataFrame:
    return part_cascade(spark, sf)


@query("cascade_stats", _CASCADE + "SELECT tier, state, count(*) AS n, count(new_id) AS matched, CAST(sum(pool) AS BIGINT) AS candidates FROM final GROUP BY ALL")
def cascade_stats(spark: SparkSession, sf: str) -> DataFrame:
    return part_cascade(spark, sf).groupBy("tier", "state").agg(F.count(F.lit(1)).alias("n"), F.count("new_id").alias("matched"), F.sum("pool").alias("candidates"))


@query(
    "singleton_verdict",
    _PARTS
    + """SELECT o.id AS old_id, n.id AS new_id, CASE WHEN coalesce(o.member <> n.member, false) OR coalesce(o.props <> n.props, false) THEN 'reject'
    WHEN o.member IS NOT NULL AND n.member IS NOT NULL OR o.props IS NOT NULL AND n.props IS NOT NULL THEN 'accept' ELSE 'unguarded' END AS verdict
FROM p o JOIN p n ON o.side = 0 AND n.side = 1 AND o.bucket = n.bucket AND o.regions = n.regions AND o.nations = n.nations""",
)
def singleton_verdict(spark: SparkSession, sf: str) -> DataFrame:
    a, b = sides(parts_as_functions(spark, sf))
    b = b.select(*[F.col(c).alias(f"n_{c}") for c in b.columns])
    pairs = a.join(b, (a.bucket == b.n_bucket) & (a.regions == b.n_regions) & (a.nations == b.n_nations))
    v = gates.verdict([(F.col("member"), F.col("n_member")), (F.col("props"), F.col("n_props"))])
    return pairs.select(F.col("id").alias("old_id"), F.col("n_id").alias("new_id"), v.alias("verdict"))


@query(
    "callee_set_identity",
    """
WITH k AS (SELECT l_orderkey AS id, array_to_string(list_sort(list(DISTINCT CAST(s_nationkey AS VARCHAR))), '|') AS key FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1)
SELECT x.id AS old_id, y.id AS new_id FROM (SELECT key, min(id) AS id FROM k WHERE id % 2 = 0 GROUP BY key HAVING count(*) = 1) x
JOIN (SELECT key, min(id) AS id FROM k WHERE id % 2 = 1 GROUP BY key HAVING count(*) = 1) y USING (key)""",
)
def callee_set_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose set of supplier nations names exactly one order on either side."""
    li, s = t(spark, sf, "lineitem"), t(spark, sf, "supplier")
    k = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_orderkey").alias("id")).agg(scalars.set_key(F.collect_set(F.col("s_nationkey").cast("string"))).alias("key"))
    return matching.set_identity(k.where("id % 2 = 0"), k.where("id % 2 = 1"))


@query(
    "set_elimination",
    UNITS
    + """,
s AS (SELECT h, count(*) FILTER (side = 0) AS na, count(*) FILTER (side = 1) AS nb FROM u GROUP BY h),
left_over AS (SELECT u.* FROM u JOIN s USING (h) WHERE NOT (na = 1 AND nb = 1)),
g AS (SELECT source, n_chars % 97 AS slot, min(id) FILTER (side = 0) AS old_id, min(id) FILTER (side = 1) AS new_id, count(*) FILTER (side = 0) AS ra, count(*) FILTER (side = 1) AS rb FROM left_over GROUP BY ALL)
SELECT source, slot, old_id, new_id FROM g WHERE ra = 1 AND rb = 1""",
)
def set_elimination(spark: SparkSession, sf: str) -> DataFrame:
    """After resolved records are taken out of a group, exactly one left on each side suggests a pair."""
    u = units(spark, sf)
    done = u.groupBy("h").agg(F.count_if(F.col("side") == 0).alias("na"), F.count_if(F.col("side") == 1).alias("nb")).where("na = 1 and nb = 1")
    rest = u.join(done, "h", "left_anti").withColumn("slot", F.col("n_chars") % 97)
    only = lambda s: F.min(F.when(F.col("side") == s, F.col("id")))
    g = rest.groupBy("source", "slot").agg(only(0).alias("old_id"), only(1).alias("new_id"), F.count_if(F.col("side") == 0).alias("ra"), F.count_if(F.col("side") == 1).alias("rb"))
    return g.where("ra = 1 and rb = 1").select("source", "slot", "old_id", "new_id")


@query(
    "ground_truth_full_outer",
    UNITS
    + """,
x AS (SELECT source, lang, count(*) AS na, min(h) AS ha FROM a GROUP BY ALL), y AS (SELECT source, lang, count(*) AS nb, min(h) AS hb FROM b GROUP BY ALL)
SELECT source, lang, CASE WHEN na IS NULL THEN 'added' WHEN nb IS NULL THEN 'removed' WHEN ha = hb AND na = nb THEN 'unchanged' ELSE 'modified' END AS change FROM x FULL JOIN y USING (source, lang)""",
)
def ground_truth_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    a, b = sides(units(spark, sf))
    x = a.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("na"), F.min("h").alias("ha"))
    y = b.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("nb"), F.min("h").alias("hb"))
    same = (F.col("ha") == F.col("hb")) & (F.col("na") == F.col("nb"))
    change = F.when(F.col("na").isNull(), "added").when(F.col("nb").isNull(), "removed").when(same, "unchanged").otherwise("modified")
    return x.join(y, ["source", "lang"], "full_outer").select("source", "lang", change.alias("change"))


@query("hash_collision_rate", UNITS + " SELECT round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 9) AS rate FROM (SELECT h, count(*) AS n FROM u GROUP BY h)")
def hash_collision_rate(spark: SparkSession, sf: str) -> DataFrame:
    n = units(spark, sf).groupBy("h").count()
    return n.agg(F.round(F.sum(F.when(F.col("count") > 1, F.col("count")).otherwise(0)) / F.sum("count"), 9).alias("rate"))


@query(
    "same_program_floor",
    UNITS + " SELECT count(*) AS prior, count(*) FILTER (h IN (SELECT h FROM b)) AS hits, count(*) >= 50 AND count(*) FILTER (h IN (SELECT h FROM b)) < 0.05 * count(*) AS different FROM a",
)
def same_program_floor(spark: SparkSession, sf: str) -> DataFrame:
    """At least 50 prior records of which under 5 % hit a bucket: the snapshots aren't of one thing."""
    a, b = sides(units(spark, sf))
    hit = a.join(b.select("h").distinct().withColumn("_hit", F.lit(1)), "h", "left")
    c = hit.agg(F.count(F.lit(1)).alias("prior"), F.count("_hit").alias("hits"))
    return c.withColumn("different", (F.col("prior") >= 50) & (F.col("hits") < 0.05 * F.col("prior")))


_MANIFEST = UNITS + """,
ra AS (SELECT id, h, source || '/' || n_chars AS name, row_number() OVER (PARTITION BY h ORDER BY id) AS r FROM a),
rb AS (SELECT id, h, source || '/' || n_chars AS name, row_number() OVER (PARTITION BY h ORDER BY id) AS r FROM b),
m1 AS (SELECT ra.id AS old_id, rb.id AS new_id FROM ra JOIN rb USING (h, r)),
na AS (SELECT id, name, row_number() OVER (PARTITION BY name ORDER BY id) AS r FROM ra WHERE id NOT IN (SELECT old_id FROM m1)),
nb AS (SELECT id, name, row_number() OVER (PARTITION BY name ORDER BY id) AS r FROM rb WHERE id NOT IN (SELECT new_id FROM m1)),
m2 AS (SELECT na.id AS old_id, nb.id AS new_id FROM na JOIN nb USING (name, r)),
pa AS (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY id) AS r FROM a WHERE id NOT IN (SELECT old_id FROM m1 UNION SELECT old_id FROM m2)),
pb AS (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY id) AS r FROM b WHERE id NOT IN (SELECT new_id FROM m1 UNION SELECT new_id FROM m2)),
m3 AS (SELECT pa.id AS old_id, pb.id AS new_id FROM pa JOIN pb USING (source, r))
SELECT *, 'hash' AS pass FROM m1 UNION ALL SELECT *, 'name' FROM m2 UNION ALL SELECT *, 'position' FROM m3"""


@query("prior_manifest_order", _MANIFEST)
def prior_manifest_order(spark: SparkSession, sf: str) -> DataFrame:
    """Three passes with consumption: by hash, by name, then what is left by position inside a source."""
    a, b = (s.withColumn("name", F.concat(F.col("source"), F.lit("/"), F.col("n_chars").cast("string"))) for s in sides(units(spark, sf)))
    out = None
    for label, key in (("hash", "h"), ("name", "name"), ("position", "source")):
        w = Window.partitionBy(key).orderBy("id")
        x, y = (s.select(F.col("id").alias(i), key, F.row_number().over(w).alias("r")) for s, i in ((a, "old_id"), (b, "new_id")))
        m = x.join(y, [key, "r"]).select("old_id", "new_id", F.lit(label).alias("pass"))
        out = m if out is None else out.unionByName(m)
        a = a.join(m.select(F.col("old_id").alias("id")), "id", "left_anti")
        b = b.join(m.select(F.col("new_id").alias("id")), "id", "left_anti")
    return out


@query(
    "prior_name_carry",
    UNITS
    + """,
g AS (SELECT h FROM (SELECT h, count(*) AS n FROM a GROUP BY h) JOIN (SELECT h, count(*) AS n FROM b GROUP BY h) USING (h, n)),
x AS (SELECT h, id, source || '-' || id AS name, row_number() OVER (PARTITION BY h ORDER BY id) - 1 AS ordinal FROM a WHERE h IN (SELECT h FROM g)),
y AS (SELECT h, id, row_number() OVER (PARTITION BY h ORDER BY id) - 1 AS ordinal FROM b WHERE h IN (SELECT h FROM g))
SELECT y.id AS new_id, ordinal, x.name AS name FROM x JOIN y USING (h, ordinal)""",
)
def prior_name_carry(spark: SparkSession, sf: str) -> DataFrame:
    """A prior name goes to the record with its (hash, ordinal), where the whole group is intact."""
    a, b = sides(units(spark, sf))
    keys = gates.equal_count_keys(a, b, ["h"]).select("h")
    w = Window.partitionBy("h").orderBy("id")
    x = a.join(keys, "h", "left_semi").select("h", F.concat(F.col("source"), F.lit("-"), F.col("id").cast("string")).alias("name"), (F.row_number().over(w) - 1).cast("long").alias("ordinal"))
    y = b.join(keys, "h", "left_semi").select("h", F.col("id").alias("new_id"), (F.row_number().over(w) - 1).cast("long").alias("ordinal"))
    return x.join(y, ["h", "ordinal"]).select("new_id", "ordinal", "name")


@query(
    "unique_stem_join",
    """
WITH p AS (SELECT page_id AS id, page_id % 2 AS side, lower(regexp_extract(url, '^https?://([^/]+)', 1)) || '/' || regexp_extract(url, '/([a-z]{2})/', 1) || '/' || (length(html) // 100) AS stem FROM pages)
SELECT x.stem AS stem, x.id AS old_id, y.id AS new_id FROM (SELECT stem, min(id) AS id FROM p WHERE side = 0 GROUP BY stem HAVING count(*) = 1) x
JOIN (SELECT stem, min(id) AS id FROM p WHERE side = 1 GROUP BY stem HAVING count(*) = 1) y USING (stem)""",
)
def unique_stem_join(spark: SparkSession, sf: str) -> DataFrame:
    p = t(spark, sf, "pages")
    stem = F.concat_ws("/", F.lower(F.regexp_extract("url", "^https?://([^/]+)", 1)), F.regexp_extract("url", "/([a-z]{2})/", 1), F.floor(F.length("html") / 100).cast("string"))
    p = p.select(F.col("page_id").alias("id"), stem.alias("stem"))
    a, b = p.where("id % 2 = 0").withColumnRenamed("id", "old_id"), p.where("id % 2 = 1").withColumnRenamed("id", "new_id")
    return gates.unique_both_sides(a, b, "stem", "old_id", "new_id").select("stem", "old_id", "new_id")


@query(
    "close_match_corroboration",
    UNITS
    + r""",
t AS (SELECT id, side, source, lang, n_chars, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}'))) AS s, list_distinct(string_split(text, chr(10))) AS ls FROM u),
c AS (SELECT x.id AS old_id, y.id AS new_id, x.s AS xs, y.s AS ys, x.ls AS xl, y.ls AS yl FROM t x JOIN t y ON x.side = 0 AND y.side = 1 AND x.source = y.source AND x.lang = y.lang AND x.n_chars // 200 = y.n_chars // 200)
SELECT old_id, new_id, len(list_intersect(xl, yl)) > 0 AS aligned, CASE WHEN len(xs) = 0 OR len(ys) = 0 THEN false ELSE len(list_intersect(xs, ys)) / len(list_distinct(xs || ys)) >= 0.5 END AS alike
FROM c WHERE len(list_intersect(xl, yl)) > 0 OR (len(xs) > 0 AND len(ys) > 0 AND len(list_intersect(xs, ys)) / len(list_distinct(xs || ys)) >= 0.5)""",
)
def close_match_corroboration(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of like size that an aligned statement or half of their tokens corroborate."""
    u = units(spark, sf).withColumn("s", scalars.token_set(F.col("text"))).withColumn("ls", F.array_distinct(F.split("text", "\n"))).withColumn("band", F.floor(F.col("n_chars") / 200))
    a, b = sides(u)
    x = a.select(F.col("id").alias("old_id"), "source", "lang", "band", F.col("s").alias("xs"), F.col("ls").alias("xl"))
    y = b.select(F.col("id").alias("new_id"), "source", "lang", "band", F.col("s").alias("ys"), F.col("ls").alias("yl"))
    pairs = x.join(y, ["source", "lang", "band"])
    alike = F.when((F.size("xs") == 0) | (F.size("ys") == 0), False).otherwise(F.size(F.array_intersect("xs", "ys")) / F.size(F.array_union("xs", "ys")) >= 0.5)
    out = pairs.select("old_id", "new_id", F.arrays_overlap("xl", "yl").alias("aligned"), alike.alias("alike"))
    return out.where("aligned or alike")
