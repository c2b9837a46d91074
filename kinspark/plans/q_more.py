"""Queries: module cascade, alternation, pools, reconciliation, features, names, formats, reports, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinspark.functions import scalars
from kinspark.operators import gates, modules, windows
from kinspark.plans.common import LINES, UNITS, lines, sides, t, units
from kinspark.plans.q_source import _working
from kinspark.plans.registry import query
from kinspark.streaming import streams


_MODULES = UNITS + r""",
m AS (
  SELECT id, side, h AS signature, source || '/' || lang || '/' || (n_chars // 20) AS stem,
    list_distinct(list_filter(string_split(text, chr(10)), lambda x: length(x) >= 12)) AS items, list_distinct(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS declared,
    list_distinct(regexp_extract_all(lower(text), '[a-z]{7,}')) AS words FROM u),
ma AS (SELECT * FROM m WHERE side = 0), mb AS (SELECT * FROM m WHERE side = 1),
ed0 AS (
  SELECT id AS src, lag(id) OVER (PARTITION BY side, source ORDER BY id) AS dst, side FROM u
  UNION SELECT id, lag(id, 2) OVER (PARTITION BY side, lang ORDER BY id), side FROM u),
ed AS (SELECT * FROM ed0 WHERE dst IS NOT NULL),
nr AS (SELECT DISTINCT side, src AS id, 'imports' AS way, dst AS near FROM ed UNION SELECT DISTINCT side, dst, 'importers', src FROM ed),
content AS (
  SELECT a_id, b_id, inter / (n_a + n_b - inter) AS score FROM (
    SELECT x.id AS a_id, y.id AS b_id, len(list_intersect(x.items, y.items)) AS inter, len(x.items) AS n_a, len(y.items) AS n_b FROM ma x, mb y WHERE list_has_any(x.items, y.items)) WHERE inter / (n_a + n_b - inter) >= 0.5),
shared AS (
  SELECT *, inter / (n_a + n_b - inter) AS score FROM (
    SELECT x.id AS a_id, y.id AS b_id, len(list_intersect(x.declared, y.declared)) AS inter, len(x.declared) AS n_a, len(y.declared) AS n_b FROM ma x, mb y WHERE list_has_any(x.declared, y.declared))
  WHERE inter / (n_a + n_b - inter) >= 0.4),
graded AS (
  SELECT *, inter / (n_a + n_b - inter) AS score FROM (
    SELECT x.id AS a_id, y.id AS b_id, len(list_intersect(x.words, y.words)) AS inter, len(x.words) AS n_a, len(y.words) AS n_b FROM ma x, mb y WHERE list_has_any(x.words, y.words))
  WHERE inter / (n_a + n_b - inter) >= 0.333),
contra AS (SELECT x.id AS a_id, y.id AS b_id FROM ma x, mb y WHERE len(x.declared) > 0 AND len(y.declared) > 0 AND NOT list_has_any(x.declared, y.declared)),
m0 AS (
  SELECT x.id AS a_id, y.id AS b_id, 'uniqueSignature' AS tier FROM (SELECT signature, min(id) AS id FROM ma GROUP BY 1 HAVING count(*) = 1) x
  JOIN (SELECT signature, min(id) AS id FROM mb GROUP BY 1 HAVING count(*) = 1) y USING (signature))"""


def _agree_sql(m: str) -> str:
    return f"""(SELECT a_id, b_id, count(*) AS agree FROM (SELECT p.id AS a_id, way, mm.b_id AS near FROM nr p JOIN {m} mm ON mm.a_id = p.near WHERE p.side = 0 AND p.id NOT IN (SELECT a_id FROM {m}))
    JOIN (SELECT id AS b_id, way, near FROM nr WHERE side = 1 AND id NOT IN (SELECT b_id FROM {m})) USING (way, near) GROUP BY ALL)"""


def _allowed_sql(pairs: str, m: str) -> str:
    return f"(SELECT * FROM {pairs} WHERE NOT (a_id IN (SELECT a_id FROM shared WHERE score >= 0.6 AND b_id NOT IN (SELECT b_id FROM {m})) AND (a_id, b_id) IN (SELECT (a_id, b_id) FROM contra)))"


def _open_sql(pairs: str, m: str) -> str:
    return f"(SELECT * FROM {pairs} WHERE a_id NOT IN (SELECT a_id FROM {m}) AND b_id NOT IN (SELECT b_id FROM {m}))"


def _mutual_sql(pairs: str, floor: float) -> str:
    return f"""(SELECT a_id, b_id FROM (SELECT *, max(score) OVER (PARTITION BY a_id) AS pa, max(score) OVER (PARTITION BY b_id) AS pb, count(*) OVER (PARTITION BY a_id, score) AS ta, count(*) OVER (PARTITION BY b_id, score) AS tb
    FROM {pairs} WHERE score >= {floor}) WHERE score = pa AND score = pb AND ta = 1 AND tb = 1)"""


def _modules_sql(rounds: int) -> str:
    """The cascade with ``rounds`` rounds of the edge tier written out."""
    out, m = _MODULES, "m0"
    for r in range(1, rounds + 1):
        out += f""",
g{r} AS MATERIALIZED (
  SELECT a_id, b_id, agree FROM (
    SELECT *, count(*) OVER (PARTITION BY b_id) AS claims FROM (
      SELECT *, row_number() OVER w AS r, lead(agree) OVER w AS agree2, lead(score) OVER w AS score2 FROM (
        SELECT c.a_id, c.b_id, score, coalesce(agree, 0) AS agree FROM {_allowed_sql(_open_sql('content', m), m)} c LEFT JOIN {_agree_sql(m)} g ON g.a_id = c.a_id AND g.b_id = c.b_id)
      WINDOW w AS (PARTITION BY a_id ORDER BY agree DESC, score DESC, b_id))
    WHERE r = 1 AND ((agree >= 1 AND (agree2 IS NULL OR agree > agree2 OR score > score2 + 1e-9)) OR (agree2 IS NULL AND score >= 0.8)))
  WHERE claims = 1),
e{r} AS MATERIALIZED (SELECT * FROM {m} UNION ALL SELECT a_id, b_id, CASE WHEN agree >= 1 THEN 'edgeCorroborated' ELSE 'highOverlap' END FROM g{r})"""
        m = f"e{r}"
    stems = lambda t, end: f"(SELECT stem, min(id) AS {end} FROM {t} WHERE id NOT IN (SELECT {end} FROM {m}) GROUP BY stem HAVING count(*) = 1)"
    out += f""",
t1 AS MATERIALIZED (SELECT * FROM {m} UNION ALL SELECT a_id, b_id, 'stem' FROM {stems('ma', 'a_id')} JOIN {stems('mb', 'b_id')} USING (stem) JOIN content USING (a_id, b_id) WHERE score >= 0.7),
t2 AS MATERIALIZED (SELECT * FROM t1 UNION ALL SELECT a_id, b_id, 'exportSet' FROM {_mutual_sql(_open_sql('shared', 't1'), 0.6)}),
t3 AS MATERIALIZED (SELECT * FROM t2 UNION ALL SELECT a_id, b_id, 'containment' FROM {_mutual_sql("(SELECT a_id, b_id, inter / least(n_a, n_b) AS score FROM " + _open_sql('shared', 't2') + " WHERE least(n_a, n_b) >= 2)", 0.75)}),
bg AS (
  SELECT a_id, b_id FROM (SELECT *, count(*) OVER (PARTITION BY a_id) AS n FROM (
    SELECT *, row_number() OVER w AS r, lead(score) OVER w AS second FROM {_open_sql('graded', 't3')} WINDOW w AS (PARTITION BY b_id ORDER BY score DESC, a_id))
    WHERE r = 1 AND score >= 0.5 AND (second IS NULL OR score >= 1.5 * second)) WHERE n = 1),
t4 AS MATERIALIZED (SELECT * FROM t3 UNION ALL SELECT a_id, b_id, 'graded' FROM {_allowed_sql('bg', 't3')}),
ag AS (SELECT a_id, b_id, agree AS score FROM {_agree_sql('t4')}),
gp AS (SELECT a_id, b_id FROM {_mutual_sql('ag', 0)}),
t5 AS MATERIALIZED (SELECT * FROM t4 UNION ALL SELECT a_id, b_id, 'graphPosition' FROM {_allowed_sql('gp', 't4')})
"""
    return out


def _modules(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents as modules of lines that export their capitalised words; a module imports those shortly before it in its source and language."""
    u = units(spark, sf)
    stem = F.concat_ws("/", "source", "lang", F.floor(F.col("n_chars") / 20).cast("string"))
    items = F.array_distinct(F.filter(F.split("text", "\n"), lambda x: F.length(x) >= 12))
    declared = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), F.lit(0)))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), F.lit(0)))
    m = u.select("id", "side", F.col("h").alias("signature"), stem.alias("stem"), items.alias("items"), declared.alias("declared"), words.alias("words"))
    before = lambda key, n: u.select("side", F.col("id").alias("src"), F.lag("id", n).over(Window.partitionBy("side", key).orderBy("id")).alias("dst"))
    edges = before("source", 1).unionByName(before("lang", 2)).where("dst is not null").distinct()
    return (*sides(m), edges.where("side = 0").select("src", "dst"), edges.where("side = 1").select("src", "dst"))


@query("module_match_cascade", _modules_sql(8) + "SELECT * FROM t5")
def module_match_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """All seven tiers in order; the edge tier to its fixpoint (the SQL writes out eight rounds)."""
    return modules.module_cascade(*_modules(spark, sf))


@query("module_match_tiers", _modules_sql(8) + "SELECT tier, count(*) AS n FROM t5 GROUP BY tier")
def module_match_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return modules.module_cascade(*_modules(spark, sf)).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query("module_match_conservation", _modules_sql(8) + "SELECT (SELECT count(*) FROM ma) AS priors, count(*) AS matched, (SELECT count(*) FROM ma) - count(*) AS left_over, count(*) - count(DISTINCT b_id) AS twice FROM t5")
def module_match_conservation(spark: SparkSession, sf: str) -> DataFrame:
    """Matched and left over make up all prior records, and no fresh record is matched twice."""
    a, *rest = _modules(spark, sf)
    m = modules.module_cascade(a, *rest)
    left = a.join(m.select(F.col("a_id").alias("id")), "id", "left_anti").agg(F.count(F.lit(1)).alias("left_over"))
    got = m.agg(F.count(F.lit(1)).alias("matched"), (F.count(F.lit(1)) - F.count_distinct("b_id")).alias("twice"))
    return got.crossJoin(left).select((F.col("matched") + F.col("left_over")).alias("priors"), "matched", "left_over", "twice")


_ALTERNATE = """
WITH one AS (
  SELECT x.s_suppkey AS old_id, y.s_suppkey AS new_id FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND floor(x.s_acctbal / 3000) = floor(y.s_acctbal / 3000)),
two AS (SELECT x.p_partkey AS old_id, y.p_partkey AS new_id FROM part x JOIN part y ON x.p_brand = y.p_brand AND x.p_type = y.p_type AND x.p_size // 4 = y.p_size // 4),
lo AS (SELECT DISTINCT l_suppkey AS one, l_partkey AS two FROM lineitem WHERE l_orderkey % 16 < 4), ln AS (SELECT DISTINCT l_suppkey AS one, l_partkey AS two FROM lineitem WHERE l_orderkey % 16 < 3),
so AS (SELECT DISTINCT x.l_partkey AS x, y.l_partkey AS y FROM lineitem x JOIN lineitem y USING (l_orderkey) WHERE l_orderkey % 64 = 0 AND x.l_partkey <> y.l_partkey),
sn AS (SELECT DISTINCT x.l_partkey AS x, y.l_partkey AS y FROM lineitem x JOIN lineitem y USING (l_orderkey) WHERE l_orderkey % 64 = 0 AND l_orderkey % 3 > 0 AND x.l_partkey <> y.l_partkey)"""


def _closed_sql(pairs: str) -> str:
    return f"(SELECT old_id, new_id FROM (SELECT *, count(*) OVER (PARTITION BY old_id) AS n, count(*) OVER (PARTITION BY new_id) AS m FROM {pairs}) WHERE n = 1 AND m = 1)"


def _alternation_sql(rounds: int = 3, self_rounds: int = 4) -> str:
    out = _ALTERNATE + "".join(f", {k}0 AS MATERIALIZED (SELECT old_id, new_id, 0 AS round FROM {_closed_sql(k)})" for k in ("one", "two"))
    at = {"one": "one0", "two": "two0"}

    def step(kind: str, name: str, r: int, witnesses: str, old: str, new: str, a: str, b: str) -> str:
        mine = at[kind]
        agree = f"""(SELECT DISTINCT p.old_id, p.new_id FROM {kind} p JOIN {old} o ON o.{a} = p.old_id JOIN {witnesses} w ON w.old_id = o.{b} JOIN {new} n ON n.{a} = p.new_id AND n.{b} = w.new_id
    WHERE p.old_id NOT IN (SELECT old_id FROM {mine}) AND p.new_id NOT IN (SELECT new_id FROM {mine}))"""
        at[kind] = name
        return f", {name} AS MATERIALIZED (SELECT * FROM {mine} UNION ALL SELECT old_id, new_id, {r} FROM {_closed_sql(agree)})"

    for r in range(1, rounds + 1):
        for kind, other in (("one", "two"), ("two", "one")):
            out += step(kind, f"{kind}{r}", r, at[other], "lo", "ln", kind, other)
        for i in range(self_rounds):
            out += step("two", f"two{r}_{i}", r, at["two"], "so", "sn", "x", "y")
    return out + f" SELECT 'one' AS kind, * FROM {at['one']} UNION ALL SELECT 'two', * FROM {at['two']}"


@query("alternation", _alternation_sql())
def alternation(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers and parts of two order snapshots name one another in turns: candidates share a coarse key, links are sales; parts sold in one order support each other."""
    li = t(spark, sf, "lineitem")
    s, p = t(spark, sf, "supplier"), t(spark, sf, "part")
    pair = lambda df: df.select(F.col("id").alias("old_id"), "k").join(df.select(F.col("id").alias("new_id"), "k"), "k").select("old_id", "new_id")
    one = pair(s.select(F.col("s_suppkey").alias("id"), F.concat_ws("/", F.col("s_nationkey").cast("string"), F.floor(F.col("s_acctbal") / 3000).cast("string")).alias("k")))
    two = pair(p.select(F.col("p_partkey").alias("id"), F.concat_ws("/", "p_brand", "p_type", F.floor(F.col("p_size") / 4).cast("string")).alias("k")))
    links = lambda least: li.where(F.col("l_orderkey") % 16 < least).select(F.col("l_suppkey").alias("one"), F.col("l_partkey").alias("two")).distinct()

    def together(rows: DataFrame) -> DataFrame:
        x, y = (rows.select("l_orderkey", F.col("l_partkey").alias(c)) for c in ("x", "y"))
        return x.join(y, "l_orderkey").where("x <> y").select("x", "y").distinct()

    some = li.where("l_orderkey % 64 = 0")
    return modules.alternate(one, two, links(4), links(3), self_old=together(some), self_new=together(some.where("l_orderkey % 3 > 0")))


def _pools(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders of two snapshots, fine buckets and their evidence key, and the matches of those alone in their bucket."""
    o = t(spark, sf, "orders")
    bucket = F.concat_ws("/", "o_orderstatus", "o_orderpriority", F.floor(F.col("o_totalprice") / 2000).cast("string"))
    rec = o.select(F.col("o_orderkey").alias("id"), bucket.alias("bucket"), F.when(F.col("o_orderkey") % 29 != 0, F.col("o_orderpriority")).alias("evidence"), F.col("o_orderkey").alias("pos"), "o_custkey")
    old, new = rec, rec.where("id % 17 <> 0").withColumn("id", F.col("id") + 1_000_000_000)
    given = gates.unique_both_sides(old.withColumnRenamed("id", "old_id"), new.withColumnRenamed("id", "new_id"), "bucket", "old_id", "new_id").select("old_id", "new_id")
    return old, new, given


_POOLS = """
WITH r AS (SELECT o_orderkey AS pos, o_orderstatus || '/' || o_orderpriority || '/' || CAST(floor(o_totalprice / 2000) AS BIGINT) AS bucket, CASE WHEN o_orderkey % 29 <> 0 THEN o_orderpriority END AS evidence FROM orders),
x AS (SELECT pos AS id, * FROM r), y AS (SELECT pos + 1000000000 AS id, * FROM r WHERE pos % 17 <> 0),
given AS (
  SELECT p.id AS old_id, q.id AS new_id FROM (SELECT bucket, min(id) AS id FROM x GROUP BY 1 HAVING count(*) = 1) p JOIN (SELECT bucket, min(id) AS id FROM y GROUP BY 1 HAVING count(*) = 1) q USING (bucket)),
ca AS (SELECT bucket, count(*) AS n, count(evidence) AS k, min(evidence) AS lo, max(evidence) AS hi, count(*) FILTER (id IN (SELECT old_id FROM given)) AS done FROM x GROUP BY 1),
cb AS (SELECT bucket, count(*) AS n, count(evidence) AS k, min(evidence) AS lo, max(evidence) AS hi, count(*) FILTER (id IN (SELECT new_id FROM given)) AS done FROM y GROUP BY 1),
pool AS (SELECT bucket FROM ca JOIN cb USING (bucket, n, k, lo, hi, done) WHERE k = n AND lo = hi AND done = 0)
"""


@query("certified_pool_order", _POOLS + """SELECT old_id, new_id FROM (SELECT bucket, id AS old_id, row_number() OVER (PARTITION BY bucket ORDER BY pos) AS r FROM x WHERE bucket IN (SELECT bucket FROM pool))
JOIN (SELECT bucket, id AS new_id, row_number() OVER (PARTITION BY bucket ORDER BY pos) AS r FROM y WHERE bucket IN (SELECT bucket FROM pool)) USING (bucket, r)""")
def certified_pool_order(spark: SparkSession, sf: str) -> DataFrame:
    """Buckets of which every member is undecided, of equal counts and with one evidence key, paired by position."""
    return modules.ordinal_pools(*_pools(spark, sf))


@query("pool_assignment")
def pool_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """Certified pools: affinity 1 for a matched order before or after, 2 for the customer's one before or after; best first. Greedy choice has no SQL; tests compare it with one done step by step."""
    old, new, given = _pools(spark, sf)
    pools = modules.certified_pools(old, new, given).select("bucket")
    inside = [df.join(pools, "bucket", "left_semi") for df in (old, new)]

    def near(df: DataFrame) -> DataFrame:
        by_customer = Window.partitionBy("o_custkey").orderBy("id")
        # The session is cut into runs of a thousand ids, so that no window holds the whole table.
        session = Window.partitionBy(F.floor(F.col("pos") / 1000)).orderBy("id")
        at = df.select("id", "bucket", F.lag("id").over(session).alias("prev"), F.lead("id").over(session).alias("next"), F.lag("id").over(by_customer).alias("caller"), F.lead("id").over(by_customer).alias("callee"))
        kinds = [("prev", 1), ("next", 1), ("caller", 2), ("callee", 2)]
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("near"), F.lit(w).alias("weight")) for k, w in kinds]))
        return at.select("id", "bucket", each.alias("x")).select("id", "bucket", "x.*").where("near is not null")

    x = near(old).join(pools, "bucket", "left_semi").join(given, F.col("near") == F.col("old_id")).select(F.col("id").alias("old_id"), "bucket", "kind", "weight", F.col("new_id").alias("near"))
    y = near(new).select(F.col("id").alias("new_id"), "bucket", "kind", "near")
    scores = x.join(y, ["bucket", "kind", "near"]).groupBy("bucket", "old_id", "new_id").agg(F.sum("weight").alias("score"))
    return modules.assign_pools(*inside, scores)


@query("family_permutation")
def family_permutation(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of one name and brand are a family whose members are known by the orders that hold them; some have swapped names, and move back. Greedy: tests compare it with one list worked off in order."""
    li = t(spark, sf, "lineitem").select("l_partkey", "l_orderkey").distinct()
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws("/", "p_name", "p_brand").alias("bucket"))
    name = F.lpad(F.col("l_partkey").cast("string"), 12, "0")
    w = Window.partitionBy("bucket").orderBy("l_partkey")
    swapped = F.when(F.row_number().over(w) % 2 == 1, F.coalesce(F.lead(name).over(w), name)).otherwise(F.lag(name).over(w))
    fresh = p.withColumn("name", F.when(F.hash("bucket") % 3 == 0, swapped).otherwise(name))
    contexts = lambda members, rows: members.join(rows, "l_partkey").select("bucket", "name", F.col("l_orderkey").alias("context"))
    return modules.family_moves(contexts(fresh, li.where("l_orderkey % 3 > 0")), contexts(p.withColumn("name", name), li.where("l_orderkey % 5 > 0")))


@query("prior_diff_reconcile")
def prior_diff_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Names that differ at the same place in edited twins, where two lines or more agree and no other name rivals."""
    u = units(spark, sf).withColumn("masked", scalars.hash16(scalars.mask_words(F.col("text"))))
    a, b = sides(u)
    x = a.groupBy("masked").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("old")).where("n = 1").drop("n")
    y = b.groupBy("masked").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("new")).where("n = 1").drop("n")
    return modules.token_diff_votes(x.join(y, "masked"), "old", "new", 2)


@query(
    "factory_naming_cascade",
    UNITS
    + r""", f AS (SELECT id, h, nullif(regexp_extract(text, '(Apache License|MIT License|GNU General Public License|BSD)', 1), '') AS banner, nullif(regexp_extract(text, 'https?://([a-z.]+)', 1), '') AS repo FROM b),
p AS (SELECT h, min(source) AS carried FROM a GROUP BY h HAVING count(*) = 1)
SELECT f.id, coalesce(banner, repo, carried, 'mod-' || substr(f.h, 1, 8)) AS name, CASE WHEN banner IS NOT NULL THEN 'banner' WHEN repo IS NOT NULL THEN 'url' WHEN carried IS NOT NULL THEN 'carry-over' ELSE 'fallback' END AS name_source FROM f LEFT JOIN p USING (h)""",
)
def factory_naming_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Banner, then address, then the prior name, then a name from the hash."""
    a, b = sides(units(spark, sf))
    some = lambda c: F.when(c != "", c)
    p = a.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("source").alias("carried")).where("n = 1").drop("n")
    f = b.join(p, "h", "left").withColumn("banner", some(F.regexp_extract("text", "(Apache License|MIT License|GNU General Public License|BSD)", 1))).withColumn("repo", some(F.regexp_extract("text", "https?://([a-z.]+)", 1)))
    source = F.when(F.col("banner").isNotNull(), "banner").when(F.col("repo").isNotNull(), "url").when(F.col("carried").isNotNull(), "carry-over").otherwise("fallback")
    return f.select("id", F.coalesce("banner", "repo", "carried", F.concat(F.lit("mod-"), F.substring("h", 1, 8))).alias("name"), source.alias("name_source"))


@query(
    "feature_extraction",
    """SELECT l_orderkey AS id, count(*) AS arity, count(DISTINCT l_returnflag) + 1 AS complexity, CAST(count(*) FILTER (l_discount > 0.05) AS BIGINT) AS branches,
  array_to_string(list_sort(list(DISTINCT l_linestatus)), ',') AS literals,
  CASE WHEN count(*) FILTER (l_quantity > 40) > 0 AND count(*) FILTER (l_discount > 0.05) > 0 THEN 'complex' WHEN count(*) FILTER (l_quantity > 40) > 0 THEN 'looping' WHEN count(*) FILTER (l_discount > 0.05) > 0 THEN 'branching' ELSE 'linear' END AS cfg,
  coalesce(nullif(string_agg(CASE WHEN l_quantity > 40 THEN 'loop' WHEN l_discount > 0.05 THEN 'if' END, '-' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice), ''), 'empty') AS shape FROM lineitem GROUP BY 1""",
)
def feature_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Counts, sorted distinct values, the class of the control flow and its shape string."""
    li = t(spark, sf, "lineitem")
    loop, branch = F.col("l_quantity") > 40, F.col("l_discount") > 0.05
    step = F.when(loop, "loop").when(branch, "if")
    loops, branches = F.count_if(loop), F.count_if(branch)
    cfg = F.when((loops > 0) & (branches > 0), "complex").when(loops > 0, "looping").when(branches > 0, "branching").otherwise("linear")
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", step.alias("s"))))
    shape = F.array_join(F.filter(F.transform(ordered, lambda x: x["s"]), lambda s: s.isNotNull()), "-")
    return li.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count(F.lit(1)).alias("arity"), (F.count_distinct("l_returnflag") + 1).alias("complexity"), branches.cast("long").alias("branches"),
        F.array_join(F.array_sort(F.collect_set("l_linestatus")), ",").alias("literals"), cfg.alias("cfg"), F.when(shape == "", "empty").otherwise(shape).alias("shape"),
    )


@query(
    "identifier_validity",
    r"""SELECT DISTINCT w AS name, regexp_matches(w, '^[A-Za-z_][A-Za-z0-9_]*$') AND lower(w) NOT IN ('the', 'and', 'for', 'with', 'this') AS valid,
  CASE WHEN regexp_matches(regexp_replace(w, '[^A-Za-z0-9_]+', '_', 'g'), '^[0-9]') THEN '_' ELSE '' END || regexp_replace(w, '[^A-Za-z0-9_]+', '_', 'g') AS sanitized
FROM (SELECT unnest(regexp_extract_all(text, '[^ \t\n\r\f]+')) AS w FROM documents)""",
)
def identifier_validity(spark: SparkSession, sf: str) -> DataFrame:
    w = t(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[^ \\t\\n\\r\\f]+"), F.lit(0))).alias("name")).distinct()
    clean = F.regexp_replace("name", "[^A-Za-z0-9_]+", "_")
    valid = F.col("name").rlike("^[A-Za-z_][A-Za-z0-9_]*$") & ~F.lower("name").isin("the", "and", "for", "with", "this")
    return w.select("name", valid.alias("valid"), F.concat(F.when(clean.rlike("^[0-9]"), "_").otherwise(""), clean).alias("sanitized"))


@query("library_headers", r"SELECT page_id, regexp_extract(url, '^https?://([^/?]+)', 1) AS host, regexp_matches(url, '/(vendor|lib|node_modules)/') AS vendored, regexp_extract(substr(html, 1, 1024), 'lang=\"([a-z]+)\"', 1) AS header FROM pages")
def library_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Library by path, and what the first kilobyte of the text declares (a rule of the detector)."""
    return t(spark, sf, "pages").select(
        "page_id", F.regexp_extract("url", "^https?://([^/?]+)", 1).alias("host"), F.col("url").rlike("/(vendor|lib|node_modules)/").alias("vendored"),
        F.regexp_extract(F.substring("html", 1, 1024), 'lang="([a-z]+)"', 1).alias("header"),
    )


@query(
    "region_exclusion",
    LINES + ", r AS (SELECT doc_id, min(stmt) AS lo, max(stmt) AS hi FROM l WHERE regexp_matches(line, '(Licensed under|Released under|Copyright|GNU)') GROUP BY doc_id) SELECT l.doc_id, count(*) AS statements FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = l.doc_id AND l.stmt BETWEEN r.lo AND r.hi) GROUP BY l.doc_id",
)
def region_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    """Statements outside a classified region: a range anti-join on the document's own key."""
    li = lines(spark, sf)
    r = li.where(F.col("line").rlike("(Licensed under|Released under|Copyright|GNU)")).groupBy("doc_id").agg(F.min("stmt").alias("lo"), F.max("stmt").alias("hi"))
    out = li.join(r, (li.doc_id == r.doc_id) & F.col("stmt").between(F.col("lo"), F.col("hi")), "left_anti")
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("statements"))


@query(
    "shingle_cap",
    UNITS
    + """, r AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9]{2,}') AS w FROM u), w AS (SELECT id, unnest(w) AS v, unnest(generate_series(1, len(w))) AS i FROM r),
g AS (SELECT id, i, v || ' ' || lead(v, 1) OVER q || ' ' || lead(v, 2) OVER q || ' ' || lead(v, 3) OVER q AS x FROM w WINDOW q AS (PARTITION BY id ORDER BY i)),
f AS (SELECT id, x, min(i) AS pos FROM g WHERE x IS NOT NULL GROUP BY id, x)
SELECT id, least(count(*), 2048) AS kept, count(*) AS shingles, max(pos) AS last_at FROM f GROUP BY id""",
)
def shingle_cap(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct shingles in order of first position; a role keeps the first 2048 of them (the feature of that role)."""
    g = units(spark, sf).select("id", scalars.tokens(F.col("text"), 2).alias("w")).where(F.size("w") >= 4)
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - 3), lambda i: F.array_join(F.slice("w", i, 4), " "))
    first = g.select("id", F.posexplode(grams).alias("at", "x")).groupBy("id", "x").agg((F.min("at") + 1).cast("long").alias("at"))
    return first.groupBy("id").agg(F.least(F.count(F.lit(1)), F.lit(2048)).cast("long").alias("kept"), F.count(F.lit(1)).alias("shingles"), F.max("at").alias("last_at"))


@query("multi_key_order", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity) AS place FROM lineitem")
def multi_key_order(spark: SparkSession, sf: str) -> DataFrame:
    """The place of every row by score, then by all that decides ties."""
    keys = [F.col("l_extendedprice").desc(), *[F.col(c).asc() for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")]]
    return windows.global_rank(t(spark, sf, "lineitem"), keys, "place").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "place")


@query("barrier_order", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY role, length(text), turn) - 1 AS seq FROM conversations")
def barrier_order(spark: SparkSession, sf: str) -> DataFrame:
    """Proposals of a wave in the order in which the barrier applies them."""
    w = Window.partitionBy("conv_id").orderBy("role", F.length("text"), "turn")
    return t(spark, sf, "conversations").select("conv_id", "turn", (F.row_number().over(w) - 1).cast("long").alias("seq"))


@query("set_difference", "WITH s AS (SELECT user_id, list(DISTINCT event_type) AS x FROM events WHERE value >= 50 GROUP BY 1), r AS (SELECT user_id, list(DISTINCT event_type) AS y FROM events WHERE value < 50 GROUP BY 1) SELECT user_id, array_to_string(list_sort(list_filter(x, lambda v: NOT list_contains(y, v))), ',') AS only_high FROM s JOIN r USING (user_id)")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events")
    x = e.where("value >= 50").groupBy("user_id").agg(F.collect_set("event_type").alias("x"))
    y = e.where("value < 50").groupBy("user_id").agg(F.collect_set("event_type").alias("y"))
    return x.join(y, "user_id").select("user_id", F.array_join(F.array_sort(F.array_except("x", "y")), ",").alias("only_high"))


@query("regions_deduplicated", LINES + ", p AS (SELECT doc_id, stmt, CASE WHEN regexp_matches(line, 'Licensed under') THEN 0 WHEN regexp_matches(line, 'License') THEN 1 WHEN regexp_matches(line, 'Copyright|GNU') THEN 2 END AS pattern FROM l) SELECT doc_id, stmt, pattern FROM p WHERE pattern IS NOT NULL")
def regions_deduplicated(spark: SparkSession, sf: str) -> DataFrame:
    """Banners found by several patterns count once, for the first pattern in order."""
    hits = [(0, "Licensed under"), (1, "License"), (2, "Copyright|GNU")]
    found = F.filter(F.array(*[F.when(F.col("line").rlike(p), F.lit(i)) for i, p in hits]), lambda x: x.isNotNull())
    h = lines(spark, sf).select("doc_id", "stmt", F.explode(found).alias("pattern"))
    return h.groupBy("doc_id", "stmt").agg(F.min("pattern").alias("pattern"))


@query("stats_json", """SELECT source, '{"docs":' || count(*) || ',"chars":' || sum(n_chars) || ',"longest":' || max(n_chars) || '}' AS stats FROM documents GROUP BY source""")
def stats_json(spark: SparkSession, sf: str) -> DataFrame:
    g = t(spark, sf, "documents").groupBy("source").agg(F.to_json(F.struct(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))).alias("stats"))
    return g


@query("emission_alignment", "WITH k AS (SELECT conv_id, turn, CASE WHEN count(*) OVER (PARTITION BY conv_id, role, length(text) // 50) = 1 THEN (length(text) * 7919) % 101 END AS rank FROM conversations), o AS (SELECT *, coalesce(rank, last_value(rank IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) + 0.5, -0.5) AS key, count(rank) OVER (PARTITION BY conv_id) AS known FROM k) SELECT conv_id, turn, CASE WHEN known < 2 THEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 ELSE row_number() OVER (PARTITION BY conv_id ORDER BY key, turn) - 1 END AS place FROM o")
def emission_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Statements ordered by the prior ranks of unambiguous ones; with fewer than two of them the order stays."""
    c = t(spark, sf, "conversations")
    alone = F.count(F.lit(1)).over(Window.partitionBy("conv_id", "role", F.floor(F.length("text") / 50))) == 1
    k = c.select("conv_id", "turn", F.when(alone, (F.length("text") * 7919) % 101).alias("rank"))
    o = windows.anchored_order(k, ["conv_id"], "rank", "turn")
    kept = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    known = F.count("rank").over(Window.partitionBy("conv_id"))
    return o.select("conv_id", "turn", F.when(known < 2, kept).otherwise(F.col("place")).cast("long").alias("place"))


@query("permutation_rename", "SELECT s_suppkey AS id, lead(s_name, 1, first_name) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS name FROM (SELECT *, first_value(s_name) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS first_name FROM supplier)")
def permutation_rename(spark: SparkSession, sf: str) -> DataFrame:
    """A cycle of renames applied at once: no temporary name is needed when all change together."""
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    first = F.first("s_name").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.coalesce(F.lead("s_name").over(w), first).alias("name"))


@query("format_values", "SELECT event_id, CASE WHEN value >= 1000 THEN CAST(floor(value / 100) / 10.0 AS VARCHAR) || 'K' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS tokens, CASE WHEN value < 60 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || 's' ELSE CAST(CAST(floor(value / 60) AS BIGINT) AS VARCHAR) || 'm' || lpad(CAST(CAST(floor(value) AS BIGINT) % 60 AS VARCHAR), 2, '0') || 's' END AS duration, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS parsed FROM events")
def format_values(spark: SparkSession, sf: str) -> DataFrame:
    whole = F.floor("value")
    tokens = F.when(F.col("value") >= 1000, F.concat((F.floor(F.col("value") / 100) / 10.0).cast("string"), F.lit("K"))).otherwise(whole.cast("string"))
    clock = F.concat(F.floor(F.col("value") / 60).cast("string"), F.lit("m"), F.lpad((whole % 60).cast("string"), 2, "0"), F.lit("s"))
    duration = F.when(F.col("value") < 60, F.concat(whole.cast("string"), F.lit("s"))).otherwise(clock)
    return t(spark, sf, "events").select("event_id", tokens.alias("tokens"), duration.alias("duration"), F.regexp_extract("props", "([0-9]+)", 1).try_cast("long").alias("parsed"))


@query("leaf_paths", "SELECT k AS path, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY k")
def leaf_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of the leaves of JSON records."""
    return t(spark, sf, "events").select(F.explode(F.json_object_keys("props")).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query("streaming_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS s FROM events), k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '6 hours' AS end_, count(*) AS n FROM k GROUP BY user_id, session")
def streaming_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions that a pause of six hours closes, from the stream of events."""
    e, work = t(spark, sf, "events"), _working(spark)
    stream = streams.sessions(streams.read_stream(spark, f"{sf}/events.parquet", e.schema), "6 hours")
    done = streams.complete_to_table(stream, spark, f"{work}/out", f"{work}/state")
    return done.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end_", F.col("end_").cast("timestamp_ntz"))


@query("streaming_wave_barrier", "SELECT event_type, count(*) AS applied FROM events GROUP BY event_type")
def streaming_wave_barrier(spark: SparkSession, sf: str) -> DataFrame:
    """Each micro-batch is a wave, applied sorted at its barrier and appended to the state table."""
    e, work = t(spark, sf, "events"), _working(spark)

    def apply(batch: DataFrame, wave: int) -> None:
        batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("wave", F.lit(wave)).write.mode("append").parquet(f"{work}/state")

    streams.wave_barrier(streams.read_stream(spark, f"{sf}/events.parquet", e.schema), apply, f"{work}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{work}/state").groupBy("event_type").agg(F.sum("n").alias("applied"))
