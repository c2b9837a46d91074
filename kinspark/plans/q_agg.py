"""Queries: aggregates, votes and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinspark.operators import scores, votes
from kinspark.plans.common import UNITS, sides, t, units
from kinspark.plans.registry import query


@query("hash_buckets", UNITS + " SELECT h, count(*) AS n, array_to_string(list_sort(list(CAST(id AS VARCHAR))), ',') AS ids FROM u GROUP BY h")
def hash_buckets(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.array_join(F.array_sort(F.collect_list(F.col("id").cast("string"))), ",")
    return units(spark, sf).groupBy("h").agg(F.count(F.lit(1)).alias("n"), ids.alias("ids"))


@query("occurrence_counts", "SELECT p_name AS name, count(*) AS n FROM part GROUP BY p_name")
def occurrence_counts(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))


_VOTES = "WITH v AS (SELECT l_partkey AS slot, s_nationkey AS value, l_discount >= 0.05 AS exact FROM lineitem JOIN supplier ON s_suppkey = l_suppkey), y AS (SELECT slot, value, count(*) AS total, count(*) FILTER (exact) AS exact FROM v GROUP BY ALL)"


def _votes(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers' nations as witnesses of a part."""
    li, s = t(spark, sf, "lineitem"), t(spark, sf, "supplier")
    return li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("slot"), F.col("s_nationkey").alias("value"), (F.col("l_discount") >= 0.05).alias("exact"))


@query("vote_tally", _VOTES + " SELECT * FROM y")
def vote_tally(spark: SparkSession, sf: str) -> DataFrame:
    return votes.tally(_votes(spark, sf), "slot", "value", "exact")


@query("top_vote", _VOTES + " SELECT slot, value, total FROM (SELECT *, max(total) OVER (PARTITION BY slot) AS m, count(*) OVER (PARTITION BY slot, total) AS ties FROM y) WHERE total = m AND ties = 1 AND total >= 2")
def top_vote(spark: SparkSession, sf: str) -> DataFrame:
    return votes.top_vote(_votes(spark, sf), "slot", "value", 2)


@query(
    "ranked_suggestion",
    _VOTES + " SELECT slot, value, exact, total FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY exact DESC, total DESC) AS r, count(*) OVER (PARTITION BY slot, exact, total) AS ties FROM y WHERE total >= 2) WHERE r = 1 AND ties = 1",
)
def ranked_suggestion(spark: SparkSession, sf: str) -> DataFrame:
    return votes.ranked_suggestion(votes.tally(_votes(spark, sf), "slot", "value", "exact"), "slot", "value", 2)


@query("claimant_counts", "SELECT name, count(DISTINCT slot) AS claimants FROM (SELECT s_nationkey AS name, l_partkey AS slot FROM lineitem JOIN supplier ON s_suppkey = l_suppkey UNION ALL SELECT c_nationkey, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey) GROUP BY name")
def claimant_counts(spark: SparkSession, sf: str) -> DataFrame:
    li, o, c = (t(spark, sf, x) for x in ("lineitem", "orders", "customer"))
    one = _votes(spark, sf).select(F.col("value").alias("name"), "slot")
    two = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("name"), F.col("l_partkey").alias("slot"))
    return votes.claimants([one, two], "name", "slot")


@query(
    "single_vote_pin",
    _VOTES
    + """, one AS (SELECT slot, min(value) AS value, sum(total) AS total, sum(exact) AS exact, count(*) AS names FROM y GROUP BY slot), c AS (SELECT value, count(*) AS claimants FROM one WHERE names = 1 GROUP BY value)
SELECT one.slot, one.value, CASE WHEN names > 1 THEN 'many names' WHEN total > 1 THEN 'many votes' WHEN exact = 0 THEN 'not exact' WHEN claimants > 1 THEN 'contested' ELSE 'pinned' END AS outcome FROM one LEFT JOIN c USING (value)""",
)
def single_vote_pin(spark: SparkSession, sf: str) -> DataFrame:
    """A name holds only if it is the slot's one name, from one exact vote, and no other slot claims it; else why not."""
    one = votes.tally(_votes(spark, sf), "slot", "value", "exact").groupBy("slot").agg(F.min("value").alias("value"), F.sum("total").alias("total"), F.sum("exact").alias("exact"), F.count(F.lit(1)).alias("names"))
    c = one.where("names = 1").groupBy("value").agg(F.count(F.lit(1)).alias("claimants"))
    outcome = F.when(F.col("names") > 1, "many names").when(F.col("total") > 1, "many votes").when(F.col("exact") == 0, "not exact").when(F.col("claimants") > 1, "contested").otherwise("pinned")
    return one.join(c, "value", "left").select("slot", "value", outcome.alias("outcome"))


@query("indegree_idf", "WITH d AS (SELECT l_partkey AS dst, count(DISTINCT l_orderkey) AS indegree FROM lineitem GROUP BY 1), n AS (SELECT count(*) AS n FROM orders) SELECT dst, indegree, round(ln(n / (1 + indegree)), 9) AS idf FROM d, n")
def indegree_idf(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("dst"), "l_orderkey").distinct().groupBy("dst").agg(F.count(F.lit(1)).alias("indegree"))
    n = t(spark, sf, "orders").agg(F.count(F.lit(1)).alias("n"))
    return d.crossJoin(F.broadcast(n)).select("dst", "indegree", F.round(F.log(F.col("n") / (1 + F.col("indegree"))), 9).alias("idf"))


@query("inbound_references", "SELECT s_nationkey AS segment, count(*) AS inbound FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_nationkey <> s_nationkey GROUP BY 1")
def inbound_references(spark: SparkSession, sf: str) -> DataFrame:
    """References into a segment (nation of the supplier) from outside it."""
    li, s, o, c = (t(spark, sf, x) for x in ("lineitem", "supplier", "orders", "customer"))
    j = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.where("c_nationkey <> s_nationkey").groupBy(F.col("s_nationkey").alias("segment")).agg(F.count(F.lit(1)).alias("inbound"))


@query("coverage_rollup", "SELECT o_orderpriority AS strategy, count(*) AS functions, count(*) FILTER (o_orderstatus = 'F') AS settled, count(DISTINCT o_custkey) AS holders, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END), 2) AS open_value FROM orders GROUP BY 1")
def coverage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("strategy"))
    return o.agg(
        F.count(F.lit(1)).alias("functions"), F.count_if(F.col("o_orderstatus") == "F").cast("long").alias("settled"), F.count_distinct("o_custkey").alias("holders"),
        F.round(F.sum(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).otherwise(0.0)), 2).alias("open_value"),
    )


_CENSUS = r"""WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+[0-9_$*%#&!|]*')) AS tok FROM documents)
SELECT CASE WHEN regexp_matches(tok, '[*%#&!|$]+$') THEN 'decorated' WHEN length(tok) <= 2 THEN 'short' WHEN regexp_matches(tok, '[0-9]') THEN 'numbered' WHEN regexp_matches(tok, '^[A-Z]+$') THEN 'upper' ELSE 'plain' END AS family, count(*) AS n, count(DISTINCT tok) AS names FROM w GROUP BY 1"""


@query("minted_census", _CENSUS)
def minted_census(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens by family, decorated ones first."""
    w = t(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+[0-9_$*%#&!|]*"), F.lit(0))).alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("c"))
    tok = F.col("tok")
    family = F.when(tok.rlike("[*%#&!|$]+$"), "decorated").when(F.length(tok) <= 2, "short").when(tok.rlike("[0-9]"), "numbered").when(tok.rlike("^[A-Z]+$"), "upper").otherwise("plain")
    return w.groupBy(family.alias("family")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("names"))


@query("diagnostics_patterns", "SELECT event_type, CAST(floor(value / 10) AS BIGINT) AS band, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL ORDER BY n DESC, event_type, band LIMIT 20")
def diagnostics_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty largest groups (a report of the top)."""
    g = t(spark, sf, "events").groupBy("event_type", F.floor(F.col("value") / 10).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))
    return g.orderBy(F.desc("n"), "event_type", "band").limit(20)


@query(
    "credit_pools",
    "WITH c AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1), r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events WHERE event_type = 'click') SELECT event_id, user_id, coalesce(nth <= n, false) AS served FROM r LEFT JOIN c USING (user_id)",
)
def credit_pools(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events")
    credits = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return votes.credit_pools(e.where("event_type = 'click'").select("event_id", "user_id"), credits, "user_id", "event_id")


_CONT = "WITH c AS (SELECT d.source AS true_group, d.lang || '/' || l.quality AS pred_group, count(*) AS n FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL)"


def _contingency(spark: SparkSession, sf: str) -> DataFrame:
    d, la = t(spark, sf, "documents"), t(spark, sf, "labels")
    pred = d.join(la, "doc_id").select("doc_id", F.concat_ws("/", "lang", F.col("quality").cast("string")).alias("cluster"))
    return scores.contingency(d, pred, "doc_id", "source", "cluster")


@query("contingency_table", _CONT + " SELECT true_group, pred_group, n FROM c")
def contingency_table(spark: SparkSession, sf: str) -> DataFrame:
    return _contingency(spark, sf)


@query(
    "adjusted_rand_index",
    _CONT
    + """, s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS c, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY true_group)) AS a,
  (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY pred_group)) AS b, (SELECT sum(n) FROM c) AS m)
SELECT round(CASE WHEN m <= 1 OR (a + b) / 2 = a * b / (m * (m - 1) / 2) THEN 1.0 ELSE (c - a * b / (m * (m - 1) / 2)) / ((a + b) / 2 - a * b / (m * (m - 1) / 2)) END, 9) AS ari FROM s""",
)
def adjusted_rand_index(spark: SparkSession, sf: str) -> DataFrame:
    return scores.adjusted_rand(_contingency(spark, sf)).select(F.round("ari", 9).alias("ari"))


@query(
    "v_measure",
    _CONT
    + """, m AS (SELECT sum(n) AS m FROM c), t AS (SELECT true_group, sum(n) AS nt FROM c GROUP BY true_group), p AS (SELECT pred_group, sum(n) AS np FROM c GROUP BY pred_group),
e AS (SELECT (SELECT sum(-(nt / m) * ln(nt / m)) FROM t, m) AS ht, (SELECT sum(-(np / m) * ln(np / m)) FROM p, m) AS hp,
  (SELECT sum(-(n / m) * ln(n / np)) FROM c JOIN p USING (pred_group), m) AS htp, (SELECT sum(-(n / m) * ln(n / nt)) FROM c JOIN t USING (true_group), m) AS hpt),
q AS (SELECT CASE WHEN ht = 0 THEN 1.0 ELSE 1 - htp / ht END AS h, CASE WHEN hp = 0 THEN 1.0 ELSE 1 - hpt / hp END AS k FROM e)
SELECT round(h, 9) AS homogeneity, round(k, 9) AS completeness, round(CASE WHEN h + k = 0 THEN 0.0 ELSE 2 * h * k / (h + k) END, 9) AS v FROM q""",
)
def v_measure(spark: SparkSession, sf: str) -> DataFrame:
    v = scores.v_measure(_contingency(spark, sf))
    return v.select(*[F.round(c, 9).alias(c) for c in ("homogeneity", "completeness", "v")])


@query("purity", _CONT + " SELECT round((SELECT sum(m) / sum(n) FROM (SELECT max(n) AS m, sum(n) AS n FROM c GROUP BY pred_group)), 9) AS purity, round((SELECT sum(m) / sum(n) FROM (SELECT max(n) AS m, sum(n) AS n FROM c GROUP BY true_group)), 9) AS inverse_purity")
def purity(spark: SparkSession, sf: str) -> DataFrame:
    return scores.purity(_contingency(spark, sf)).select(F.round("purity", 9).alias("purity"), F.round("inverse_purity", 9).alias("inverse_purity"))


@query("per_group_breakdown", _CONT + " SELECT true_group, first(pred_group ORDER BY n DESC, pred_group) AS dominant, CAST(sum(n) AS BIGINT) AS n, round(max(n) / sum(n), 9) AS completeness FROM c GROUP BY true_group")
def per_group_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return scores.breakdown(_contingency(spark, sf)).withColumn("completeness", F.round("completeness", 9))


@query(
    "tree_similarity",
    UNITS + ", x AS (SELECT DISTINCT source, lang FROM a), y AS (SELECT DISTINCT source, lang FROM b) SELECT (SELECT count(*) FROM x JOIN y USING (source, lang)) AS shared, round((SELECT count(*) FROM x JOIN y USING (source, lang)) / (SELECT count(*) FROM (SELECT * FROM x UNION SELECT * FROM y)), 9) AS jaccard",
)
def tree_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Jaccard of the directory edges of two trees."""
    u = units(spark, sf).groupBy("source", "lang").agg(F.max(F.when(F.col("side") == 0, 1).otherwise(0)).alias("x"), F.max(F.when(F.col("side") == 1, 1).otherwise(0)).alias("y"))
    both = F.count_if((F.col("x") == 1) & (F.col("y") == 1))
    return u.agg(both.cast("long").alias("shared"), F.round(both / F.count(F.lit(1)), 9).alias("jaccard"))


@query(
    "validation_scores",
    UNITS
    + """, k AS (SELECT h, count(*) FILTER (side = 0) AS na, count(*) FILTER (side = 1) AS nb FROM u GROUP BY h),
r AS (SELECT count(*) FILTER (na = 1 AND nb = 1) AS reused, count(*) FILTER (na > 0 AND nb > 0) AS unchanged, count(*) FILTER (na > 0 AND nb = 0) AS removed, count(*) FILTER (na = 0) AS added FROM k)
SELECT round(CASE WHEN unchanged = 0 THEN 1.0 ELSE reused / unchanged END, 9) AS reuse, round(CASE WHEN unchanged + removed = 0 THEN 1.0 ELSE unchanged / (unchanged + removed) END, 9) AS precision,
  round(CASE WHEN unchanged + added = 0 THEN 1.0 ELSE unchanged / (unchanged + added) END, 9) AS recall FROM r""",
)
def validation_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores with empty denominators counting as 1."""
    k = units(spark, sf).groupBy("h").agg(F.count_if(F.col("side") == 0).alias("na"), F.count_if(F.col("side") == 1).alias("nb"))
    r = k.agg(
        F.count_if((F.col("na") == 1) & (F.col("nb") == 1)).alias("reused"), F.count_if((F.col("na") > 0) & (F.col("nb") > 0)).alias("unchanged"),
        F.count_if((F.col("na") > 0) & (F.col("nb") == 0)).alias("removed"), F.count_if(F.col("na") == 0).alias("added"),
    )
    share = lambda a, b, n: F.round(F.when(b == 0, 1.0).otherwise(a / b), 9).alias(n)
    un = F.col("unchanged")
    return r.select(share(F.col("reused"), un, "reuse"), share(un, un + F.col("removed"), "precision"), share(un, un + F.col("added"), "recall"))


@query("nearest_rank_percentile", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def nearest_rank_percentile(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest rank: a value of the data, not an interpolation."""
    at = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)").alias(f"p{round(q * 100)}")
    return t(spark, sf, "events").groupBy("event_type").agg(at(0.5), at(0.95), at(0.99))


@query("stage_summaries", "SELECT event_type AS stage, count(*) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, max(ts) AS last FROM events GROUP BY event_type")
def stage_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.max("ts").alias("last"))


@query("kpi_totals", "SELECT source, sum(coalesce(quality, 0)) AS total, count(quality) AS contributors, count(*) AS rows_ FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def kpi_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Sums in which an absent score is not a zero: contributors are counted."""
    j = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left")
    return j.groupBy("source").agg(F.sum(F.coalesce("quality", F.lit(0))).alias("total"), F.count("quality").alias("contributors"), F.count(F.lit(1)).alias("rows_"))


@query("noise_bands", "SELECT source, CASE WHEN count(*) >= 2 THEN max(m) - min(m) END AS band FROM (SELECT source, lang, max(n_chars) AS m FROM documents GROUP BY ALL) GROUP BY source")
def noise_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Largest pairwise difference of a group's repeats; null below two."""
    m = t(spark, sf, "documents").groupBy("source", "lang").agg(F.max("n_chars").alias("m"))
    return m.groupBy("source").agg(F.when(F.count(F.lit(1)) >= 2, F.max("m") - F.min("m")).alias("band"))


@query("library_counts", r"SELECT coalesce(nullif(regexp_extract(text, '(Apache License|MIT License|GNU General Public License|BSD)', 1), ''), 'unknown') AS library, count(*) AS files FROM documents GROUP BY 1")
def library_counts(spark: SparkSession, sf: str) -> DataFrame:
    name = F.regexp_extract("text", "(Apache License|MIT License|GNU General Public License|BSD)", 1)
    return t(spark, sf, "documents").groupBy(F.when(name == "", "unknown").otherwise(name).alias("library")).agg(F.count(F.lit(1)).alias("files"))


@query("env_read_inventory", "SELECT k AS name, count(*) AS reads, count(DISTINCT user_id) AS readers, min(ts) AS first FROM (SELECT unnest(regexp_extract_all(props, '\"([a-z]+)\"', 1)) AS k, user_id, ts FROM events) GROUP BY k")
def env_read_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Findings by key: extracted, grouped, deduplicated."""
    e = t(spark, sf, "events").select(F.explode(F.regexp_extract_all("props", F.lit('"([a-z]+)"'), F.lit(1))).alias("name"), "user_id", "ts")
    return e.groupBy("name").agg(F.count(F.lit(1)).alias("reads"), F.count_distinct("user_id").alias("readers"), F.min("ts").alias("first"))


_LEDGER = UNITS + """, k AS (SELECT h, count(*) FILTER (side = 0) AS na, count(*) FILTER (side = 1) AS nb, count(DISTINCT text) AS forms FROM u GROUP BY h),
m AS (SELECT source, lang, min(id) FILTER (side = 0) AS old_id, min(id) FILTER (side = 1) AS new_id, count(*) FILTER (side = 0) AS ra, count(*) FILTER (side = 1) AS rb
  FROM (SELECT u.*, n_chars % 53 AS slot FROM u JOIN k USING (h) WHERE na = 0 OR nb = 0) GROUP BY source, lang, slot)
"""


@query(
    "diff_ledger",
    _LEDGER
    + """SELECT bucket, count(*) AS n FROM (
  SELECT CASE WHEN side = 1 AND na = 0 THEN (CASE WHEN id IN (SELECT new_id FROM m WHERE ra = 1 AND rb = 1) THEN 'modified' ELSE 'added' END)
    WHEN side = 0 AND nb = 0 THEN (CASE WHEN id IN (SELECT old_id FROM m WHERE ra = 1 AND rb = 1) THEN 'modified' ELSE 'removed' END)
    WHEN forms = 1 THEN 'clean' WHEN na = 1 AND nb = 1 THEN 'noise' ELSE 'family' END AS bucket FROM u JOIN k USING (h)) GROUP BY bucket""",
)
def diff_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Every record in exactly one bucket; added and removed records that are alone in their slot pair up as modified."""
    u = units(spark, sf)
    k = u.groupBy("h").agg(F.count_if(F.col("side") == 0).alias("na"), F.count_if(F.col("side") == 1).alias("nb"), F.when(F.min(F.sha2("text", 256)) == F.max(F.sha2("text", 256)), 1).otherwise(2).alias("forms"))
    j = u.join(k, "h").withColumn("lone", (F.col("na") == 0) | (F.col("nb") == 0)).withColumn("slot", F.col("n_chars") % 53)
    w = Window.partitionBy("source", "lang", "slot", "lone")
    one = (F.sum((F.col("side") == 0).cast("int")).over(w) == 1) & (F.sum((F.col("side") == 1).cast("int")).over(w) == 1)
    bucket = (
        F.when(F.col("lone") & one, "modified").when(F.col("na") == 0, "added").when(F.col("nb") == 0, "removed").when(F.col("forms") == 1, "clean")
        .when((F.col("na") == 1) & (F.col("nb") == 1), "noise").otherwise("family")
    )
    return j.select(bucket.alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query(
    "clone_census",
    r"""WITH m AS (SELECT doc_id, source, line FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents)),
k AS (SELECT regexp_replace(line, '[A-Za-z0-9_]+', '_', 'g') AS masked, source FROM m WHERE length(regexp_replace(line, '[A-Za-z0-9_]+', '_', 'g')) >= 15)
SELECT substr(sha256(masked), 1, 16) AS h, count(*) AS n, count(DISTINCT source) AS files FROM k GROUP BY masked HAVING count(DISTINCT source) > 1""",
)
def clone_census(spark: SparkSession, sf: str) -> DataFrame:
    """Masked lines that occur in more than one source."""
    d = t(spark, sf, "documents").select("source", F.explode(F.split("text", "\n")).alias("line"))
    m = d.select("source", F.regexp_replace("line", "[A-Za-z0-9_]+", "_").alias("masked")).where(F.length("masked") >= 15)
    g = m.groupBy("masked").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("files")).where("files > 1")
    return g.select(F.substring(F.sha2("masked", 256), 1, 16).alias("h"), "n", "files")


@query(
    "family_permutation_candidates",
    UNITS
    + """, f AS (SELECT h FROM a GROUP BY h HAVING count(*) >= 2),
p AS (SELECT x.id AS old_id, y.id AS new_id, CAST(x.source = y.source AS INT) + CAST(x.lang = y.lang AS INT) AS support FROM a x JOIN b y USING (h) WHERE h IN (SELECT h FROM f))
SELECT old_id, new_id, support FROM p WHERE support >= 1""",
)
def family_permutation_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs inside families of two or more prior records, with how many contexts they share."""
    a, b = sides(units(spark, sf))
    f = a.groupBy("h").count().where("count >= 2").select("h")
    x = a.join(f, "h", "left_semi").select("h", F.col("id").alias("old_id"), F.col("source").alias("s1"), F.col("lang").alias("l1"))
    y = b.select("h", F.col("id").alias("new_id"), F.col("source").alias("s2"), F.col("lang").alias("l2"))
    support = (F.col("s1") == F.col("s2")).cast("int") + (F.col("l1") == F.col("l2")).cast("int")
    return x.join(y, "h").select("old_id", "new_id", support.alias("support")).where("support >= 1")
