"""Queries: similarity joins, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinspark.functions import scalars, similarity
from kinspark.operators import gates
from kinspark.operators import similarity_join as sim
from kinspark.plans.common import TOKENS, UNITS, sides, t, units
from kinspark.plans.registry import query

_SETS = UNITS + r""",
i AS (SELECT id, side, source, list_distinct(list_filter(string_split(text, chr(10)), lambda x: length(x) >= 12)) AS items FROM u),
x AS (SELECT id AS a_id, len(items) AS n_a, unnest(items) AS v FROM i WHERE side = 0), y AS (SELECT id AS b_id, len(items) AS n_b, unnest(items) AS v FROM i WHERE side = 1),
p AS (SELECT a_id, b_id, count(*) AS inter, min(n_a) AS n_a, min(n_b) AS n_b FROM x JOIN y USING (v) GROUP BY a_id, b_id),
j AS (SELECT *, inter / (n_a + n_b - inter) AS score FROM p)
"""


def _item_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents as sets of their longer lines."""
    return sides(units(spark, sf).withColumn("items", F.array_distinct(F.filter(F.split("text", "\n"), lambda x: F.length(x) >= 12))))


_BEST = """
SELECT a_id, b_id, round(score, 9) AS score FROM (
  SELECT *, max(score) OVER (PARTITION BY a_id) AS ma, max(score) OVER (PARTITION BY b_id) AS mb,
    count(*) OVER (PARTITION BY a_id, score) AS ta, count(*) OVER (PARTITION BY b_id, score) AS tb FROM {0} WHERE score >= {1})
WHERE score = ma AND score = mb AND ta = 1 AND tb = 1"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 9))


@query("export_set_join", _SETS + _BEST.format("j", 0.6))
def export_set_join(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(sim.export_set_join(*_item_sides(spark, sf)))


@query("containment_join", _SETS + ", c AS (SELECT a_id, b_id, inter / least(n_a, n_b) AS score FROM j WHERE least(n_a, n_b) >= 2 AND score >= 0.4)" + _BEST.format("c", 0.75))
def containment_join(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(sim.containment_join(*_item_sides(spark, sf)))


@query(
    "graded_join",
    _SETS
    + """SELECT a_id, b_id, round(score, 9) AS score FROM (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS second FROM j WINDOW w AS (PARTITION BY a_id ORDER BY score DESC, b_id))
WHERE r = 1 AND score >= 0.5 AND (second IS NULL OR score >= 1.5 * second)""",
)
def graded_join(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(sim.graded_join(*_item_sides(spark, sf)))


@query(
    "multiset_overlap_join",
    UNITS
    + """,
i AS (SELECT id, side, list_filter(string_split(text, chr(10)), lambda x: length(x) >= 12) AS items FROM u),
x AS (SELECT a_id, n_a, v, count(*) AS c FROM (SELECT id AS a_id, len(items) AS n_a, unnest(items) AS v FROM i WHERE side = 0) GROUP BY ALL),
y AS (SELECT b_id, n_b, v, count(*) AS c FROM (SELECT id AS b_id, len(items) AS n_b, unnest(items) AS v FROM i WHERE side = 1) GROUP BY ALL),
p AS (SELECT a_id, b_id, n_a, n_b, sum(least(x.c, y.c)) AS inter FROM x JOIN y USING (v) GROUP BY ALL)
SELECT a_id, b_id, round(inter / (n_a + n_b - inter), 9) AS score FROM p WHERE inter / (n_a + n_b - inter) >= 0.5""",
)
def multiset_overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    u = units(spark, sf).withColumn("items", F.filter(F.split("text", "\n"), lambda x: F.length(x) >= 12))
    return _rounded(sim.multiset_join(*sides(u)))


_ANCHOR = UNITS + """,
i AS (SELECT id, side, text, list_distinct(list_filter(string_split(text, chr(10)), lambda x: length(x) >= 12)) AS lits, """ + TOKENS.format("text") + """ AS toks FROM u),
x AS (SELECT v, min(id) AS a_id FROM (SELECT id, unnest(lits) AS v FROM i WHERE side = 0) GROUP BY v HAVING count(*) = 1),
y AS (SELECT v, min(id) AS b_id FROM (SELECT id, unnest(lits) AS v FROM i WHERE side = 1) GROUP BY v HAVING count(*) = 1),
v AS (SELECT b_id, min(a_id) AS a_id FROM x JOIN y USING (v) GROUP BY b_id HAVING min(a_id) = max(a_id)),
s AS (
  SELECT a_id, b_id, p.text AS old_text, q.text AS new_text,
    CASE WHEN greatest(len(p.toks), len(q.toks)) = 0 THEN 0.0 ELSE len(list_intersect(p.toks, q.toks)) / greatest(len(p.toks), len(q.toks)) END AS score
  FROM v JOIN i p ON p.id = a_id JOIN i q ON q.id = b_id),
anchored AS (SELECT a_id, b_id, old_text, new_text, round(score, 9) AS score FROM (SELECT *, count(*) OVER (PARTITION BY a_id) AS n FROM s WHERE score >= 0.5) WHERE n = 1)
"""


def anchors(spark: SparkSession, sf: str) -> DataFrame:
    u = units(spark, sf).withColumn("literals", F.array_distinct(F.filter(F.split("text", "\n"), lambda x: F.length(x) >= 12))).withColumn("items", scalars.token_set(F.col("text")))
    return _rounded(sim.content_anchor(*sides(u)))


@query("content_anchor", _ANCHOR + "SELECT a_id, b_id, score FROM anchored")
def content_anchor(spark: SparkSession, sf: str) -> DataFrame:
    return anchors(spark, sf)


@query(
    "content_anchor_near_identical",
    _ANCHOR
    + """SELECT a_id, b_id, round(f, 9) AS changed, f <= 0.1 AS near_identical FROM (
  SELECT a_id, b_id, len(list_filter(string_split(new_text, chr(10)), lambda l: NOT list_contains(string_split(old_text, chr(10)), l))) / greatest(len(string_split(new_text, chr(10))), 1) AS f FROM anchored)""",
)
def content_anchor_near_identical(spark: SparkSession, sf: str) -> DataFrame:
    """Anchored pairs with the share of lines that changed."""
    u = units(spark, sf).select("id", "text")
    a = anchors(spark, sf).join(u.withColumnRenamed("id", "a_id").withColumnRenamed("text", "old"), "a_id").join(u.withColumnRenamed("id", "b_id").withColumnRenamed("text", "new"), "b_id")
    f = scalars.changed_line_share(F.col("new"), F.col("old"))
    return a.select("a_id", "b_id", F.round(f, 9).alias("changed"), (f <= 0.1).alias("near_identical"))


_LETTERS = "etaoinsrhldu"
_COSINE = UNITS + """,
v0 AS (SELECT id, side, """ + ", ".join(f"length(text) - length(replace(text, '{c}', '')) AS {c}" for c in _LETTERS) + """ FROM u),
v AS (SELECT *, sqrt(CAST(""" + " + ".join(f"{c} * {c}" for c in _LETTERS) + """ AS DOUBLE)) AS norm_ FROM v0),
p AS (SELECT a.id AS a_id, b.id AS b_id, CASE WHEN a.norm_ * b.norm_ = 0 THEN 0.0 ELSE round((""" + " + ".join(f"a.{c} * b.{c}" for c in _LETTERS) + """) / (a.norm_ * b.norm_), 9) END AS score FROM v a JOIN v b ON a.side = 0 AND b.side = 1),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) AS r FROM p WHERE score >= {0}) WHERE r <= 3)
"""


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents as counts of twelve letters: a feature vector as the close matcher has it."""
    count = [(F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))).cast("double") for c in _LETTERS]
    return sides(units(spark, sf).select("id", "side", F.array(*count).alias("vector")))


@query("cosine_top3", _COSINE.format(0.8) + "SELECT a_id, b_id, round(score, 6) AS score FROM k")
def cosine_top3(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _vectors(spark, sf)
    return sim.cosine_top(a, b, 3, 0.8).withColumn("score", F.round("score", 6))


@query("close_match")
def close_match(spark: SparkSession, sf: str) -> DataFrame:
    """Top three by cosine of 0.8 or more, then greedy one to one with mutual abstention, in rounds. No SQL: tests compare it with one list worked off in order."""
    a, b = _vectors(spark, sf)
    return sim.greedy_assign(sim.cosine_top(a, b, 3, 0.8))


@query(
    "stem_join",
    _SETS
    + """, st AS (SELECT id, side, source || '/' || lang || '/' || (n_chars // 20) AS stem FROM u)
SELECT a_id, b_id, round(score, 9) AS score FROM (SELECT stem, min(id) AS a_id FROM st WHERE side = 0 GROUP BY stem HAVING count(*) = 1) JOIN (SELECT stem, min(id) AS b_id FROM st WHERE side = 1 GROUP BY stem HAVING count(*) = 1) USING (stem)
JOIN j USING (a_id, b_id) WHERE score >= 0.7""",
)
def stem_join(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _item_sides(spark, sf)
    stem = F.concat_ws("/", "source", "lang", F.floor(F.col("n_chars") / 20).cast("string"))
    return _rounded(sim.stem_join(a.withColumn("stem", stem), b.withColumn("stem", stem)))


_POSITION = """
WITH e AS (SELECT DISTINCT o_orderkey AS src, o_custkey AS dst FROM orders UNION SELECT DISTINCT l_orderkey, 1000000000 + l_suppkey FROM lineitem),
m AS (SELECT DISTINCT dst AS a_id, dst AS b_id FROM e),
g AS (SELECT x.src AS a_id, y.src AS b_id, count(*) AS score FROM e x JOIN e y USING (dst) WHERE x.src % 2 = 0 AND y.src % 2 = 1 AND x.dst < 1000000000 GROUP BY ALL)
"""


@query("graph_position_join", _POSITION + _BEST.format("(SELECT a_id, b_id, score FROM g)", 0).replace("round(score, 9) AS score", "score"))
def graph_position_join(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of two snapshots that sit at the same customers: agreeing neighbours, strict best both ways."""
    e = t(spark, sf, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst")).distinct()
    m = e.select(F.col("dst").alias("a_id"), F.col("dst").alias("b_id")).distinct()
    near_a, near_b = e.where("src % 2 = 0"), e.where("src % 2 = 1")
    agree = near_a.join(m, near_a.dst == m.a_id).select(F.col("src").alias("a_id"), F.col("b_id").alias("dst")).join(near_b.select(F.col("src").alias("b_id"), "dst"), "dst")
    scored = agree.groupBy("a_id", "b_id").agg(F.count(F.lit(1)).alias("score"))
    return gates.mutual_best(scored, "a_id", "b_id", "score", 0.0).select("a_id", "b_id", "score")


@query(
    "heir_veto",
    _SETS
    + """, good AS (SELECT a_id, count(*) AS heirs FROM j WHERE score >= 0.6 GROUP BY a_id),
weak AS (SELECT DISTINCT a.id AS a_id, b.id AS b_id FROM a JOIN b ON a.source = b.source AND a.lang = b.lang AND a.n_chars // 100 = b.n_chars // 100)
SELECT a_id, b_id FROM weak JOIN i p ON p.id = a_id JOIN i q ON q.id = b_id WHERE NOT (a_id IN (SELECT a_id FROM good) AND len(p.items) > 0 AND len(q.items) > 0 AND len(list_intersect(p.items, q.items)) = 0)""",
)
def heir_veto(spark: SparkSession, sf: str) -> DataFrame:
    """Weak candidates, without those that share nothing while a real heir of the prior record exists."""
    a, b = _item_sides(spark, sf)
    a, b = (s.withColumn("band", F.floor(F.col("n_chars") / 100)) for s in (a, b))
    heirs = sim.similar_sets(a, b, 0.6).select(F.col("a_id").alias("id")).distinct().withColumn("heir", F.lit(True))
    hashed = F.transform("items", lambda x: F.xxhash64(x))
    a = a.select("id", "source", "lang", "band", hashed.alias("x")).join(heirs, "id", "left")
    # Only sets of which an emptied overlap would veto meet the others item by item.
    x = a.select(F.col("id").alias("a_id"), "source", "lang", "band", F.when(F.col("heir") & (F.size("x") > 0), F.col("x")).alias("x"))
    y = b.select(F.col("id").alias("b_id"), "source", "lang", "band", hashed.alias("y"))
    kept = F.col("x").isNull() | (F.size("y") == 0) | F.arrays_overlap("x", "y")
    return x.join(y, ["source", "lang", "band"]).where(kept).select("a_id", "b_id")


_WORDS4 = "regexp_extract_all(lower(text), '[a-z0-9]{2,}')"


@query(
    "role_agreement",
    UNITS
    + f""", r AS (SELECT id, {_WORDS4} AS w FROM u), w AS (SELECT id, unnest(w) AS v, unnest(generate_series(1, len(w))) AS i FROM r),
g AS (SELECT id, v || ' ' || lead(v, 1) OVER q || ' ' || lead(v, 2) OVER q || ' ' || lead(v, 3) OVER q AS x FROM w WINDOW q AS (PARTITION BY id ORDER BY i)),
d AS (SELECT id, list(DISTINCT x) AS sh FROM g WHERE x IS NOT NULL GROUP BY id),
s AS (SELECT u.id, side, h, source, lang, n_chars // 100 AS band, coalesce(sh, []) AS sh FROM u LEFT JOIN d USING (id))
SELECT x.id AS old_id, y.id AS new_id, CASE WHEN x.h = y.h THEN 'hash' WHEN len(x.sh) = 0 AND len(y.sh) = 0 THEN 'absent' WHEN len(x.sh) = 0 OR len(y.sh) = 0 THEN 'one-sided'
  WHEN len(list_intersect(x.sh, y.sh)) / len(list_distinct(x.sh || y.sh)) >= 0.5 THEN 'content' ELSE 'differs' END AS role
FROM s x JOIN s y ON x.side = 0 AND y.side = 1 AND x.source = y.source AND x.lang = y.lang AND x.band = y.band""",
)
def role_agreement(spark: SparkSession, sf: str) -> DataFrame:
    u = units(spark, sf).withColumn("sh", scalars.shingles(scalars.tokens(F.col("text"), 2), 4)).withColumn("band", F.floor(F.col("n_chars") / 100))
    a, b = sides(u)
    x = a.select(F.col("id").alias("old_id"), "source", "lang", "band", F.col("h").alias("hx"), F.col("sh").alias("sx"))
    y = b.select(F.col("id").alias("new_id"), "source", "lang", "band", F.col("h").alias("hy"), F.col("sh").alias("sy"))
    role = (
        F.when(F.col("hx") == F.col("hy"), "hash").when((F.size("sx") == 0) & (F.size("sy") == 0), "absent").when((F.size("sx") == 0) | (F.size("sy") == 0), "one-sided")
        .when(similarity.jaccard_any_empty_zero("sx", "sy") >= 0.5, "content").otherwise("differs")
    )
    return x.join(y, ["source", "lang", "band"]).select("old_id", "new_id", role.alias("role"))


@query(
    "edge_ngrams",
    r"SELECT conv_id, array_to_string(list_sort(list_distinct(list_transform(generate_series(1, len(rs) - 1), lambda i: rs[i] || '>' || rs[i + 1]))), ',') AS ngrams FROM (SELECT conv_id, list(role ORDER BY turn) AS rs FROM conversations GROUP BY conv_id)",
)
def edge_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct steps between the roles of a conversation."""
    rs = t(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("rs"))
    steps = F.zip_with(F.slice("rs", F.lit(1), F.size("rs") - 1), F.slice("rs", F.lit(2), F.size("rs") - 1), lambda x, y: F.concat(x, F.lit(">"), y))
    return rs.select("conv_id", F.array_join(F.array_sort(F.array_distinct(steps)), ",").alias("ngrams"))


_SIM = UNITS + ", " + "s AS (SELECT id, side, source, lang, n_chars // 100 AS band, " + TOKENS.format("text") + " AS k FROM u), q AS (SELECT x.id AS a_id, y.id AS b_id, x.k AS x, y.k AS y FROM s x JOIN s y ON x.side = 0 AND y.side = 1 AND x.source = y.source AND x.lang = y.lang AND x.band = y.band)"


@query(
    "set_similarities",
    _SIM
    + """ SELECT a_id, b_id, CAST(len(list_intersect(x, y)) AS BIGINT) AS shared,
  round(CASE WHEN len(list_distinct(x || y)) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / len(list_distinct(x || y)) END, 9) AS jaccard_one,
  round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / len(list_distinct(x || y)) END, 9) AS jaccard_zero,
  round(CASE WHEN least(len(x), len(y)) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / least(len(x), len(y)) END, 9) AS containment,
  round(CASE WHEN greatest(len(x), len(y)) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / greatest(len(x), len(y)) END, 9) AS overlap FROM q""",
)
def set_similarities(spark: SparkSession, sf: str) -> DataFrame:
    """The four definitions side by side on pairs of like size."""
    # Sets travel as 64-bit hashes; the shared ones of a pair are counted once, the rest follows from the sizes.
    u = units(spark, sf).select("id", "side", "source", "lang", F.floor(F.col("n_chars") / 100).alias("band"), F.transform(scalars.token_set(F.col("text")), lambda x: F.xxhash64(x)).alias("k"))
    a, b = sides(u)
    x = a.select(F.col("id").alias("a_id"), "source", "lang", "band", F.col("k").alias("x"))
    y = b.select(F.col("id").alias("b_id"), "source", "lang", "band", F.col("k").alias("y"))
    pairs = x.join(y, ["source", "lang", "band"]).select("a_id", "b_id", similarity.shared("x", "y").cast("long").alias("shared"), F.size("x").alias("n"), F.size("y").alias("m"))
    n, m, union = F.col("n"), F.col("m"), F.col("n") + F.col("m") - F.col("shared")
    over = lambda empty, whole, otherwise=0.0: F.round(F.when(empty, otherwise).otherwise(F.col("shared") / whole), 9)
    return pairs.select(
        "a_id", "b_id", "shared", over(union == 0, union, 1.0).alias("jaccard_one"), over((n == 0) | (m == 0), union).alias("jaccard_zero"),
        over(F.least(n, m) == 0, F.least(n, m)).alias("containment"), over(F.greatest(n, m) == 0, F.greatest(n, m)).alias("overlap"),
    )


@query("multiset_intersection", UNITS + " SELECT source, lang, CAST(sum(least(na, nb)) AS BIGINT) AS inter FROM (SELECT source, lang, h, count(*) FILTER (side = 0) AS na, count(*) FILTER (side = 1) AS nb FROM u GROUP BY ALL) GROUP BY ALL")
def multiset_intersection(spark: SparkSession, sf: str) -> DataFrame:
    g = units(spark, sf).groupBy("source", "lang", "h").agg(F.count_if(F.col("side") == 0).alias("na"), F.count_if(F.col("side") == 1).alias("nb"))
    return g.groupBy("source", "lang").agg(F.sum(F.least("na", "nb")).alias("inter"))


@query("subset_test", "WITH s AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS have FROM events GROUP BY 1), r AS (SELECT list(DISTINCT event_type) AS req FROM events WHERE user_id = (SELECT min(user_id) FROM events)) SELECT user_id, len(list_filter(req, lambda x: NOT list_contains(have, x))) = 0 AS has_all, CAST(len(have) AS BIGINT) AS n FROM s, r")
def subset_test(spark: SparkSession, sf: str) -> DataFrame:
    """Users whose event types hold all of the first user's."""
    e = t(spark, sf, "events")
    first = e.agg(F.min("user_id").alias("user_id"))
    req = e.join(first, "user_id", "left_semi").agg(F.collect_set("event_type").alias("req"))
    s = e.groupBy("user_id").agg(F.collect_set("event_type").alias("have"))
    return s.join(F.broadcast(req)).select("user_id", (F.size(F.array_except("req", "have")) == 0).alias("has_all"), F.size("have").cast("long").alias("n"))


@query("priority_union", _ANCHOR + """, h AS (SELECT min(a.id) AS a_id, b.id AS b_id FROM a JOIN b USING (h) GROUP BY b.id) SELECT b_id, coalesce(h.a_id, anchored.a_id) AS a_id, CASE WHEN h.a_id IS NOT NULL THEN 'hash' ELSE 'anchor' END AS origin FROM h FULL JOIN anchored USING (b_id)""")
def priority_union(spark: SparkSession, sf: str) -> DataFrame:
    """Union of two match maps where the later one (hash) wins."""
    a, b = sides(units(spark, sf))
    h = a.select(F.col("id").alias("a_id"), "h").join(b.select(F.col("id").alias("b_id"), "h"), "h").groupBy("b_id").agg(F.min("a_id").alias("a_id"))
    both = h.withColumn("origin", F.lit("hash")).unionByName(anchors(spark, sf).select("b_id", "a_id", F.lit("anchor").alias("origin")))
    rank = F.row_number().over(Window.partitionBy("b_id").orderBy(F.col("origin").desc()))
    return both.withColumn("_r", rank).where("_r = 1").drop("_r")


@query("candidate_set_groups", UNITS + ", c AS (SELECT a.id AS old_id, array_to_string(list_sort(list(CAST(b.id AS VARCHAR))), '|') AS pool FROM a JOIN b USING (h) GROUP BY a.id) SELECT pool, count(*) AS priors FROM c GROUP BY pool")
def candidate_set_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Prior records grouped by the set of candidates they share."""
    a, b = sides(units(spark, sf))
    pools = b.groupBy("h").agg(scalars.set_key(F.collect_list(F.col("id").cast("string"))).alias("pool"))
    return a.join(pools, "h").groupBy("pool").agg(F.count(F.lit(1)).alias("priors"))


@query(
    "scalar_battery",
    r"""SELECT doc_id, substr(sha256(text), 1, 16) AS h16, substr(sha1(text), 1, 8) AS h8,
  regexp_replace(string_split(text, chr(10))[1], '[A-Za-z0-9_]+', '_', 'g') AS masked_head,
  CAST(floor(log10(abs(n_chars) + 1)) AS BIGINT) AS magnitude,
  lower(regexp_replace(source, '(?:Val|Var|Ref|Item|Data|Value|Instance|Obj|_?[0-9]+)+$', '')) AS stem,
  CASE WHEN regexp_matches(lang || 's', '[^s]s$') THEN regexp_replace(lang || 's', 's$', '') ELSE lang || 's' END AS singular FROM documents""",
)
def scalar_battery(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "documents")
    return d.select(
        "doc_id", scalars.hash16(F.col("text")).alias("h16"), scalars.hash8(F.col("text")).alias("h8"), scalars.mask_words(F.split("text", "\n")[0]).alias("masked_head"),
        scalars.magnitude(F.col("n_chars")).alias("magnitude"), scalars.name_stem(F.col("source")).alias("stem"), scalars.singular(F.concat("lang", F.lit("s"))).alias("singular"),
    )


@query(
    "name_forms",
    r"""SELECT DISTINCT p_name AS name, regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\1-\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1-\2', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS kebab,
  regexp_replace(p_name, '([.*+?^${}()|\[\]\\])', '\\\1', 'g') AS escaped,
  array_to_string(list_transform(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: x <> ''), lambda x, i: CASE WHEN i = 1 THEN x ELSE upper(x[1]) || x[2:] END), '') AS camel FROM part""",
)
def name_forms(spark: SparkSession, sf: str) -> DataFrame:
    n = t(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    return n.select("name", scalars.kebab(F.col("name")).alias("kebab"), scalars.escape_regex(F.col("name")).alias("escaped"), scalars.camel(F.col("name")).alias("camel"))


_VOLATILE = r"CASE WHEN regexp_matches({0}, '^v?[0-9]+\.[0-9]+\.[0-9]+(?:-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?$') THEN '__VOLATILE_SEMVER__' WHEN regexp_matches({0}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(?:\.[0-9]+)?(?:Z|[+-][0-9]{{2}}:?[0-9]{{2}})?$') THEN '__VOLATILE_ISO8601__' WHEN regexp_matches({0}, '^[0-9a-fA-F]{{16,64}}$') THEN '__VOLATILE_HEX_' || length({0}) || '__' END"
_BLUR = f"coalesce({_VOLATILE}, '__STR_' || length({{0}}) || '__')"


@query("literal_blurring", f"SELECT token, {_BLUR.format('token')} AS blurred, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')) AS token FROM documents) GROUP BY ALL")
def literal_blurring(spark: SparkSession, sf: str) -> DataFrame:
    w = t(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[^ \\t\\n\\r\\f]+"), F.lit(0))).alias("token"))
    return w.groupBy("token").agg(F.count(F.lit(1)).alias("n")).select("token", scalars.blur_string(F.col("token")).alias("blurred"), "n")


_WORDS = ", ".join(f"base || '{w}'" for w in scalars.DECORATION_WORDS)


@query(
    "conflict_ladder",
    f"""
WITH n AS (SELECT n_name AS base, n_nationkey AS k FROM nation),
u AS (
  SELECT base, CASE k % 4 WHEN 0 THEN [] WHEN 1 THEN [base] WHEN 2 THEN [base, {_WORDS}, base || '2']
    ELSE [base, {_WORDS}] || list_transform(generate_series(2, 999), lambda i: base || i) || [base || 'Val2'] END AS used FROM n),
l AS (SELECT base, used, [base, {_WORDS}] || list_transform(generate_series(2, 999), lambda i: base || i) || list_transform(generate_series(2, 2000), lambda i: base || 'Val' || i) AS ladder FROM u)
SELECT base, list_filter(ladder, lambda x: NOT list_contains(used, x))[1] AS name FROM l""",
)
def conflict_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """The first name of the ladder that is free, with no, one, most and all of its first two rungs taken."""
    base = F.col("n_name")
    words = [F.concat(base, F.lit(w)) for w in scalars.DECORATION_WORDS]
    numbered = F.transform(F.sequence(F.lit(2), F.lit(999)), lambda i: F.concat(base, i.cast("string")))
    k = F.col("n_nationkey") % 4
    used = (
        F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(base)).when(k == 2, F.array(base, *words, F.concat(base, F.lit("2"))))
        .otherwise(F.concat(F.array(base, *words), numbered, F.array(F.concat(base, F.lit("Val2")))))
    )
    return t(spark, sf, "nation").withColumn("used", used).select(base.alias("base"), scalars.conflict_free(base, F.col("used")).alias("name"))


@query(
    "literal_tokens",
    f"""
WITH v AS (
  SELECT 'string' AS kind, p_name AS value, p_partkey % 3 = 0 AS keep FROM part UNION ALL SELECT 'number', CAST(p_size AS VARCHAR), p_partkey % 3 = 0 FROM part
  UNION ALL SELECT 'bigint', CAST(p_partkey AS VARCHAR), p_partkey % 3 = 0 FROM part UNION ALL SELECT 'regex', p_type || '/g', p_partkey % 3 = 0 FROM part
  UNION ALL SELECT 'template', p_brand, p_partkey % 3 = 0 FROM part
  UNION ALL SELECT 'string', CASE n_nationkey % 5 WHEN 0 THEN 'v1.' || n_nationkey || '.0-rc.1+b' WHEN 1 THEN '2024-01-02T03:04:' || (10 + n_nationkey) || 'Z' WHEN 2 THEN sha256(n_name) WHEN 3 THEN '2024-01-02' ELSE upper(substr(sha256(n_name), 1, 15)) END, false FROM nation)
SELECT kind, value, keep, CASE kind WHEN 'string' THEN 'S=' || CASE WHEN keep THEN '"' || value || '"' ELSE {_BLUR.format('value')} END
  WHEN 'number' THEN 'N=' || CASE WHEN keep THEN value WHEN value = '0' THEN '0' ELSE CAST(CAST(floor(log10(abs(TRY_CAST(value AS DOUBLE)) + 1)) AS BIGINT) AS VARCHAR) END
  WHEN 'bigint' THEN 'B=' || CASE WHEN keep THEN value ELSE '0' END WHEN 'regex' THEN 'R=' || value
  ELSE 'Q=' || CASE WHEN keep THEN '"' || value || '"' ELSE coalesce({_VOLATILE.format('value')}, CAST(length(value) AS VARCHAR)) END END AS token, count(*) AS n FROM v GROUP BY ALL""",
)
def literal_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """What literals of every kind add to a structural hash, blurred or kept."""
    p, n = t(spark, sf, "part"), t(spark, sf, "nation")
    keep = (F.col("p_partkey") % 3 == 0).alias("keep")
    kinds = {"string": F.col("p_name"), "number": F.col("p_size").cast("string"), "bigint": F.col("p_partkey").cast("string"), "regex": F.concat("p_type", F.lit("/g")), "template": F.col("p_brand")}
    k, key = F.col("n_nationkey") % 5, F.col("n_nationkey")
    odd = (
        F.when(k == 0, F.concat(F.lit("v1."), key.cast("string"), F.lit(".0-rc.1+b"))).when(k == 1, F.concat(F.lit("2024-01-02T03:04:"), (key + 10).cast("string"), F.lit("Z")))
        .when(k == 2, F.sha2("n_name", 256)).when(k == 3, F.lit("2024-01-02")).otherwise(F.upper(F.substring(F.sha2("n_name", 256), 1, 15)))
    )
    every = n.select(F.lit("string").alias("kind"), odd.alias("value"), F.lit(False).alias("keep"))
    for kind, value in kinds.items():
        every = every.unionByName(p.select(F.lit(kind).alias("kind"), value.alias("value"), keep))
    return every.groupBy("kind", "value", "keep").agg(F.count(F.lit(1)).alias("n")).select("kind", "value", "keep", scalars.literal_token(F.col("kind"), F.col("value"), F.col("keep")).alias("token"), "n")


_NAMES = "['appInitializer' || n_nationkey, 'float64Error', 'sha256Hasher' || n_nationkey, 'andTaskPipeline', 'themeEngine', 'noop', 'userVal' || n_nationkey, 'placeholderThing', 'a', 'emptyHandler', n_name || 'Instance' || n_nationkey, 'XMLParser' || 'Ref', 'HTTPServerData_2', 'resultValue']"


@query(
    "stem_predicates",
    rf"""
WITH v AS (SELECT DISTINCT unnest({_NAMES}) AS name FROM nation),
m AS (SELECT name, len(list_filter(regexp_extract_all(name, '[0-9]+'), lambda r: length(r) >= 2 AND r NOT IN ('8', '16', '32', '64', '128', '256', '512', '1024'))) > 0 AS minted FROM v)
SELECT name, minted, minted OR regexp_matches(name, '^(?:no[-_]?ops?\w*|doNothing\w*|silent[-_]?noops?\w*|empty(?:function|callback|operation|handler)s?\d*|idle[-_]?operation\d*|initializeModule\d+|placeholder\w*|_+\d*|reactLib\d+|\w+Val\d*)$', 'i')
    OR regexp_matches(name, '^(?:and|or|but|nor|the|an|a)(?:[A-Z0-9]|$)') AS rejected,
  lower(regexp_replace(name, '(?:Val|Var|Ref|Item|Data|Value|Instance|Obj|_?[0-9]+)+$', '')) AS stem FROM m""",
)
def stem_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """Which names carry a minted number, which must not become stems, and the stem of each."""
    key = F.col("n_nationkey").cast("string")
    names = F.array(
        F.concat(F.lit("appInitializer"), key), F.lit("float64Error"), F.concat(F.lit("sha256Hasher"), key), F.lit("andTaskPipeline"), F.lit("themeEngine"), F.lit("noop"), F.concat(F.lit("userVal"), key),
        F.lit("placeholderThing"), F.lit("a"), F.lit("emptyHandler"), F.concat("n_name", F.lit("Instance"), key), F.lit("XMLParserRef"), F.lit("HTTPServerData_2"), F.lit("resultValue"),
    )
    v = t(spark, sf, "nation").select(F.explode(names).alias("name")).distinct()
    name = F.col("name")
    return v.select("name", scalars.has_minted_number(name).alias("minted"), scalars.is_rejected_stem(name).alias("rejected"), scalars.name_stem(name).alias("stem"))


@query("canonical_json", "SELECT event_id, '{' || array_to_string(list_transform(list_sort(json_keys(props)), lambda k: '\"' || k || '\":' || CAST(json_extract(props, '$.' || k) AS VARCHAR)), ',') || '}' AS body FROM events")
def canonical_json(spark: SparkSession, sf: str) -> DataFrame:
    m = F.from_json("props", "map<string,long>")
    return t(spark, sf, "events").select("event_id", scalars.canonical_json(m).alias("body"))
