"""Queries: ordered windows, segments, top-k, as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinspark.operators import windows as win
from kinspark.plans.common import LINES, UNITS, lines, t, units
from kinspark.plans.registry import query


@query("ordinal_in_group", UNITS + " SELECT id, CASE WHEN count(*) OVER (PARTITION BY h) >= 2 THEN row_number() OVER (PARTITION BY h ORDER BY id) - 1 END AS ordinal FROM u")
def ordinal_in_group(spark: SparkSession, sf: str) -> DataFrame:
    return win.ordinal_in_group(units(spark, sf), ["h"], ["id"]).select("id", "ordinal")


@query("running_ordinal", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS k FROM events")
def running_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return t(spark, sf, "events").select("event_id", (F.row_number().over(w) - 1).cast("long").alias("k"))


@query("locality_fill", LINES + " SELECT doc_id, stmt, coalesce(last_value(nullif(regexp_extract(line, '^([A-Z][a-z]+) ', 1), '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY stmt ROWS UNBOUNDED PRECEDING), 'seed') AS home FROM l")
def locality_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Lines without a home of their own (a capitalised first word) take the home of the line before."""
    w = F.regexp_extract("line", "^([A-Z][a-z]+) ", 1)
    return win.locality_fill(lines(spark, sf).select("doc_id", "stmt", F.when(w != "", w).alias("home")), ["doc_id"], "stmt", "home", F.lit("seed"))


@query(
    "anchored_order",
    """WITH r AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'purchase' THEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) - 1 END AS rank FROM events),
k AS (SELECT *, coalesce(rank, last_value(rank IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) + 0.5, -0.5) AS key FROM r)
SELECT event_id, CAST(key AS DOUBLE) AS key, row_number() OVER (PARTITION BY user_id ORDER BY key, event_id) - 1 AS place FROM k""",
)
def anchored_order(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events")
    rank = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("value"), "event_id")) - 1
    e = e.select("user_id", "event_id", F.when(F.col("event_type") == "purchase", rank).alias("rank"))
    return win.anchored_order(e, ["user_id"], "rank", "event_id").select("event_id", "key", "place")


@query("line_prefix_sums", LINES + " SELECT doc_id, stmt, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY stmt) - length(line) - 1 AS BIGINT) AS start FROM l")
def line_prefix_sums(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("stmt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("line") + 1
    return lines(spark, sf).select("doc_id", "stmt", (F.sum(size).over(w) - size).cast("long").alias("start"))


@query("adjacent_statements", LINES + " SELECT doc_id, stmt, substr(md5(lag(line) OVER w), 1, 8) AS before, substr(md5(lead(line) OVER w), 1, 8) AS after FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY stmt)")
def adjacent_statements(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("stmt")
    return lines(spark, sf).select("doc_id", "stmt", F.substring(F.md5(F.lag("line").over(w)), 1, 8).alias("before"), F.substring(F.md5(F.lead("line").over(w)), 1, 8).alias("after"))


@query(
    "segment_extraction",
    LINES
    + r""", s AS (SELECT *, CAST(regexp_matches(line, '[.]$') AS INT) AS e FROM l),
g AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY doc_id ORDER BY stmt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(e) OVER (PARTITION BY doc_id) AS total FROM s)
SELECT doc_id, CASE WHEN before < total THEN CAST(before AS BIGINT) END AS segment, count(*) AS statements FROM g GROUP BY ALL""",
)
def segment_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of lines up to one that ends a sentence; the tail after the last such line is a segment without number."""
    s = win.segments(lines(spark, sf), "doc_id", "stmt", F.col("line").rlike("[.]$"))
    return s.groupBy("doc_id", "segment").agg(F.count(F.lit(1)).alias("statements"))


_BANNER = "CASE WHEN regexp_matches(line, '(Licensed under|Released under|Copyright|GNU)') THEN stmt END"


@query("region_scan", LINES + f", b AS (SELECT doc_id, stmt AS start FROM l WHERE {_BANNER} IS NOT NULL) SELECT doc_id, start, lead(start) OVER (PARTITION BY doc_id ORDER BY start) AS end_ FROM b")
def region_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Banner lines open regions that end where the next one opens."""
    b = lines(spark, sf).where(F.col("line").rlike("(Licensed under|Released under|Copyright|GNU)"))
    return b.select("doc_id", F.col("stmt").alias("start"), F.lead("stmt").over(Window.partitionBy("doc_id").orderBy("stmt")).alias("end_"))


@query("region_lookup", LINES + f" SELECT region, count(*) AS n FROM (SELECT last_value({_BANNER} IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY stmt ROWS UNBOUNDED PRECEDING) AS region FROM l) GROUP BY region")
def region_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Each line's region: the last banner at or before it."""
    banner = F.when(F.col("line").rlike("(Licensed under|Released under|Copyright|GNU)"), F.col("stmt"))
    return win.regions(lines(spark, sf), "doc_id", "stmt", banner).groupBy("region").agg(F.count(F.lit(1)).alias("n"))


@query(
    "merged_windows",
    """WITH i AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) // 3600 AS s, CAST(floor(epoch(ts)) AS BIGINT) // 3600 + CAST(floor(value / 20) AS BIGINT) AS e FROM events),
r AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS n FROM g GROUP BY user_id, island""",
)
def merged_windows(spark: SparkSession, sf: str) -> DataFrame:
    hour = F.floor(F.unix_timestamp("ts") / 3600)
    i = t(spark, sf, "events").select("user_id", hour.alias("s"), (hour + F.floor(F.col("value") / 20)).alias("e"))
    return win.merged_intervals(i, "user_id", "s", "e")


@query(
    "crossing_curve",
    """WITH p AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
e AS (SELECT user_id, pos AS lo, lead(pos) OVER (PARTITION BY user_id, event_type ORDER BY pos) AS hi FROM p),
d AS (SELECT user_id, lo + 1 AS pos, 1.0 AS d FROM e WHERE hi IS NOT NULL UNION ALL SELECT user_id, hi + 1, -1.0 FROM e WHERE hi IS NOT NULL UNION ALL SELECT user_id, pos, 0.0 FROM p),
c AS (SELECT user_id, pos, CAST(sum(sum(d)) OVER (PARTITION BY user_id ORDER BY pos) AS DOUBLE) AS height FROM d GROUP BY user_id, pos)
SELECT c.* FROM c JOIN p USING (user_id, pos)""",
)
def crossing_curve(spark: SparkSession, sf: str) -> DataFrame:
    return _curve(spark, sf)


def _curve(spark: SparkSession, sf: str) -> DataFrame:
    """Links between successive events of a type, counted where they cross each gap of a user's order."""
    p = t(spark, sf, "events").select("user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("pos"))
    hi = F.lead("pos").over(Window.partitionBy("user_id", "event_type").orderBy("pos"))
    e = p.select("user_id", F.col("pos").alias("lo"), hi.alias("hi"), F.lit(1.0).alias("weight")).where("hi is not null")
    return win.crossing_curve(e, p, "user_id")


@query("seam_cuts")
def seam_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """Cuts at the deepest valleys, four positions apart at least, up to twelve segments a user."""
    return win.spaced_valleys(_curve(spark, sf), "user_id", 4, 12)


@query("leftmost_minimum", "WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, first(day ORDER BY n, day) AS day FROM d GROUP BY user_id")
def leftmost_minimum(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return d.groupBy("user_id").agg(F.min_by("day", F.struct("n", "day")).alias("day"))


@query(
    "proximity_groups",
    """WITH RECURSIVE o AS (SELECT user_id, h, row_number() OVER (PARTITION BY user_id ORDER BY h) AS k FROM (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) // 3600 AS h FROM events)),
r AS (
  SELECT user_id, k, h, h AS lo, 1 AS n, 0 AS cluster FROM o WHERE k = 1
  UNION ALL SELECT o.user_id, o.k, o.h, CASE WHEN o.h - lo > 100 OR n >= 10 THEN o.h ELSE lo END, CASE WHEN o.h - lo > 100 OR n >= 10 THEN 1 ELSE n + 1 END, cluster + CASE WHEN o.h - lo > 100 OR n >= 10 THEN 1 ELSE 0 END
  FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
SELECT user_id, cluster, min(h) AS first, count(*) AS n FROM r GROUP BY ALL""",
)
def proximity_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Hours of a user's events in clusters that span a hundred at most and hold ten at most."""
    e = t(spark, sf, "events").select("user_id", F.floor(F.unix_timestamp("ts") / 3600).alias("hour"))
    g = win.proximity_groups(e, "user_id", "hour")
    return g.groupBy("user_id", "cluster").agg(F.min("hour").alias("first"), F.count(F.lit(1)).alias("n"))


@query(
    "gap_split",
    """WITH g AS (SELECT user_id, event_id, epoch(ts) AS p, coalesce(epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS gap FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY gap DESC, p, event_id) AS r FROM g)
SELECT event_id, CAST(sum(CASE WHEN r <= 4 AND gap > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY p, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS part FROM r""",
)
def gap_split(spark: SparkSession, sf: str) -> DataFrame:
    """A user's events cut at the four largest gaps."""
    e = t(spark, sf, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("p"))
    return win.gap_split(e, "user_id", "p", "event_id", 5).select("event_id", "part")


@query(
    "position_lanes",
    "WITH c AS (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r FROM documents) SELECT doc_id, CAST(CASE WHEN n <= 25 THEN 0 ELSE floor(r / ceil(n / CASE WHEN n <= 200 THEN 4 WHEN n <= 1000 THEN 8 ELSE 16 END)) END AS BIGINT) AS lane FROM c",
)
def position_lanes(spark: SparkSession, sf: str) -> DataFrame:
    return win.position_lanes(t(spark, sf, "documents"), "source", ["doc_id"]).select("doc_id", "lane")


@query(
    "proximity_filter",
    "WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) // 3600 AS h FROM events) SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY h RANGE BETWEEN 24 PRECEDING AND 24 FOLLOWING) AS near FROM e",
)
def proximity_filter(spark: SparkSession, sf: str) -> DataFrame:
    """How many of a user's events lie within a day."""
    e = t(spark, sf, "events").select("event_id", "user_id", F.floor(F.unix_timestamp("ts") / 3600).alias("h"))
    return e.select("event_id", F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy("h").rangeBetween(-24, 24)).alias("near"))


@query(
    "as_of_join",
    "WITH p AS (SELECT user_id, ts, max(event_id) AS last_purchase FROM events WHERE event_type = 'purchase' GROUP BY ALL), c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click') SELECT c.event_id, p.last_purchase FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.ts >= p.ts",
)
def as_of_join(spark: SparkSession, sf: str) -> DataFrame:
    """Each click with the user's last purchase at or before it."""
    e = t(spark, sf, "events")
    p = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_purchase"))
    c = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return win.as_of(c, p, "user_id", "ts", "last_purchase").select("event_id", "last_purchase")


@query("top_bindings", "SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 5")
def top_bindings(spark: SparkSession, sf: str) -> DataFrame:
    """The five largest of each source (a report of the top)."""
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return t(spark, sf, "documents").select("source", "doc_id", "n_chars", F.row_number().over(w).alias("r")).where("r <= 5").drop("r")


@query("kept_evidence", "SELECT user_id, array_to_string(list_distinct(list(event_type ORDER BY event_id))[1:3], ',') AS kept, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS every FROM events GROUP BY user_id".replace("list_distinct(list(event_type ORDER BY event_id))[1:3]", "list_transform(list_sort(list_transform(list_distinct(list(event_type)), lambda x: [CAST(list_position(list(event_type ORDER BY event_id), x) AS INT)]))[1:3], lambda p: (list(event_type ORDER BY event_id))[p[1]])"))
def kept_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """The first three distinct kinds of evidence, in order of appearance."""
    g = t(spark, sf, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("k"))
    return g.select("user_id", F.array_join(F.slice(F.array_distinct("k"), 1, 3), ",").alias("kept"), F.array_join(F.array_sort(F.array_distinct("k")), ",").alias("every"))


@query("position_sort", "SELECT l_orderkey, array_to_string(list(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice), ',') AS parts FROM lineitem GROUP BY l_orderkey")
def position_sort(spark: SparkSession, sf: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")))
    return t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(rows, lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


@query("span_histogram", LINES + ", s AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id) SELECT CASE WHEN n <= 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' WHEN n <= 50 THEN '21-50' ELSE 'tooLong' END AS bucket, count(*) AS n FROM s GROUP BY 1")
def span_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Spans by length; over fifty lines they are not usable."""
    n = F.size(F.split("text", "\n"))
    b = F.when(n <= 1, "1").when(n <= 5, "2-5").when(n <= 20, "6-20").when(n <= 50, "21-50").otherwise("tooLong")
    return t(spark, sf, "documents").groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("minute_rate", "SELECT time_bucket(INTERVAL '1 hour', ts) AS at, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def minute_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Tumbling windows over events: the batch form of the rate limiter's window."""
    g = t(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return g.select(F.col("w.start").alias("at"), "event_type", "n", "total")
