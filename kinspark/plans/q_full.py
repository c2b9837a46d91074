"""Queries: files and ledgers written and read back, nested JSON, reports in full, nearest positions, noise shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinspark.functions import scalars
from kinspark.operators import scores, windows
from kinspark.plans.common import UNITS, sides, t, units
from kinspark.plans.q_agg import _contingency
from kinspark.plans.q_sets import _ANCHOR, anchors
from kinspark.plans.q_source import _working
from kinspark.plans.registry import query
from kinspark.sources import readers, sinks

# Files


@query(
    "tree_roundtrip",
    """WITH l AS (SELECT source AS folder, unnest(string_split(text, chr(10))) AS line FROM documents WHERE source IS NOT NULL AND source <> (SELECT min(source) FROM documents))
SELECT folder, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM l GROUP BY folder""",
)
def tree_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as a tree of text files by source, then scanned recursively without one folder, each file read whole."""
    d = t(spark, sf, "documents").where("source is not null")
    root = f"{_working(spark)}/tree"
    sinks.write_text_tree(d.select(F.col("source").alias("folder"), "text"), root, "folder")
    skip = d.agg(F.min("source")).first()[0]
    files = readers.tree(spark, root, "*.txt", f"folder={skip}")
    folder = F.regexp_extract("path", "/folder=([^/]+)/", 1)
    # A file ends with a line feed, so what follows the last one is no line.
    rows = files.select(folder.alias("folder"), F.explode(F.split(F.regexp_replace("text", "\n$", ""), "\n")).alias("line"))
    return rows.groupBy("folder").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).cast("long").alias("chars"))


@query(
    "reader_registry",
    """WITH f AS (SELECT unnest(['parquet', 'orc', 'json', 'csv', 'text']) AS format)
SELECT format, CASE WHEN format = 'text' THEN 'passthrough' ELSE 'detected' END AS route, CAST(CASE WHEN format = 'text' THEN 1 ELSE (SELECT count(*) FROM nation) END AS BIGINT) AS rows, format <> 'text' AS same FROM f""",
)
def reader_registry(spark: SparkSession, sf: str) -> DataFrame:
    """One table in every format, read through the registry by its detected kind; an unknown one passes through as whole text."""
    n = t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))
    base, out = _working(spark), None
    digest = F.sum(F.xxhash64(F.col("n_nationkey").cast("long"), F.col("n_name"), F.col("n_regionkey").cast("long")).cast("decimal(38,0)"))
    want = n.agg(digest).first()[0]
    for kind in ("parquet", "orc", "json", "csv", "text"):
        path = f"{base}/{kind}"
        if kind == "text":
            n.select(F.concat_ws(",", *n.columns).alias("value")).coalesce(1).write.text(path)
        else:
            n.write.format(kind).option("header", True).save(path)
        found = readers.detect_kind(spark, path)
        df = readers.read(spark, found, path)
        got = df.count()
        same = found != "text" and df.agg(digest).first()[0] == want
        row = spark.createDataFrame([(kind, "passthrough" if found == "text" else "detected", got, same)], "format string, route string, rows long, same boolean")
        out = row if out is None else out.unionByName(row)
    return out


_LEDGER = """
WITH p AS (SELECT doc_id, text, strpos(text, 'e') AS spot FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, spot, text AS prior, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS fresh FROM p WHERE spot > 0)
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE sha256(substr(fresh, 1, spot - 1) || '#' || substr(fresh, spot + 1)) END AS replayed, CASE WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'replayed' END AS state FROM h"""


@query("ledger_across_runs", _LEDGER)
def ledger_across_runs(spark: SparkSession, sf: str) -> DataFrame:
    """A first run writes its edits (spans, digest, version) as a ledger; the second reads that version only and replays what it was recorded for."""
    base = _working(spark)
    d = t(spark, sf, "documents").where("text is not null").withColumn("at", F.instr("text", "e")).where("at > 0")
    spans = F.array(F.struct((F.col("at") - 1).alias("start"), F.col("at").alias("end"), F.lit("#").alias("value")))
    rows = d.select("doc_id", F.sha2("text", 256).alias("digest"), spans.alias("spans"), F.lit(2).alias("version"))
    old = rows.withColumn("version", F.lit(1)).withColumn("digest", F.lit("0"))
    rows.unionByName(old).write.json(f"{base}/ledger")
    read = readers.snapshot(spark, f"{base}/ledger", "doc_id long, digest string, spans array<struct<start:int,end:int,value:string>>, version int", 2)
    fresh = d.select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    replayed = sinks.guarded_replay(fresh.join(read, "doc_id"), "text", "spans", "digest")
    return replayed.select("doc_id", F.sha2("replayed", 256).alias("replayed"), F.when(F.col("replayed").isNull(), "changed").otherwise("replayed").alias("state"))


@query(
    "run_records",
    """SELECT 'stats' AS file, count(*) AS rows, CAST(sum(n) AS BIGINT) AS total FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)
UNION ALL SELECT 'diagnostics', count(*), CAST(sum(n) AS BIGINT) FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
UNION ALL SELECT 'placement', count(*), CAST(sum(n) AS BIGINT) FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)
UNION ALL SELECT 'stage-hashes', 2, (SELECT count(*) FROM documents) + (SELECT count(*) FROM events)""",
)
def run_records(spark: SparkSession, sf: str) -> DataFrame:
    """Stats, diagnostics, placement and stage fingerprints of a run, written as JSON and read back as records."""
    base, out = _working(spark), None
    d, e = t(spark, sf, "documents"), t(spark, sf, "events")
    per = lambda df, key: df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    prints = None
    for name, df in (("documents", d), ("events", e)):
        one = sinks.frame_fingerprint(df).select(F.lit(name).alias("key"), F.col("rows").alias("n"), "fingerprint")
        prints = one if prints is None else prints.unionByName(one)
    for name, df in (("stats", per(d, "source")), ("diagnostics", per(e, "event_type")), ("placement", per(d, "lang")), ("stage-hashes", prints)):
        df.write.json(f"{base}/{name}")
        back = readers.records(spark, f"{base}/{name}", "key string, n long, fingerprint string")
        row = back.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total")).select(F.lit(name).alias("file"), "rows", "total")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "page_structure",
    r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, CAST(len(regexp_extract_all(html, '<[A-Za-z][A-Za-z0-9]*')) AS BIGINT) AS elements,
  CAST(len(list_distinct(list_transform(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9]*)', 1), lambda x: lower(x)))) AS BIGINT) AS kinds,
  array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))), ' ') AS links,
  sha256(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g'))) AS body FROM pages""",
)
def page_structure(spark: SparkSession, sf: str) -> DataFrame:
    """Raw pages parsed to title, elements, links and text, by patterns that never fail on broken markup."""
    html = F.col("html")
    names = F.regexp_extract_all(html, F.lit("<([A-Za-z][A-Za-z0-9]*)"), F.lit(1))
    links = F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))))
    bare = F.regexp_replace(F.regexp_replace(html, "(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", " "), "<[^>]*>", " ")
    return t(spark, sf, "pages").select(
        "page_id", F.trim(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.size(names).cast("long").alias("elements"),
        F.size(F.array_distinct(F.transform(names, F.lower))).cast("long").alias("kinds"), F.array_join(links, " ").alias("links"),
        F.sha2(F.trim(F.regexp_replace(bare, "[ \\t\\n\\r\\f]+", " ")), 256).alias("body"),
    )


# Records in JSON

@query("canonical_json_nested", """SELECT event_id, '{"a":{"x":{},"y":[' || user_id || ',{"b":null,"q":"' || event_type || '"}]},"m":[true,[]],"z":' || event_id || '}' AS body FROM events""")
def canonical_json_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Keys in order at every depth."""
    return _bodies(spark, sf).select("event_id", scalars.canonical_json_text(F.col("body")).alias("body"))


@query(
    "unread_leaves",
    """WITH p AS (SELECT unnest(['a.x', 'a.y[0]', 'a.y[1].b', 'a.y[1].q', 'm[0]', 'm[1]', 'z']) AS path)
SELECT event_type, path, (SELECT count(*) FROM events e WHERE e.event_type = k.event_type) AS n, path NOT IN ('z', 'a.y[0]') AS unread FROM (SELECT DISTINCT event_type FROM events) k, p""",
)
def unread_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of the leaves at every depth, and which of them nobody has read."""
    rows = _bodies(spark, sf).select("event_type", F.explode(scalars.leaf_paths(F.col("body"))).alias("path"))
    return rows.groupBy("event_type", "path").agg(F.count(F.lit(1)).alias("n")).withColumn("unread", ~F.col("path").isin("z", "a.y[0]"))


def _bodies(spark: SparkSession, sf: str) -> DataFrame:
    body = F.format_string('{"z": %d, "a": {"y": [%d, {"q": "%s", "b": null}], "x": {}}, "m": [true, []]}', "event_id", "user_id", "event_type")
    return t(spark, sf, "events").select("event_id", "event_type", body.alias("body"))


@query(
    "stage_fingerprint_md5",
    """SELECT 'events' AS stage, count(*) AS rows, CAST(sum(CAST(('0x' || substr(md5(concat_ws('|', event_id, user_id, event_type)), 1, 13)) AS BIGINT)) AS VARCHAR) AS fingerprint FROM events
UNION ALL SELECT 'parts', count(*), CAST(sum(CAST(('0x' || substr(md5(concat_ws('|', p_partkey, p_name, p_brand, p_type, p_size)), 1, 13)) AS BIGINT)) AS VARCHAR) FROM part""",
)
def stage_fingerprint_md5(spark: SparkSession, sf: str) -> DataFrame:
    """Order-free fingerprints by a hash that other engines have too."""
    e, p = t(spark, sf, "events"), t(spark, sf, "part")
    one = sinks.frame_fingerprint_md5(e, ["event_id", "user_id", "event_type"]).select(F.lit("events").alias("stage"), "rows", "fingerprint")
    return one.unionByName(sinks.frame_fingerprint_md5(p, ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]).select(F.lit("parts").alias("stage"), "rows", "fingerprint"))


# Positions


@query(
    "nearest_position_join",
    """WITH p AS (SELECT user_id, event_id AS spot FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, event_id FROM events WHERE event_type = 'click')
SELECT event_id, spot AS nearest, abs(spot - event_id) AS distance FROM c LEFT JOIN p USING (user_id) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(spot - event_id), spot) = 1""",
)
def nearest_position_join(spark: SparkSession, sf: str) -> DataFrame:
    """Each click with the purchase of its user that is nearest in position, before or after; ties to the earlier one."""
    e = t(spark, sf, "events")
    marks = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("at"))
    c = e.where("event_type = 'click'").select("user_id", "event_id", F.col("event_id").alias("at"))
    out = windows.nearest(c, marks, "user_id", "at")
    return out.select("event_id", "nearest", F.abs(F.col("nearest") - F.col("event_id")).alias("distance"))


@query(
    "proximity_names",
    """WITH b AS (SELECT doc_id, i AS line, unnest(regexp_extract_all(parts[i], '[A-Z][a-z]{3,}')) AS name FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(generate_series(1, len(parts))) AS g(i)),
n AS (SELECT doc_id, count(*) AS bindings FROM b GROUP BY 1), m AS (SELECT doc_id, (min(line) + max(line)) // 2 AS here FROM b GROUP BY 1)
SELECT doc_id, bindings, count(DISTINCT name) AS names FROM b JOIN n USING (doc_id) JOIN m USING (doc_id) WHERE bindings < 100 OR abs(line - here) <= 100 GROUP BY ALL""",
)
def proximity_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names within a hundred lines of the middle, where a document binds a hundred or more; all of them where it binds fewer."""
    li = t(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "part"))
    b = li.select("doc_id", (F.col("line") + 1).cast("long").alias("line"), F.explode(F.regexp_extract_all("part", F.lit("[A-Z][a-z]{3,}"), F.lit(0))).alias("name"))
    whole = b.groupBy("doc_id").agg(F.count(F.lit(1)).alias("bindings"), F.floor((F.min("line") + F.max("line")) / 2).alias("here"))
    near = b.join(whole, "doc_id").where((F.col("bindings") < 100) | (F.abs(F.col("line") - F.col("here")) <= 100))
    return near.groupBy("doc_id", "bindings").agg(F.count_distinct("name").alias("names"))


_WEIGHTED = """
WITH p AS (SELECT user_id, event_type || '/' || CAST(floor(value / 10) AS BIGINT) AS name, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
w AS (SELECT name, CAST(round(ln((SELECT count(DISTINCT user_id) FROM events) / count(DISTINCT user_id)), 6) AS DECIMAL(18, 6)) AS idf FROM p GROUP BY name),
e AS (SELECT user_id, name, pos AS lo, lead(pos) OVER (PARTITION BY user_id, name ORDER BY pos) AS hi FROM p),
k AS (SELECT user_id, lo, hi, idf FROM e JOIN w USING (name) WHERE hi IS NOT NULL AND hi - lo <= 40),
d AS (SELECT user_id, lo + 1 AS pos, idf AS d FROM k UNION ALL SELECT user_id, hi + 1, -idf FROM k UNION ALL SELECT user_id, pos, 0 FROM p),
c AS (SELECT user_id, pos, CAST(sum(sum(d)) OVER (PARTITION BY user_id ORDER BY pos) AS DOUBLE) AS height FROM d GROUP BY user_id, pos)"""


@query("weighted_crossing_curve", _WEIGHTED + " SELECT user_id, pos, round(height, 6) AS height FROM c JOIN p USING (user_id, pos)")
def weighted_crossing_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Links between successive uses of a name at most forty positions apart, weighed by how few users have the name."""
    p = t(spark, sf, "events").select(
        "user_id", F.concat_ws("/", "event_type", F.floor(F.col("value") / 10).cast("string")).alias("name"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("pos")
    )
    users = p.agg(F.count_distinct("user_id").alias("users"))
    idf = p.groupBy("name").agg(F.count_distinct("user_id").alias("df")).crossJoin(F.broadcast(users)).select("name", F.round(F.log(F.col("users") / F.col("df")), 6).cast("decimal(18,6)").alias("weight"))
    hi = F.lead("pos").over(Window.partitionBy("user_id", "name").orderBy("pos"))
    e = p.select("user_id", "name", F.col("pos").alias("lo"), hi.alias("hi")).where("hi - lo <= 40").join(idf, "name")
    return windows.crossing_curve(e.select("user_id", "lo", "hi", "weight"), p, "user_id").withColumn("height", F.round("height", 6) + F.lit(0.0))


# Reports


@query(
    "coverage_by_kind",
    """SELECT 'function' AS kind, o_orderpriority AS strategy, count(*) AS n, count(*) FILTER (o_orderstatus <> 'O') AS covered FROM orders GROUP BY ALL
UNION ALL SELECT 'binding', c_mktsegment, count(*), count(*) FILTER (c_acctbal >= 0) FROM customer GROUP BY ALL
UNION ALL SELECT 'identifier', l_returnflag || l_linestatus, count(*), count(*) FILTER (l_discount > 0) FROM lineitem GROUP BY ALL""",
)
def coverage_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by strategy for all three kinds of records."""

    def of(kind: str, table: str, strategy: Column, covered: Column) -> DataFrame:
        g = t(spark, sf, table).groupBy(strategy.alias("strategy")).agg(F.count(F.lit(1)).alias("n"), F.count_if(covered).alias("covered"))
        return g.select(F.lit(kind).alias("kind"), "strategy", "n", "covered")

    out = of("function", "orders", F.col("o_orderpriority"), F.col("o_orderstatus") != "O").unionByName(of("binding", "customer", F.col("c_mktsegment"), F.col("c_acctbal") >= 0))
    return out.unionByName(of("identifier", "lineitem", F.concat("l_returnflag", "l_linestatus"), F.col("l_discount") > 0))


@query(
    "minted_census_full",
    r"""WITH w AS (SELECT tok, count(*) AS c FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+[0-9_$*%#&!|]*')) AS tok FROM documents) GROUP BY tok),
f AS (SELECT tok, c, CASE WHEN regexp_matches(tok, '[*%#&!|$]+$') THEN 'decorated' WHEN length(tok) <= 2 THEN 'short' WHEN regexp_matches(tok, '[0-9]') THEN 'numbered' WHEN regexp_matches(tok, '^[A-Z]+$') THEN 'upper' ELSE 'plain' END AS family,
  regexp_replace(tok, '[0-9_$*%#&!|]+$', '') AS base FROM w)
SELECT family, CAST(sum(c) AS BIGINT) AS n, count(*) AS names, count(*) FILTER (base <> tok AND base IN (SELECT tok FROM w)) AS derivable, count(*) FILTER (c = 1) AS zero_ref FROM f GROUP BY family""",
)
def minted_census_full(spark: SparkSession, sf: str) -> DataFrame:
    """Names by family, decorated ones first; those a plain name explains, and those used nowhere but where they are made."""
    w = t(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+[0-9_$*%#&!|]*"), F.lit(0))).alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("c"))
    tok = F.col("tok")
    family = F.when(tok.rlike("[*%#&!|$]+$"), "decorated").when(F.length(tok) <= 2, "short").when(tok.rlike("[0-9]"), "numbered").when(tok.rlike("^[A-Z]+$"), "upper").otherwise("plain")
    named = w.withColumn("family", family).withColumn("base", F.regexp_replace(tok, "[0-9_$*%#&!|]+$", ""))
    known = w.select(F.col("tok").alias("base"), F.lit(True).alias("known"))
    g = named.join(known, "base", "left").groupBy("family")
    return g.agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("names"), F.count_if((F.col("base") != tok) & F.col("known")).alias("derivable"), F.count_if(F.col("c") == 1).alias("zero_ref"),
    )


@query(
    "diagnostics_report",
    """WITH r AS (
  SELECT 'collision target' AS pattern, p_name AS key, CAST(count(*) AS DOUBLE) AS value FROM part GROUP BY p_name HAVING count(*) > 1
  UNION ALL SELECT 'lowest coverage', CAST(user_id AS VARCHAR), -round(count(*) FILTER (event_type = 'purchase') / count(*), 9) FROM events GROUP BY user_id
  UNION ALL SELECT 'failures by attempt', CAST(attempt AS VARCHAR), CAST(count(*) AS DOUBLE) FROM (SELECT event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt FROM events) WHERE event_type = 'error' GROUP BY attempt
  UNION ALL SELECT 'missing by finish reason', o_orderstatus, CAST(count(*) AS DOUBLE) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 2)
SELECT pattern, key, value FROM r QUALIFY row_number() OVER (PARTITION BY pattern ORDER BY value DESC, key) <= 10""",
)
def diagnostics_report(spark: SparkSession, sf: str) -> DataFrame:
    """The four patterns of a diagnostics file, the top ten of each (a report of the top)."""
    e, o = t(spark, sf, "events"), t(spark, sf, "orders")
    row = lambda df, pattern, key, value: df.select(F.lit(pattern).alias("pattern"), key.cast("string").alias("key"), value.cast("double").alias("value"))
    n = F.count(F.lit(1)).alias("n")
    one = row(t(spark, sf, "part").groupBy("p_name").agg(n).where("n > 1"), "collision target", F.col("p_name"), F.col("n"))
    share = -F.round(F.count_if(F.col("event_type") == "purchase") / F.count(F.lit(1)), 9)
    two = row(e.groupBy("user_id").agg(share.alias("s")), "lowest coverage", F.col("user_id"), F.col("s"))
    attempt = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("attempt")
    three = row(e.select("event_type", attempt).where("event_type = 'error'").groupBy("attempt").agg(n), "failures by attempt", F.col("attempt"), F.col("n"))
    missing = o.join(t(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").groupBy("o_orderstatus").agg(n)
    every = one.unionByName(two).unionByName(three).unionByName(row(missing, "missing by finish reason", F.col("o_orderstatus"), F.col("n")))
    place = F.row_number().over(Window.partitionBy("pattern").orderBy(F.desc("value"), "key"))
    return every.withColumn("_r", place).where("_r <= 10").drop("_r")


@query(
    "breakdown_worst_first",
    """WITH c AS (SELECT d.source AS true_group, d.lang || '/' || l.quality AS pred_group, count(*) AS n FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL),
g AS (SELECT true_group, arg_min(pred_group, (-n, pred_group)) AS dominant, max(n) AS m, sum(n) AS n FROM c GROUP BY 1)
SELECT row_number() OVER (ORDER BY round(m / n, 9), true_group) AS place, true_group, dominant, CAST(n AS BIGINT) AS n, round(m / n, 9) AS completeness FROM g""",
)
def breakdown_worst_first(spark: SparkSession, sf: str) -> DataFrame:
    """Groups with their dominant output, the least complete first."""
    b = scores.breakdown(_contingency(spark, sf)).withColumn("completeness", F.round("completeness", 9))
    return windows.global_rank(b, [F.col("completeness").asc(), F.col("true_group").asc_nulls_last()], "place")


# Texts


@query(
    "edited_line_counts",
    _ANCHOR
    + """, o AS (SELECT a_id, b_id, l, count(*) AS c FROM (SELECT a_id, b_id, unnest(string_split(old_text, chr(10))) AS l FROM anchored) GROUP BY ALL),
n AS (SELECT a_id, b_id, l, count(*) AS c FROM (SELECT a_id, b_id, unnest(string_split(new_text, chr(10))) AS l FROM anchored) GROUP BY ALL)
SELECT a_id, b_id, CAST(sum(greatest(coalesce(o.c, 0) - coalesce(n.c, 0), 0)) AS BIGINT) AS removed, CAST(sum(greatest(coalesce(n.c, 0) - coalesce(o.c, 0), 0)) AS BIGINT) AS added FROM o FULL JOIN n USING (a_id, b_id, l) GROUP BY ALL""",
)
def edited_line_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that anchored pairs lost and gained."""
    u = units(spark, sf).select("id", "text")
    p = anchors(spark, sf).join(u.withColumnRenamed("id", "a_id").withColumnRenamed("text", "old"), "a_id").join(u.withColumnRenamed("id", "b_id").withColumnRenamed("text", "new"), "b_id")
    return p.withColumn("x", scalars.edited_line_counts(F.col("old"), F.col("new"))).select("a_id", "b_id", "x.removed", "x.added")


@query(
    "relative_imports",
    """WITH f AS (SELECT n_nationkey AS k, 'r' || n_regionkey AS folder, 'src/r' || n_regionkey || '/' || lower(n_name) || '.js' AS path FROM nation)
SELECT x.path AS source, y.path AS target, CASE WHEN x.folder = y.folder THEN './' || split_part(y.path, '/', 3) ELSE '../' || split_part(y.path, '/', 2) || '/' || split_part(y.path, '/', 3) END AS import FROM f x JOIN f y ON y.k = (x.k + 1) % 25
UNION ALL SELECT path, 'lib.js', '../../lib.js' FROM f""",
)
def relative_imports(spark: SparkSession, sf: str) -> DataFrame:
    """The relative path by which each file imports the next one, and one at the root."""
    n = t(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("src/r"), F.col("n_regionkey").cast("string"), F.lit("/"), F.lower("n_name"), F.lit(".js")).alias("path"))
    pairs = n.select(((F.col("k") + 1) % 25).alias("k"), F.col("path").alias("source")).join(n.select("k", F.col("path").alias("target")), "k").select("source", "target")
    pairs = pairs.unionByName(n.select(F.col("path").alias("source"), F.lit("lib.js").alias("target")))
    return pairs.withColumn("import", scalars.relative_import(F.col("source"), F.col("target")))


@query(
    "clone_streams",
    """WITH m AS (SELECT source, regexp_replace(text, '[A-Za-z0-9_]+', '_', 'g') AS masked FROM documents)
SELECT substr(sha256(masked), 1, 16) AS h, count(*) AS n, count(DISTINCT source) AS files, length(masked) >= 300 AS strict FROM m WHERE length(masked) >= 150 GROUP BY masked HAVING count(DISTINCT source) > 1""",
)
def clone_streams(spark: SparkSession, sf: str) -> DataFrame:
    """Whole masked streams that occur in more than one source: of 300 characters or more, and loosely of 150."""
    m = t(spark, sf, "documents").select("source", scalars.mask_words(F.col("text")).alias("masked")).where(F.length("masked") >= 150)
    m = m.select("source", F.sha2("masked", 256).alias("sha"), (F.length("masked") >= 300).alias("strict"))  # only digests are shuffled
    g = m.groupBy("sha", "strict").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("files")).where("files > 1")
    return g.select(F.substring("sha", 1, 16).alias("h"), "n", "files", "strict")


_SHAPES = UNITS + r""",
li AS (SELECT side, unnest(string_split(text, chr(10))) AS text FROM u),
k AS (SELECT sha256(regexp_replace(text, '[A-Za-z_$][A-Za-z0-9_$]*', '_', 'g')) AS m, side, min(text) AS text, count(*) AS n FROM li WHERE length(text) >= 12 GROUP BY ALL),
p AS (SELECT x.text AS old, y.text AS new, x.m FROM k x JOIN k y USING (m) WHERE x.side = 0 AND y.side = 1 AND x.n = 1 AND y.n = 1 AND x.text <> y.text),
w AS (
  SELECT m, i, o[i] AS a, n[i] AS b, CASE WHEN i > 1 THEN right(s[i], 1) ELSE '' END AS before, d FROM (
    SELECT m, regexp_extract_all(old, '[A-Za-z_$][A-Za-z0-9_$]*') AS o, regexp_extract_all(new, '[A-Za-z_$][A-Za-z0-9_$]*') AS n, regexp_split_to_array(new, '[A-Za-z_$][A-Za-z0-9_$]*') AS s,
      list_distinct(regexp_extract_all(new, '([A-Za-z_$][A-Za-z0-9_$]*) (?:is|=)', 1)) AS d FROM p), unnest(generate_series(1, len(n))) AS g(i)),
c AS (SELECT m, count(*) FILTER (before = '.') AS props, count(*) FILTER (before <> '.' AND list_contains(d, b)) AS internal, count(*) FILTER (before <> '.' AND NOT list_contains(d, b)) AS outer_ FROM w WHERE a <> b GROUP BY m)
SELECT substr(m, 1, 16) AS pair, CASE WHEN props > 0 THEN 'property-drift' WHEN internal > 0 AND outer_ = 0 THEN 'internal-rename' WHEN outer_ > 0 AND internal = 0 THEN 'outer-echo' ELSE 'mixed-rename' END AS shape, props, internal, outer_ AS outer_names FROM c
"""


@query("noise_shapes", _SHAPES)
def noise_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Statements, sole twins of equal masked form, whose words differ: as properties, as names they declare, as others, or as both."""
    word = "[A-Za-z_$][A-Za-z0-9_$]*"
    li = units(spark, sf).select("side", F.explode(F.split("text", "\n")).alias("text")).where(F.length("text") >= 12)
    u = li.withColumn("m", F.sha2(F.regexp_replace("text", word, "_"), 256))
    k = [s.groupBy("m").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("text")).where("n = 1").select("m", F.col("text").alias(c)) for s, c in zip(sides(u), ("old", "new"), strict=True)]
    p = k[0].join(k[1], "m").where("old <> new")
    words = lambda c: F.regexp_extract_all(c, F.lit(word), F.lit(0))
    declared = F.array_distinct(F.regexp_extract_all("new", F.lit(f"({word}) (?:is|=)"), F.lit(1)))
    rows = p.select("m", declared.alias("d"), F.posexplode(F.arrays_zip(words("old").alias("a"), words("new").alias("b"), F.split("new", word).alias("s"))).alias("i", "x"))
    rows = rows.select("m", "d", "x.a", "x.b", F.when(F.col("i") > 0, F.right("x.s", F.lit(1))).otherwise("").alias("before")).where("a <> b")
    prop, mine = F.col("before") == ".", F.array_contains("d", F.col("b"))
    c = rows.groupBy("m").agg(F.count_if(prop).alias("props"), F.count_if(~prop & mine).alias("internal"), F.count_if(~prop & ~mine).alias("outer_names"))
    shape = (
        F.when(F.col("props") > 0, "property-drift").when((F.col("internal") > 0) & (F.col("outer_names") == 0), "internal-rename")
        .when((F.col("outer_names") > 0) & (F.col("internal") == 0), "outer-echo").otherwise("mixed-rename")
    )
    return c.select(F.substring("m", 1, 16).alias("pair"), shape.alias("shape"), "props", "internal", "outer_names")
