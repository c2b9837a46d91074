"""Queries: detection, segments of text, edits, sinks, streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinspark.functions import scalars
from kinspark.operators import matching
from kinspark.operators.graph import shared_dir, stored
from kinspark.plans.common import LINES, UNITS, sides, t, units
from kinspark.plans.registry import query
from kinspark.sources import readers, sinks
from kinspark.streaming import streams

SIGNALS = [("doctype", "definitive", "^<!DOCTYPE html>"), ("tracked", "likely", "track\\("), ("nav", "hint", "<nav>"), ("ad", "likely", 'class="ad"'), ("article", "hint", "<article>")]


@query(
    "format_detection",
    """WITH h AS (SELECT page_id, substr(html, 1, 16384) AS s FROM pages)
SELECT page_id, CASE WHEN regexp_matches(s, '^<!DOCTYPE html>') THEN 'doctype' WHEN regexp_matches(s, 'track\\(') THEN 'tracked' WHEN regexp_matches(s, 'class="ad"') THEN 'ad' WHEN regexp_matches(s, '<nav>') THEN 'nav' WHEN regexp_matches(s, '<article>') THEN 'article' END AS name,
  CASE WHEN regexp_matches(s, '^<!DOCTYPE html>') THEN 'definitive' WHEN regexp_matches(s, 'track\\(') OR regexp_matches(s, 'class="ad"') THEN 'likely' WHEN regexp_matches(s, '<nav>') OR regexp_matches(s, '<article>') THEN 'hint' END AS tier FROM h""".replace("\\\\(", "\\("),
)
def format_detection(spark: SparkSession, sf: str) -> DataFrame:
    found = readers.detect(F.col("html"), SIGNALS)
    return t(spark, sf, "pages").select("page_id", found.alias("f")).select("page_id", "f.name", "f.tier")


@query("signal_table", "WITH s(name, tier, pattern) AS (VALUES ('doctype', 'definitive', '<!DOCTYPE html>'), ('tracked', 'likely', 'track('), ('ad', 'likely', 'class=\"ad\"'), ('nav', 'hint', '<nav>'), ('article', 'hint', '<article>')) SELECT name, tier, count(*) AS pages FROM s JOIN pages ON contains(substr(html, 1, 16384), pattern) GROUP BY ALL")
def signal_table(spark: SparkSession, sf: str) -> DataFrame:
    """All signals of every page: a small pattern table against the heads of the texts."""
    plain = [("doctype", "definitive", "<!DOCTYPE html>"), ("tracked", "likely", "track("), ("ad", "likely", 'class="ad"'), ("nav", "hint", "<nav>"), ("article", "hint", "<article>")]
    head = F.substring("html", 1, readers.DETECTION_CHARS)
    hits = F.filter(F.array(*[F.when(head.contains(p), F.struct(F.lit(n).alias("name"), F.lit(tier).alias("tier"))) for n, tier, p in plain]), lambda x: x.isNotNull())
    return t(spark, sf, "pages").select(F.explode(hits).alias("s")).groupBy("s.name", "s.tier").agg(F.count(F.lit(1)).alias("pages"))


@query("statement_extraction", LINES + " SELECT doc_id, stmt, substr(md5(line), 1, 8) AS h FROM l")
def statement_extraction(spark: SparkSession, sf: str) -> DataFrame:
    s = readers.statements(t(spark, sf, "documents"), "doc_id", "text")
    return s.select("doc_id", F.col("stmt").cast("long").alias("stmt"), F.substring(F.md5("line"), 1, 8).alias("h"))


@query("ledger_roundtrip", "SELECT conv_id, array_to_string(list(role ORDER BY turn), ',') AS roles, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY conv_id")
def ledger_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Rows to parallel arrays, back to rows, and to arrays again."""
    c = t(spark, sf, "conversations")
    rows = readers.ledger_rows(sinks.ledger(c, "conv_id", "turn", ["turn", "role"]), "conv_id", ["turn", "role"])
    again = sinks.ledger(rows, "conv_id", "pos", ["role"])
    return again.select("conv_id", F.array_join("role", ",").alias("roles"), F.size("role").cast("long").alias("n"))


@query("stage_fingerprint")
def stage_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Order-free fingerprints of stages, side by side."""
    u = units(spark, sf)
    one = sinks.frame_fingerprint(u).select(F.lit("units").alias("stage"), "rows", "fingerprint")
    two = sinks.frame_fingerprint(u.groupBy("source", "lang").count()).select(F.lit("groups").alias("stage"), "rows", "fingerprint")
    return one.unionByName(two)


@query("span_edits", "SELECT doc_id, sha256('A' || substr(text, 3, 4) || 'bb' || substr(text, 9)) AS edited FROM documents WHERE length(text) >= 9")
def span_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Two spans spliced from right to left, replayed only on the text they were recorded for."""
    span = lambda s, e, v: F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit(v).alias("value"))
    d = t(spark, sf, "documents").where(F.length("text") >= 9).withColumn("spans", F.array(span(0, 2, "A"), span(6, 8, "bb"))).withColumn("digest", F.sha2("text", 256))
    return sinks.guarded_replay(d, "text", "spans", "digest").select("doc_id", F.sha2("replayed", 256).alias("edited"))


@query("unique_names", "SELECT doc_id, CASE WHEN r = 1 THEN stem ELSE stem || '-' || r END AS name FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE upper(source) END AS stem, row_number() OVER (PARTITION BY lower(source) ORDER BY doc_id) AS r FROM documents)")
def unique_names(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.upper("source")).alias("stem"))
    return sinks.unique_names(d, "stem", "doc_id").select("doc_id", "name")


@query(
    "trace_events",
    """SELECT '{"name":"' || event_type || '","cat":"' || event_type || '","ph":"X","ts":' || epoch_us(ts) || ',"dur":' || CAST(trunc(value * 1000) AS BIGINT) || ',"pid":1,"tid":' || user_id || '}' AS event FROM events""",
)
def trace_events(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events").withColumn("start", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("end_", F.unix_micros(F.col("ts").cast("timestamp")) + (F.col("value") * 1000).cast("long"))
    return sinks.trace_events(e, "event_type", "event_type", "start", "end_", "user_id")


@query("output_validation", "SELECT 'duplicate id' AS problem, count(*) - count(DISTINCT doc_id) AS n FROM documents UNION ALL SELECT 'wrong length', count(*) FILTER (length(text) <> n_chars) FROM documents UNION ALL SELECT 'label without document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def output_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Checks that must all count nothing."""
    d, la = t(spark, sf, "documents"), t(spark, sf, "labels")
    one = d.agg((F.count(F.lit(1)) - F.count_distinct("doc_id")).alias("n")).select(F.lit("duplicate id").alias("problem"), "n")
    two = d.agg(F.count_if(F.length("text") != F.col("n_chars")).cast("long").alias("n")).select(F.lit("wrong length").alias("problem"), "n")
    three = la.join(d, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("label without document").alias("problem"), "n")
    return one.unionByName(two).unionByName(three)


@query("quarantine", r"SELECT doc_id, concat_ws(',', CASE WHEN n_chars < 20 THEN 'short' END, CASE WHEN NOT regexp_matches(text, '[.]') THEN 'no sentence' END) AS failed FROM documents WHERE n_chars < 20 OR NOT regexp_matches(text, '[.]')")
def quarantine(spark: SparkSession, sf: str) -> DataFrame:
    _, bad = sinks.quarantine(t(spark, sf, "documents"), {"short": F.col("n_chars") >= 20, "no sentence": F.col("text").rlike("[.]")})
    return bad.select("doc_id", F.array_join("failed", ",").alias("failed"))


@query("eligibility_skip_list", "SELECT p_name AS name, count(*) AS n FROM part WHERE p_name NOT IN (SELECT n_name FROM nation UNION ALL SELECT r_name FROM region) AND regexp_matches(p_name, '^[a-z]+ ') GROUP BY p_name")
def eligibility_skip_list(spark: SparkSession, sf: str) -> DataFrame:
    """Names that no skip list holds and that have the form of a name."""
    skip = t(spark, sf, "nation").select(F.col("n_name").alias("name")).union(t(spark, sf, "region").select("r_name"))
    p = t(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return p.where(F.col("name").rlike("^[a-z]+ ")).join(skip, "name", "left_anti")


@query("contamination_anchor", UNITS + ", b0 AS (SELECT item_id, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM benchmark), d0 AS (SELECT id, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM u) SELECT item_id, count(DISTINCT id) AS docs FROM b0 JOIN d0 USING (line) WHERE length(line) >= 12 GROUP BY item_id")
def contamination_anchor(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a long line of a benchmark item."""
    b = t(spark, sf, "benchmark").select("item_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where(F.length("line") >= 12)
    d = t(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    return d.join(b, "line").groupBy("item_id").agg(F.count_distinct("doc_id").alias("docs"))


@query("edited_pairs", UNITS + r", k AS (SELECT h, count(*) FILTER (side = 0) AS na, count(*) FILTER (side = 1) AS nb FROM u GROUP BY h), e AS (SELECT u.id, side, lang, regexp_replace(string_split(text, chr(10))[1], '[A-Za-z0-9_]+', '_', 'g') AS head FROM u JOIN k USING (h) WHERE na = 0 OR nb = 0), o AS (SELECT head, lang, min(id) AS old_id FROM e WHERE side = 0 GROUP BY ALL HAVING count(*) = 1), n AS (SELECT head, lang, min(id) AS new_id FROM e WHERE side = 1 GROUP BY ALL HAVING count(*) = 1) SELECT old_id, new_id FROM o JOIN n USING (head, lang)")
def edited_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Records without a twin whose masked first lines name one another."""
    u = units(spark, sf)
    k = u.groupBy("h").agg(F.count_if(F.col("side") == 0).alias("na"), F.count_if(F.col("side") == 1).alias("nb")).where("na = 0 or nb = 0")
    e = u.join(k, "h").withColumn("head", scalars.mask_words(F.split("text", "\n")[0]))
    a, b = sides(e)
    o = a.groupBy("head", "lang").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("old_id")).where("n = 1").drop("n")
    n = b.groupBy("head", "lang").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("new_id")).where("n = 1").drop("n")
    return o.join(n, ["head", "lang"]).select("old_id", "new_id")


@query("edited_pairs_by_overlap")
def edited_pairs_by_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Records without a twin, paired inside their masked head by best token overlap of 0.5 or more, each used once."""
    return overlap_pairs(units(spark, sf))[0]


def overlap_pairs(u: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs, and all records with what else the ledger counts: id, side, h, source, form (digest of the text) and head (hash of the masked first line)."""
    every = stored(u.select("id", "side", "h", "source", F.sha2("text", 256).alias("form"), F.xxhash64(scalars.mask_words(F.split("text", "\n")[0])).alias("head")))
    k = every.groupBy("h").agg(F.count_if(F.col("side") == 0).alias("na"), F.count_if(F.col("side") == 1).alias("nb")).where("na = 0 or nb = 0")
    alone = every.join(k, "h", "left_semi").select("id", "side", "head")
    shared = alone.groupBy("head").agg(F.min("side").alias("lo"), F.max("side").alias("hi")).where("lo < hi")
    open_ = stored(alone.join(shared, "head", "left_semi"))
    words = F.array_distinct(F.filter(F.regexp_extract_all("text", F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*)"), F.lit(1)), lambda w: F.length(w) > 2))
    # Hashes are taken before the join: texts stay where they are.
    e = u.select("id", F.transform(words, lambda w: F.xxhash64(w)).alias("words")).join(open_, "id")
    pairs = matching.edited_candidates(*sides(e)).join(open_.select(F.col("id").alias("old_id"), "head"), "old_id")
    return matching.greedy_within(pairs, "head"), every


@query("diff_ledger_by_overlap")
def diff_ledger_by_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Every record in exactly one bucket; edited_pairs_by_overlap are modified, sole twins in another source moved."""
    p, u = overlap_pairs(units(spark, sf))
    p = stored(p)
    k = u.groupBy("h").agg(
        F.count_if(F.col("side") == 0).alias("na"), F.count_if(F.col("side") == 1).alias("nb"), F.when(F.min("form") == F.max("form"), 1).otherwise(2).alias("forms"), F.count_distinct(F.coalesce("source", F.lit(""))).alias("places")
    )
    edited = p.select(F.col("old_id").alias("id")).union(p.select("new_id")).withColumn("edited", F.lit(True))
    one = (F.col("na") == 1) & (F.col("nb") == 1)
    bucket = (
        F.when(F.col("edited"), "modified").when(F.col("na") == 0, "added").when(F.col("nb") == 0, "removed").when(one & (F.col("places") > 1), "moved")
        .when(F.col("forms") == 1, "clean").when(one, "noise").otherwise("family")
    )
    return u.join(k, "h").join(edited, "id", "left").select(bucket.alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("statement_alignment", UNITS + ", l AS (SELECT id, side, source, i AS pos, md5(parts[i]) AS g FROM (SELECT id, side, source, string_split(text, chr(10)) AS parts FROM u), unnest(generate_series(1, len(parts))) AS q(i)), k AS (SELECT source, g FROM (SELECT source, g, count(*) AS n FROM l WHERE side = 0 GROUP BY ALL) JOIN (SELECT source, g, count(*) AS n FROM l WHERE side = 1 GROUP BY ALL) USING (source, g, n)), r AS (SELECT l.*, row_number() OVER (PARTITION BY side, source, g ORDER BY id, pos) AS rk FROM l JOIN k USING (source, g)) SELECT x.source, x.id AS old_id, CAST(x.pos AS BIGINT) AS old_pos, y.id AS new_id, CAST(y.pos AS BIGINT) AS new_pos FROM r x JOIN r y USING (source, g, rk) WHERE x.side = 0 AND y.side = 1")
def statement_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Lines whose hash occurs equally often on both sides of a source, paired in order."""
    u = units(spark, sf)
    li = u.select("id", "side", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("id", "side", "source", (F.col("pos") + 1).cast("long").alias("pos"), F.md5("line").alias("g"))
    n = li.groupBy("source", "g").agg(F.count_if(F.col("side") == 0).alias("na"), F.count_if(F.col("side") == 1).alias("nb")).where("na = nb").select("source", "g")
    r = li.join(n, ["source", "g"], "left_semi").withColumn("rk", F.row_number().over(Window.partitionBy("side", "source", "g").orderBy("id", "pos")))
    x = r.where("side = 0").select("source", "g", "rk", F.col("id").alias("old_id"), F.col("pos").alias("old_pos"))
    y = r.where("side = 1").select("source", "g", "rk", F.col("id").alias("new_id"), F.col("pos").alias("new_pos"))
    return x.join(y, ["source", "g", "rk"]).select("source", "old_id", "old_pos", "new_id", "new_pos")


def _working(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/work-{uuid.uuid4().hex}"


@query("streaming_rate_windows", "SELECT time_bucket(INTERVAL '6 hours', ts) AS at, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def streaming_rate_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The stream of events through tumbling windows, driven to its end in complete mode."""
    e, work = t(spark, sf, "events"), _working(spark)
    stream = streams.rate_windows(streams.read_stream(spark, f"{sf}/events.parquet", e.schema), "6 hours")
    done = streams.complete_to_table(stream, spark, f"{work}/out", f"{work}/state")
    return done.withColumn("total", F.round("total", 6)).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("streaming_first_claimant", "SELECT user_id AS target, first(event_id ORDER BY event_id) AS claimant FROM events GROUP BY user_id")
def streaming_first_claimant(spark: SparkSession, sf: str) -> DataFrame:
    """The first event of each user, its win kept as state across micro-batches."""
    e = t(spark, sf, "events")
    claims = streams.read_stream(spark, f"{sf}/events.parquet", e.schema).select(F.col("user_id").alias("target"), F.col("event_id").alias("claimant"), F.col("event_id").alias("seq"))
    work = _working(spark)
    return streams.run_to_table(streams.first_claimant(claims), spark, f"{work}/out", f"{work}/state")
