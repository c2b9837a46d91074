"""Frames and SQL fragments that many queries start from.

Snapshots: runs of twenty document ids belong in turn to the prior snapshot (A) and the fresh one (B), so that
either holds every source; both together are the whole table. Parts, orders and conversations go by even and odd ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspark.functions import scalars
from kinspark.session import table


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return table(spark, sf, name)


def units(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as records: id, side, source, lang, text, n_chars, h (hash of the squeezed text)."""
    d = t(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), (F.floor(F.col("doc_id") / 20) % 2).alias("side"), "source", "lang", "text", "n_chars", scalars.hash16(scalars.squeeze(F.col("text"))).alias("h"))


def sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where("side = 0"), df.where("side = 1")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as ordered statements: (doc_id, stmt, line), one row per line."""
    d = t(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("stmt", "line")).select("doc_id", F.col("stmt").cast("long").alias("stmt"), "line")


#: DuckDB: u, a and b as units() and sides() give them.
UNITS = r"""
WITH u AS (
  SELECT doc_id AS id, (doc_id // 20) % 2 AS side, source, lang, text, n_chars,
    substr(sha256(trim(regexp_replace(lower(text), '[ \t\n\r\f]+', ' ', 'g'))), 1, 16) AS h
  FROM documents),
a AS (SELECT * FROM u WHERE side = 0), b AS (SELECT * FROM u WHERE side = 1)"""
TOKENS = "list_sort(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]{{3,}}')))"
LINES = r"""
WITH l AS (
  SELECT doc_id, CAST(i - 1 AS BIGINT) AS stmt, parts[i] AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(generate_series(1, len(parts))) AS g(i))"""
