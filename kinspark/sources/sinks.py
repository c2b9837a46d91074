"""Sinks: partitioned trees, ledgers, fingerprints of frames, span edits, trace events, unique names, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_tree(df: DataFrame, path: str, by: str = "file") -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def write_text_tree(df: DataFrame, path: str, by: str) -> None:
    """Text files in one folder for each value of ``by``."""
    df.write.mode("overwrite").partitionBy(by).text(path)


def ledger(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Rows back to parallel arrays, in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), *columns)))
    return df.groupBy(key).agg(rows.alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in columns])


def frame_fingerprint(df: DataFrame) -> DataFrame:
    """(rows, fingerprint): equal for equal rows in any order, so that two runs show where they first differ."""
    each = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(each).cast("string").alias("fingerprint"))


def frame_fingerprint_md5(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, fingerprint) by the first 13 hex digits of each row's MD5, summed: other engines can say the same."""
    each = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns])), 1, 13), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(each).cast("string").alias("fingerprint"))


def apply_spans(text: Column, spans: Column) -> Column:
    """The text with spans (start, end, value; ends exclusive, not overlapping) replaced from right to left."""
    return F.aggregate(
        F.reverse(F.array_sort(spans)), text, lambda acc, s: F.concat(F.substring(acc, F.lit(1), s["start"]), s["value"], F.substring(acc, s["end"] + 1, F.length(acc)))
    )


def guarded_replay(df: DataFrame, text: str, spans: str, digest: str) -> DataFrame:
    """Adds ``replayed``: spans are applied only to the text they were recorded for (SHA-256), else null."""
    return df.withColumn("replayed", F.when(F.sha2(text, 256) == F.col(digest), apply_spans(F.col(text), F.col(spans))))


def unique_names(df: DataFrame, stem: str, order: str) -> DataFrame:
    """Adds ``name``: stem, stem-2, stem-3 in order, distinct without regard to case; a suffix that a real stem already has goes on counting."""
    low = F.lower(stem)
    w = Window.partitionBy(low).orderBy(order)
    first = df.withColumn("_n", F.row_number().over(w))
    taken = df.select(low.alias("_taken")).distinct()
    named = first.withColumn("name", F.when(F.col("_n") == 1, F.col(stem)).otherwise(F.concat(F.col(stem), F.lit("-"), F.col("_n").cast("string"))))
    clash = named.where("_n > 1").join(taken, F.lower("name") == F.col("_taken"), "left_semi")
    most = first.groupBy(low.alias("_low")).agg(F.max("_n").alias("_most"))
    fixed = clash.join(most, F.lower(stem) == F.col("_low")).withColumn("name", F.concat(F.col(stem), F.lit("-"), (F.col("_most") + F.row_number().over(Window.partitionBy(low).orderBy(order))).cast("string")))
    return named.join(clash.select(order), order, "left_anti").drop("_n").unionByName(fixed.drop("_n", "_low", "_most"))


def trace_events(df: DataFrame, name: str, category: str, start: str, end: str, lane: str) -> DataFrame:
    """Complete events of a trace viewer as JSON lines, times in microseconds."""
    body = F.struct(F.col(name).alias("name"), F.col(category).alias("cat"), F.lit("X").alias("ph"), F.col(start).cast("long").alias("ts"), (F.col(end) - F.col(start)).cast("long").alias("dur"), F.lit(1).alias("pid"), F.col(lane).cast("long").alias("tid"))
    return df.select(F.to_json(body).alias("event"))


def quarantine(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, failed): failed rows carry the names of the checks they fail."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    marked = df.withColumn("failed", failed)
    return marked.where(F.size("failed") == 0).drop("failed"), marked.where(F.size("failed") > 0)
