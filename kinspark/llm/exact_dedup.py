"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Only DataFrame functions run here. Two texts are equal when they are identical
after lower-casing A-Z; of equal texts the row with the largest id stays.

Defined results: a null text counts as the empty text; rows with a null id rank
below every id; a row that repeats another one (same id, equal text) is dropped
like any copy, so that exactly one row of each group stays; a very long text is hashed
whole; other columns, whatever their names, are not read, and ``drop_copies`` returns
them as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinspark.llm.shared import scratch, small, stored, with_columns_renamed_free

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def folded(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else changed; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def group_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, digest_all: bool = False) -> DataFrame:
    """One row per document: (id, keep_id, group_size, kept, text_sha256).

    ``digest_all`` False leaves text_sha256 null outside the surviving groups, whose texts alone are read in
    full. True fills it for every row, in the one scan that also finds lengths and prefix hashes.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = [
        F.col(id_col).cast("long").alias("doc_id"),
        F.octet_length(text).cast("long").alias("length"),
        F.xxhash64(folded(F.substring(text, 1, prefix_chars))).alias("prefix_hash"),
    ]
    sha = F.sha2(folded(F.col(text_col)).cast("binary"), 256)
    scan = stored(docs.select(*keys, *([sha.alias("text_sha256")] if digest_all else [])), "exact_scan")

    # Step 1: lengths that occur more than once. Step 2: of those rows, prefix hashes that do.
    lengths = scan.groupBy("length").count().where("count > 1").select("length")
    heads = scan.select("length", "prefix_hash").join(lengths, "length", "left_semi").groupBy("length", "prefix_hash").count().where("count > 1").drop("count")
    alive = scan.join(heads, ["length", "prefix_hash"], "left_semi")
    # Step 3: full hashes of what is left.
    if digest_all:
        hashed = alive
    else:
        ids = small(alive.select(F.col("doc_id").alias("_alive")).distinct())
        full = docs.select(id_col, text_col).join(ids, F.col(id_col).cast("long").eqNullSafe(F.col("_alive")), "left_semi")
        hashed = stored(full.select(*keys, sha.alias("text_sha256")), "exact_survivors").join(heads, ["length", "prefix_hash"], "left_semi")
    key = ["length", "prefix_hash", "text_sha256"]
    groups = hashed.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    if digest_all:
        rows = scan.join(groups, key, "left")
    else:
        rows = hashed.unionByName(scan.join(heads, ["length", "prefix_hash"], "left_anti").withColumn("text_sha256", F.lit(None).cast("string"))).join(groups, key, "left")
    copies = rows.where("group_size is not null")
    single = rows.where("group_size is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    wins = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # Winners are one row a group unless whole rows repeat; of those the first stays.
    first = Window.partitionBy(*key).orderBy("doc_id")
    won = copies.where(wins).withColumn("kept", F.row_number().over(first) == 1)
    lost = copies.where(~wins).withColumn("kept", F.lit(False))
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return single.select(*cols).unionByName(won.select(*cols)).unionByName(lost.select(*cols))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, without those that copy another one."""
    with scratch(docs.sparkSession) as keep:
        found = keep(group_copies(docs, id_col, text_col).where("group_size > 1").select("doc_id", "keep_id", "kept", "text_sha256"), "exact_groups")
    gone = found.where("not kept").where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id").distinct()
    repeats = found.where("not kept").where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).limit(1).count()
    mark = with_columns_renamed_free(docs, "_gone")
    gone = gone.select(F.col("doc_id").alias(mark))
    null_gone = gone.where(F.col(mark).isNull()).limit(1).count() > 0
    if repeats or null_gone:
        return _drop_repeats(docs, found, id_col, text_col, mark)
    return docs.join(small(gone), docs[id_col].cast("long") == F.col(mark), "left_anti")


def _drop_repeats(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, mark: str) -> DataFrame:
    """The general way, for tables in which whole rows repeat or ids are null: decide on (id, hash), not on the id."""
    sha = with_columns_renamed_free(docs, "_sha")
    hashed = docs.withColumn(mark, F.col(id_col).cast("long")).withColumn(sha, F.sha2(folded(F.col(text_col)).cast("binary"), 256))
    lost = found.groupBy(F.col("doc_id").alias("_i"), F.col("text_sha256").alias("_s")).agg(F.max("kept").alias("_any"))
    on = F.col(mark).eqNullSafe(F.col("_i")) & (F.col(sha) == F.col("_s"))
    hashed = hashed.join(lost.where("not _any"), on, "left_anti")
    doubled = lost.where("_any")
    plain = hashed.join(doubled, on, "left_anti")
    one = hashed.join(doubled, on, "left_semi").dropDuplicates([mark, sha])
    return plain.unionByName(one).select(*[F.col(f"`{c}`") for c in docs.columns])
