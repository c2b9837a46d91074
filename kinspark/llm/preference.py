"""Preference formatting: pairs of conversations as one prompt and two masked completions.

The prompt is the longest common prefix of turns (same role, same text), rendered once. The
completions are what follows in each conversation. A mask in run lengths ("0:14,1:120") covers
a completion's code points; 1 marks what is learnt: assistant texts with their end marks.

``pair_by_first_turn`` makes pairs where none are given: conversations that open with the same
turn, in order of their ids, the first with the second, the third with the fourth and so on. Groups are cut into ranges of ids; counts
carried from range to range number the whole group, so that no task holds an unbounded group
and no size changes the pairs. Of a pair the one with more assistant
text is chosen, ties go to the lower id. A conversation without a partner stays unpaired.

Defined results: a null role or text counts as empty; rows with a null conversation id are left
out; a null turn number comes last; turns with one number are ordered by role, then text, and
repeated rows stay repeated; a very long text is compared and rendered whole; other columns, whatever
their names, are not read; an empty table gives an empty result. All in DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinspark.llm.shared import scratch, stored

_LAST = 2**62


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns, weight): each conversation's turns in order and the length of its assistant texts."""
    row = F.struct(
        F.coalesce(F.col(turn_col).cast("long"), F.lit(_LAST)).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), row.alias("row"))
    weight = F.sum(F.when(F.col("row.role") == "assistant", F.length("row.text")).otherwise(0)).cast("long")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"), weight.alias("weight"))


def pair_by_first_turn(convs: DataFrame, set_size: int = 1024) -> DataFrame:
    """(chosen_id, rejected_id): rejected_id null for a conversation without a partner. Tasks number about ``set_size`` conversations at a time."""
    first = convs.select("conv_id", "weight", F.sha2(F.concat_ws("\n", F.col("turns")[0]["role"], F.col("turns")[0]["text"]), 256).alias("opening"))
    with scratch(convs.sparkSession) as keep:
        first = stored(first, "pref_first")
        parts = max(1, -(-first.count() // set_size))
        ranged = stored(first.repartitionByRange(parts, "opening", "conv_id").withColumn("part", F.spark_partition_id()), "pref_ranged")
        counts = ranged.groupBy("opening", "part").agg(F.count(F.lit(1)).alias("n"))
        along = Window.partitionBy("opening").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select("opening", "part", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
        nth = F.row_number().over(Window.partitionBy("opening", "part").orderBy("conv_id")) - 1 + F.col("before")
        pair = ranged.join(offsets, ["opening", "part"]).select("opening", F.floor(nth / 2).alias("pair"), F.struct("conv_id", "weight").alias("conv"))
        pairs = keep(pair.groupBy("opening", "pair").agg(F.min("conv").alias("x"), F.max("conv").alias("y"), F.count(F.lit(1)).alias("n")), "pref_pairs")
    alone = F.col("n") == 1
    keeps = alone | (F.col("x.weight") >= F.col("y.weight"))
    return pairs.select(F.when(keeps, F.col("x.conv_id")).otherwise(F.col("y.conv_id")).alias("chosen_id"), F.when(~alone, F.when(keeps, F.col("y.conv_id")).otherwise(F.col("x.conv_id"))).alias("rejected_id"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))), "")


def _mask(turns: Column) -> Column:
    def one(t: Column) -> Column:
        head, rest = F.length(t["role"]) + 5, F.length(t["text"]) + 8
        learnt = F.concat(F.lit("0:"), head.cast("string"), F.lit(",1:"), rest.cast("string"))
        return F.when(t["role"] == "assistant", learnt).otherwise(F.concat(F.lit("0:"), (head + rest).cast("string")))

    return F.array_join(F.transform(turns, one), ",")


def format_preferences(convs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id, prefix_turns, prompt, chosen, chosen_mask, rejected, rejected_mask) of each pair; prompt only for an unpaired one."""
    a = convs.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("a"))
    b = convs.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("b"))
    both = pairs.join(a, "chosen_id").join(b, "rejected_id", "left")
    n = F.least(F.size("a"), F.size("b"))
    alike = F.zip_with(F.slice("a", F.lit(1), n), F.slice("b", F.lit(1), n), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    at = F.array_position(alike, F.lit(False))
    prefix = F.when(F.col("b").isNull(), F.size("a")).when(at == 0, n).otherwise(at.cast("int") - 1)
    both = both.withColumn("prefix_turns", prefix)
    rest = {c: F.slice(c, F.col("prefix_turns") + 1, F.greatest(F.size(c) - F.col("prefix_turns"), F.lit(0))) for c in ("a", "b")}
    return both.select(
        "chosen_id", "rejected_id", F.col("prefix_turns").cast("long").alias("prefix_turns"), _render(F.slice("a", F.lit(1), F.col("prefix_turns"))).alias("prompt"),
        _render(rest["a"]).alias("chosen"), _mask(rest["a"]).alias("chosen_mask"), _render(rest["b"]).alias("rejected"), _mask(rest["b"]).alias("rejected_mask"),
    )
