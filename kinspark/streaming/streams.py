"""Structured Streaming forms of the run-time behaviours: rate windows, gauges, wave barriers, first claimant, carried state."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder, or one file, as a stream; ``ts`` becomes a timestamp that watermarks accept."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        folder, _, name = path.rpartition("/")
        df = reader.option("pathGlobFilter", name).parquet(folder)
    else:
        df = reader.parquet(path)
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in df.columns else df


def rate_windows(events: DataFrame, width: str = "1 minute", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Requests and volume per window and kind, late rows up to ``late`` included."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("at"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user: windows that a pause closes."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return g.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end_"), "n")


def first_claimant(claims: DataFrame, target: str = "target", by: str = "claimant", order: str = "seq") -> DataFrame:
    """The first claimant of each target, over all batches; its win is carried as state."""

    def claim(key: tuple, frames, state: GroupState):  # noqa: ANN001, ANN202
        if state.exists:
            return
        best = pd.concat(list(frames)).sort_values(order).iloc[0]
        state.update((int(best[by]),))
        yield pd.DataFrame({target: [key[0]], by: [int(best[by])]})

    kinds = dict(claims.dtypes)
    out = f"{target} {kinds[target]}, {by} long"
    return claims.groupBy(target).applyInPandasWithState(claim, out, f"{by} long", "append", GroupStateTimeout.NoTimeout)


def distinct_requests(requests: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Requests whose key has not been seen: the streaming form of a response cache."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def wave_barrier(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):  # noqa: ANN201
    """Collect on frozen state, apply sorted at the barrier: every micro-batch is one wave handed to ``apply``."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, spark: SparkSession, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drive a stream over everything available into Parquet and read it back."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


def complete_to_table(stream: DataFrame, spark: SparkSession, path: str, checkpoint: str) -> DataFrame:
    """Drive an aggregating stream over everything available in complete mode; the last batch's whole result is written by the executors and read back."""
    schema = stream.schema
    last: list[int] = []

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{n}")
        last.append(n)

    stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/{max(last)}") if last else spark.createDataFrame([], schema)
