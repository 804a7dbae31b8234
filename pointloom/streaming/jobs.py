"""Structured Streaming jobs.

Event time is cast to TIMESTAMP first: watermarks refuse TIMESTAMP_NTZ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def observation_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 8) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def timed(df: DataFrame, ts: str, late: str = "2 days") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def stream_dedup(df: DataFrame, keys: list[str], ts: str, late: str = "2 days") -> DataFrame:
    """First row of each key within the watermark."""
    return timed(df, ts, late).dropDuplicatesWithinWatermark(keys)


def stream_daily(df: DataFrame, key: str, ts: str, value: str, late: str = "2 days") -> DataFrame:
    """Daily count and maximum by key."""
    return timed(df, ts, late).groupBy(F.window(ts, "1 day").alias("w"), key).agg(
        F.count("*").alias("n"), F.max(value).alias("peak")
    ).select(F.to_date(F.col("w.start")).alias("day"), key, "n", "peak")


def stream_sessions(df: DataFrame, key: str, ts: str, gap: str = "36 hours", late: str = "2 days") -> DataFrame:
    """Sessions by key (T05).  ``session_window`` also merges a gap of exactly its length."""
    return timed(df, ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(
        key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"
    )


def run_once(df: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there into Parquet in ``folder`` and stop; the table that it holds.

    In append mode each batch writes a folder of its own, in complete mode the
    last one replaces the results before it; a repeated batch writes the same again.
    """
    spark = df.sparkSession
    spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(f"{folder}/_batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/_batch={number if mode == 'append' else 0}")

    query = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(folder).drop("_batch")


def run_batches(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand each micro-batch to ``handle``, e.g. the live association."""
    df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
