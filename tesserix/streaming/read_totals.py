"""Totals of a growing read log, kept up to date by Structured Streaming. All state has an end: it goes once the log's time has passed it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserix.session import shared_folder

KEYS = ["purpose", "initiator"]
DAY = "1 day"


def windowed_totals(reads: DataFrame, keys: list[str], time: str, late: str, width: str = DAY) -> DataFrame:
    """Bytes and reads per window of event time and key. State is one row per key of each window that can still change: reads
    that come more than ``late`` after the newest one are left out, and windows older than that are dropped from state."""
    windows = reads.withWatermark(time, late).groupBy(F.window(time, width).alias("_w"), *keys)
    return windows.agg(F.sum("received").alias("bytes"), F.count(F.lit(1)).alias("n")).select(F.col("_w.start").alias("start"), *keys, "bytes", "n")


def first_leaf_reads(reads: DataFrame, time: str, within: str) -> DataFrame:
    """First successful read of every leaf in a session on a day, as it arrives; later ones come from the cache.

    State is one row per (session, day, leaf) and is dropped ``within`` after the first read, which must be a day or longer.
    """
    leaves = reads.filter("purpose = 'leaf-directory' AND error_kind IS NULL").withColumn("day", F.to_date(time))
    return leaves.withWatermark(time, within).dropDuplicatesWithinWatermark(["session_id", "day", "leaf_id"])


def drained(stream: DataFrame, name: str, mode: str) -> tuple[str, list]:
    """Run ``stream`` over everything available and write each batch, numbered, to the shared folder; returns the path and the
    progress of all batches.

    The batch number is the folder name, so a batch repeated after a failure overwrites itself.
    """
    spark = stream.sparkSession
    base = shared_folder(spark, name)
    out = os.path.join(base, "out")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out, f"batch={number}"))

    # An empty log makes no batch; the reader still finds the columns.
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(os.path.join(out, "batch=-1"))
    query = (stream.writeStream.outputMode(mode).foreachBatch(write)
             .option("checkpointLocation", os.path.join(base, "state")).trigger(availableNow=True).start())
    query.awaitTermination()
    return out, list(query.recentProgress)


def latest_windows(path: str, like: DataFrame, keys: list[str]) -> DataFrame:
    """Newest row of each window and key among the batches of an update-mode stream."""
    newest = F.max_by(F.struct("bytes", "n"), "batch")
    return like.sparkSession.read.parquet(path).groupBy("start", *keys).agg(newest.alias("v")).select("start", *keys, "v.bytes", "v.n")


def latest_totals(stream_reads: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Drain the log in update mode and add up the newest windows of each key."""
    path, _ = drained(windowed_totals(stream_reads, keys, time, late), "read-totals", "update")
    rows = latest_windows(path, stream_reads, keys)
    return rows.groupBy(*keys).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
