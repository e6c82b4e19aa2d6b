"""The streams over a log that arrives in stretches: several batches, late reads, and state that ends."""

from pyspark.sql import functions as F

from tesserix.plans import q_reads as Q
from tesserix.streaming import read_totals as S

SF = "/root/testdata/sf0.01"


def test_windows_are_updated_over_batches_and_their_state_ends(spark):
    stream, late = Q._stream(spark, SF)
    path, progress = S.drained(S.windowed_totals(stream, S.KEYS, "ts", late), "test-totals", "update")
    assert sum(p.numInputRows > 0 for p in progress) >= 3
    rows = spark.read.parquet(path)
    windows = rows.select("start", *S.KEYS).distinct().count()
    assert rows.count() > windows  # some windows were told again by a later batch
    held = [p.stateOperators[0].numRowsTotal for p in progress]
    assert max(held) < windows and sum(p.stateOperators[0].numRowsDroppedByWatermark for p in progress) == 0


def test_state_of_first_reads_ends(spark):
    stream, late = Q._stream(spark, SF)
    path, progress = S.drained(S.first_leaf_reads(stream, "ts", late).select("session_id", "day", "leaf_id"), "test-leaves", "append")
    rows = spark.read.parquet(path)
    assert rows.count() == rows.distinct().count() and max(p.stateOperators[0].numRowsTotal for p in progress) < rows.count()


def test_an_empty_log(spark, tmp_path):
    folder = str(tmp_path / "log")
    spark.createDataFrame([], "event_id long, user_id long, event_type string, ts timestamp").write.parquet(folder)
    stream = Q.as_reads(spark.readStream.schema("event_id long, user_id long, event_type string, ts timestamp").parquet(folder), "ts")
    assert S.latest_totals(stream, S.KEYS, "ts", "1 day").count() == 0


def test_late_reads_are_left_out(spark, tmp_path):
    folder = str(tmp_path / "log")
    for k, day in enumerate(("2024-01-01", "2024-02-01", "2024-02-02", "2024-01-02")):  # a batch is late by what came before the one before it
        df = spark.range(10).select((F.col("id") * 7 + 1).alias("event_id"), F.lit(3).cast("bigint").alias("user_id"), F.lit("view").alias("event_type"),
                                    F.to_timestamp(F.lit(day)).alias("ts"))
        df.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("event_id long, user_id long, event_type string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    total = S.latest_totals(Q.as_reads(stream, "ts"), S.KEYS, "ts", "2 days").agg(F.sum("n")).first()[0]
    assert total == 30
