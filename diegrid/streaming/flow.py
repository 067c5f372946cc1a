"""Wafers that arrive continuously (Structured Streaming), and the service's short memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from diegrid.sources.tables import shared_path
from diegrid.sources.validation import split_valid, validate_wafers


def recent_latency(latency: DataFrame, last: int = 64) -> DataFrame:
    """Median and 95th percentile of the last `last` requests, NULL without any."""
    q = F.percentile("ms", F.array(F.lit(0.5), F.lit(0.95)))
    return latency.orderBy(F.desc("ts"), F.desc("ms")).limit(last).agg(F.count("*").alias("n"), q.alias("q")).select(
        "n", F.get("q", F.lit(0)).alias("p50"), F.get("q", F.lit(1)).alias("p95"))


def recent_batches(batches: DataFrame, last: int = 50) -> DataFrame:
    """The latest `last` batches, by creation time."""
    return batches.orderBy(F.desc("created"), F.desc("batch")).limit(last)


def defect_rate(events: DataFrame, window: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Tumbling-window class rates per chamber; rows(ts, chamber, class), batch or stream. In a
    stream, rows later than `late` are dropped and a window's state is freed once it closes."""
    defect = F.when(F.col("class") != "None", 1).otherwise(0)
    g = events.withWatermark("ts", late).groupBy(F.window("ts", window), "chamber").agg(F.count("*").alias("wafers"), F.sum(defect).alias("defects"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "chamber", "wafers", "defects", (F.col("defects") / F.col("wafers")).alias("rate"))


def run_to_table(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Drain a stream once, in update mode, into a table in the shared folder, and read the last state of every key.

    Each micro-batch overwrites its own folder, so a retry adds nothing twice. Windows that are still open are in the
    table: what a stream gives at its end is what the same rows give as a batch. An empty stream gives no rows."""
    spark = stream.sparkSession
    path = shared_path(spark, name)
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/epoch=-1")

    def store(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{path}-log").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(path)
    values = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "epoch").alias("last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"last.{c}").alias(c) for c in stream.columns])


def validate_stream(wafers: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Check a stream of raw maps: accepted wafers, and the quarantine with its reasons. Each micro-batch is
    checked once and overwrites its own folder, so a retry adds nothing twice. Both are empty for an empty stream."""
    spark = wafers.sparkSession
    path = shared_path(spark, name)
    validate_wafers(spark.createDataFrame([], wafers.schema)).write.parquet(f"{path}/epoch=-1")

    def store(batch: DataFrame, epoch: int) -> None:
        validate_wafers(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    wafers.writeStream.foreachBatch(store).option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start().awaitTermination()
    return split_valid(spark.read.parquet(path).drop("epoch"))
