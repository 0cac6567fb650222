"""Structured Streaming over append-only logs and chunk landing folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.sources.files import upsert_parquet


def log_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).option("mode", "DROPMALFORMED")
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).json(path)


def daily_costs(log: DataFrame, late: str = "1 day") -> DataFrame:
    """Calls and cost by day and endpoint; rows later than ``late`` are dropped with their window's state."""
    w = log.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), F.lower(F.coalesce("endpoint", F.lit("unknown"))).alias("endpoint"))
    return w.agg(F.count("*").alias("calls"), F.round(F.sum(F.coalesce("cost_usd", F.lit(0.0))), 6).alias("cost")).select(F.to_date("window.start").alias("day"), "endpoint", "calls", "cost")


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Calls and cost of each user's sessions, which end after ``gap`` without a call."""
    w = log.withWatermark("ts", late).groupBy(F.session_window("ts", gap), F.coalesce("user_id", F.lit("0")).alias("user_id"))
    return w.agg(F.count("*").alias("calls"), F.round(F.sum(F.coalesce("cost_usd", F.lit(0.0))), 6).alias("cost")).select(F.col("session_window.start").alias("start"), "user_id", "calls", "cost")


def first_seen(chunks: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Chunks without those of an id seen before within ``late``."""
    return chunks.withWatermark(ts, late).dropDuplicatesWithinWatermark(["id"])


def upsert_sink(path: str, key: str = "id") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: upsert each batch into the store. A batch that runs twice leaves the same store."""

    def run(batch: DataFrame, _epoch: int) -> None:
        upsert_parquet(batch.sparkSession, path, batch.dropDuplicates([key]), key)

    return run
