"""Streams: the job queue, trace rollups and rate limits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

JOB = "id string, kind string, payload string, created_at timestamp"


def job_stream(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """Jobs from files in a folder, oldest files first; a checkpoint takes the place of leases."""
    return spark.readStream.schema(JOB).option("maxFilesPerTrigger", per_trigger).option("latestFirst", "false").json(folder)


def run_jobs(jobs: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Apply ``work`` to each batch and write it under the batch's number; a replayed batch overwrites itself."""

    def batch(df: DataFrame, number: int) -> None:
        work(df.orderBy("created_at", "id")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def trace_rollup(traces: DataFrame, ts: str = "ts", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Tumbling counts, sums and approximate latency percentiles under a watermark."""
    w = traces.withWatermark(ts, late).groupBy(F.window(ts, window), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.percentile_approx("value", [0.5, 0.95]).alias("latency"))


def request_counts(events: DataFrame, key: str, ts: str = "ts", late: str = "10 minutes", length: str = "60 seconds", step: str = "10 seconds") -> DataFrame:
    """Requests of each key in sliding windows, for limits."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length, step), key).agg(F.count("*").alias("requests"))
