"""Continuous run health: latest state and status counts per crawl source, kept in a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfsight.functions import lexicons as lx


def run_health(runs: DataFrame) -> DataFrame:
    """Works on a batch and, in update or complete mode, on a stream: the state is one row per source."""
    latest = F.max_by(F.struct("run_id", "status", "created_at"), F.struct("created_at", "run_id"))
    counts = [F.count_if(F.col("status") == s).alias(f"{s}_runs") for s in lx.RUN_STATUSES]
    return runs.groupBy("crawl_source_id").agg(latest.alias("_r"), *counts).select(
        "crawl_source_id", F.col("_r.run_id").alias("last_run_id"), F.col("_r.status").alias("last_status"), *[f"{s}_runs" for s in lx.RUN_STATUSES])


def write_changes(changed: DataFrame, table: str, epoch: int) -> None:
    """The sources that an epoch changed, whole rows; an epoch that is run again replaces its own."""
    changed.write.mode("overwrite").parquet(f"{table}/epoch={epoch}")


def start_health(runs: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Only changed sources leave the stream; nothing is held on the driver."""
    return run_health(runs).writeStream.outputMode("update").foreachBatch(lambda batch, epoch: write_changes(batch, table, epoch)).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_health(spark: SparkSession, table: str) -> DataFrame:
    """Every source as its last change left it."""
    changes = spark.read.parquet(table)
    columns = [c for c in changes.columns if c not in ("crawl_source_id", "epoch")]
    return changes.groupBy("crawl_source_id").agg(F.max_by(F.struct(*columns), "epoch").alias("_last")).select("crawl_source_id", "_last.*")
