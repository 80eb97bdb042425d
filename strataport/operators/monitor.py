"""Lag, trend, time left and batch statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running


def lag_trend(readings: DataFrame, at: str = "taken_at", lag: str = "bytes", slot: str | None = None, window: int = 10) -> DataFrame:
    """Readings with trend (bytes a second over the last ``window`` readings; null for fewer than two or no time between)
    and eta_seconds (rounded down; null unless the lag shrinks). Readings are few: one every few seconds of a run."""
    w = (Window.partitionBy(slot) if slot else Window.partitionBy(F.lit(0))).orderBy(at).rowsBetween(1 - window, 0)
    first_lag, first_at, n = F.first(lag).over(w), F.first(at).over(w), F.count(F.lit(1)).over(w)
    elapsed = F.col(at) - first_at
    trend = F.when((n >= 2) & (elapsed > 0), (F.col(lag) - first_lag) / elapsed.cast("double"))
    out = readings.withColumn("trend", trend)
    return out.withColumn("eta_seconds", F.when(F.col("trend") < 0, F.floor(F.col(lag) / -F.col("trend"))).cast("long"))


def readiness(lag: Column, threshold: int) -> Column:
    """caught_up, ready or behind."""
    return F.when(lag == 0, "caught_up").when(lag <= threshold, "ready").otherwise("behind")


def acknowledged(log: DataFrame, lsn: Column, order: str, by: str) -> DataFrame:
    """The log with ack, the greatest position so far of each stream ``by``."""
    return running(log, [order], by, ack=("max", lsn))


def batch_stats(batches: DataFrame, by: str = "table_name") -> DataFrame:
    """Per table: batches, rows, the mean of the batches' rows a second (one decimal; 0 without any), and the last batch."""
    rate = F.avg(F.col("row_count") / F.nullif(F.col("duration_ms"), F.lit(0)) * 1000)
    return batches.groupBy(by).agg(
        F.count(F.lit(1)).alias("batch_count"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.round(rate, 1), F.lit(0.0)).alias("avg_rows_per_sec"), F.max_by("end_key", "batch_no").alias("last_key")
    )
