"""Live counts straight from Spark's windowed streaming aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def live_traffic(flows: DataFrame, window: str = "1 minute", delay: str = "1 minute") -> DataFrame:
    """Records and bytes per window and protocol, final once the watermark passes the window."""
    return (flows.withWatermark("timestamp", delay)
            .groupBy(F.window("timestamp", window).alias("w"), "protocol")
            .agg(F.count(F.lit(1)).alias("records"), F.sum("packet_length").alias("bytes"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "protocol", "records", "bytes"))


def live_alerts(alerts: DataFrame, window: str = "1 minute", delay: str = "1 minute") -> DataFrame:
    """Alerts per window and severity."""
    return (alerts.withWatermark("timestamp", delay)
            .groupBy(F.window("timestamp", window).alias("w"), "severity")
            .agg(F.count(F.lit(1)).alias("alerts"))
            .select(F.col("w.start").alias("window_start"), "severity", "alerts"))
