"""Brute force: many connections from one source to one service in a short time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import DEFAULT, Settings, us
from ..functions.text import plain, seconds_between, seen_text
from ..operators.incidents import rows_of_incidents, to_units
from ..schema import as_alerts
from .sliding import SlidingRule

SERVICE = ["src_ip", "dst_ip", "dst_port"]


def watched(flows: DataFrame, ports: tuple[int, ...]) -> DataFrame:
    """Rows to the monitored ports; no ports means all of them."""
    return flows.where(F.col("dst_port").isin(*ports)) if ports else flows


def brute_force_rule(s: Settings = DEFAULT) -> SlidingRule:
    p, window = s.brute_force, us(s.brute_force.window_s)

    def summarise(units: DataFrame, found: DataFrame) -> DataFrame:
        return rated(rows_of_incidents(units, found, SERVICE, window, s.tile_windows)
                     .groupBy(*SERVICE, "start_us", "end_us", "peak").agg(F.sum("n").alias("connections")))

    def rated(table: DataFrame) -> DataFrame:
        high = F.col("peak") >= p.high_from_peak
        return table.withColumn("severity", F.when(high, "HIGH").otherwise("MEDIUM"))

    def typed(found: DataFrame) -> DataFrame:
        return rated(found.select(*SERVICE, "start_us", "end_us", "peak", F.col("events").alias("connections")))

    return SlidingRule(
        "brute_force", tuple(SERVICE), window, p.connections_over, None,
        select=lambda flows: watched(flows, p.ports).select(*SERVICE, "ts_us"),
        units=lambda rows: to_units(rows, SERVICE),
        summarise=summarise, alerts=lambda table: _alerts(table, s), typed=typed, tile_windows=s.tile_windows)


def brute_force_incidents(flows: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    return brute_force_rule(s).table(flows)


def brute_force_alerts(flows: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    return _alerts(brute_force_incidents(flows, s), s)


def _alerts(table: DataFrame, s: Settings) -> DataFrame:
    p = s.brute_force
    duration = seconds_between(F.col("start_us"), F.col("end_us"))
    return as_alerts(table.select(
        F.lit("BRUTE_FORCE").alias("alert_type"), "severity",
        F.col("src_ip").alias("source_ip"), F.col("dst_ip").alias("dest_ip"),
        F.format_string(f"Brute force on port %d: %d connections in %.1fs (peak %d in {plain(p.window_s)}s, "
                        f"threshold >{p.connections_over})",
                        "dst_port", "connections", duration, "peak").alias("description"),
        F.col("start_us").alias("first_us"), F.col("end_us").alias("last_us"),
        F.to_json(F.struct(
            "connections", "dst_port", F.round(duration, 3).alias("duration_seconds"),
            seen_text(F.col("start_us")).alias("first_seen"), seen_text(F.col("end_us")).alias("last_seen"),
            F.col("peak").alias("peak_connections_in_window"))).alias("details"),
        F.array("src_ip", "dst_ip", F.col("dst_port").cast("string")).alias("key_parts"),
    ))
