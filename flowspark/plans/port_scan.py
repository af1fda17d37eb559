"""Port scans: one source probing many ports of one host in a short time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import DEFAULT, Settings, us
from ..functions.text import plain, seconds_between, seen_text
from ..operators.incidents import rows_of_incidents, to_units
from ..schema import as_alerts
from .sliding import SlidingRule

PAIR = ["src_ip", "dst_ip"]


def port_scan_rule(s: Settings = DEFAULT) -> SlidingRule:
    p, window = s.port_scan, us(s.port_scan.window_s)

    def summarise(units: DataFrame, found: DataFrame) -> DataFrame:
        incident = PAIR + ["start_us", "end_us", "peak"]
        cells = (rows_of_incidents(units, found, PAIR, window, s.tile_windows)
                 .groupBy(*incident, "dst_port").agg(F.sum("n").alias("n")))
        return rated(cells.groupBy(*incident).agg(
            F.count(F.lit(1)).alias("unique_ports"),
            F.sum("n").alias("events"),
            # At most 65,536 ports exist, so this list is bounded.
            F.slice(F.sort_array(F.collect_list("dst_port")), 1, s.list_limit).alias("sample_ports")))

    def rated(table: DataFrame) -> DataFrame:
        high = F.col("unique_ports") >= p.high_from_ports
        return table.withColumn("severity", F.when(high, "HIGH").otherwise("MEDIUM"))

    def typed(found: DataFrame) -> DataFrame:
        return rated(found.select(*PAIR, "start_us", "end_us", "peak", F.col("cells").alias("unique_ports"), "events",
                                  F.col("first").cast("array<int>").alias("sample_ports")))

    return SlidingRule(
        "port_scan", tuple(PAIR), window, p.ports_over, "dst_port",
        select=lambda flows: flows.select(*PAIR, "dst_port", "ts_us"),
        units=lambda rows: to_units(rows, PAIR + ["dst_port"]),
        summarise=summarise, alerts=lambda table: _alerts(table, s), typed=typed, cell="dst_port", numeric=True,
        limit=s.list_limit, tile_windows=s.tile_windows)


def port_scan_incidents(flows: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    return port_scan_rule(s).table(flows)


def port_scan_alerts(flows: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    return _alerts(port_scan_incidents(flows, s), s)


def _alerts(table: DataFrame, s: Settings) -> DataFrame:
    p = s.port_scan
    duration = seconds_between(F.col("start_us"), F.col("end_us"))
    return as_alerts(table.select(
        F.lit("PORT_SCAN").alias("alert_type"), "severity",
        F.col("src_ip").alias("source_ip"), F.col("dst_ip").alias("dest_ip"),
        F.format_string(f"Port scan: %d unique ports probed in %.1fs (threshold >{p.ports_over} in "
                        f"{plain(p.window_s)}s)", "unique_ports", duration).alias("description"),
        F.col("start_us").alias("first_us"), F.col("end_us").alias("last_us"),
        F.to_json(F.struct(
            F.round(duration, 3).alias("duration_seconds"), "events",
            seen_text(F.col("start_us")).alias("first_seen"), seen_text(F.col("end_us")).alias("last_seen"),
            F.col("peak").alias("peak_ports_in_window"), "sample_ports", "unique_ports")).alias("details"),
        F.array("src_ip", "dst_ip").alias("key_parts"),
    ))
