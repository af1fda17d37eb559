"""DNS tunnelling: an unusual rate of DNS queries from one source."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import DEFAULT, Settings, us
from ..functions.text import peer_label, plain, seconds_between, seen_text
from ..operators.firsts import first_values
from ..operators.incidents import rows_of_incidents, to_units
from ..schema import as_alerts
from .brute_force import watched
from .sliding import SlidingRule


def dns_rule(s: Settings = DEFAULT) -> SlidingRule:
    p, window = s.dns, us(s.dns.window_s)

    def summarise(units: DataFrame, found: DataFrame) -> DataFrame:
        incident = ["src_ip", "start_us", "end_us", "peak"]
        # One row per resolver: everything below works on this, not on queries.
        cells = (rows_of_incidents(units, found, ["src_ip"], window, s.tile_windows)
                 .groupBy(*incident, "dst_ip").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")))
        totals = cells.groupBy(*incident).agg(F.sum("n").alias("queries"), F.sum("bytes").alias("total_bytes"))
        resolvers = first_values(cells, incident, "dst_ip", s.list_limit, "resolvers")
        return rated(totals.join(resolvers, incident))

    def rated(table: DataFrame) -> DataFrame:
        return (table.withColumn("avg_query_bytes", F.round(F.col("total_bytes") / F.col("queries"), 1))
                .withColumn("severity", F.when(F.col("peak") > p.high_over_peak, "HIGH").otherwise("MEDIUM")))

    def typed(found: DataFrame) -> DataFrame:
        return rated(found.select("src_ip", "start_us", "end_us", "peak", F.col("events").alias("queries"), F.col("bytes").alias("total_bytes"),
                                  F.col("cells").alias("resolvers_count"), F.col("first").alias("resolvers")))

    return SlidingRule(
        "dns", ("src_ip",), window, p.queries_over, None,
        select=lambda flows: watched(flows, p.ports).select("src_ip", "dst_ip", "ts_us", "packet_length"),
        units=lambda rows: to_units(rows, ["src_ip", "dst_ip"], [F.sum("packet_length").alias("bytes")]),
        summarise=summarise, alerts=lambda table: _alerts(table, s), typed=typed, cell="dst_ip",
        limit=s.list_limit, tile_windows=s.tile_windows)


def dns_incidents(flows: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    return dns_rule(s).table(flows)


def dns_alerts(flows: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    return _alerts(dns_incidents(flows, s), s)


def _alerts(table: DataFrame, s: Settings) -> DataFrame:
    p = s.dns
    duration = seconds_between(F.col("start_us"), F.col("end_us"))
    return as_alerts(table.select(
        F.lit("DNS_TUNNELING").alias("alert_type"), "severity", F.col("src_ip").alias("source_ip"),
        peer_label(F.col("resolvers_count"), F.get("resolvers", F.lit(0))).alias("dest_ip"),
        F.format_string(f"Possible DNS tunneling: %d DNS queries in %.1fs (peak %d in {plain(p.window_s)}s, "
                        f"threshold >{p.queries_over})", "queries", duration, "peak").alias("description"),
        F.col("start_us").alias("first_us"), F.col("end_us").alias("last_us"),
        F.to_json(F.struct(
            "avg_query_bytes", F.round(duration, 3).alias("duration_seconds"),
            seen_text(F.col("start_us")).alias("first_seen"), seen_text(F.col("end_us")).alias("last_seen"),
            F.col("peak").alias("peak_queries_in_window"), "queries", "resolvers",
            "total_bytes")).alias("details"),
        F.array("src_ip").alias("key_parts"),
    ))
