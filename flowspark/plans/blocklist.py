"""Traffic with listed hosts: static blocklist and threat feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DEFAULT, Settings
from ..functions.text import peer_label, port_list, seen_text
from ..operators.containment import endpoints, listed, static_entries
from ..operators.firsts import first_values
from ..schema import as_alerts
from ..session import stored

GROUP = ["bad_ip", "outbound"]


def listed_hosts(flows: DataFrame, s: Settings = DEFAULT, feeds: DataFrame | None = None) -> DataFrame:
    """Addresses of ``flows`` that are listed: tested once per distinct address."""
    return listed(endpoints(flows), static_entries(flows.sparkSession, s.blocklist), feeds)


def listed_rows(flows: DataFrame, hosts: DataFrame) -> DataFrame:
    """Rows with a listed end.  The listed destination decides the direction when both are."""
    at_dst = hosts.select(F.col("ip").alias("dst_ip"), F.col("static_hit").alias("_ds"),
                          F.col("source").alias("_dsrc"))
    at_src = hosts.select(F.col("ip").alias("src_ip"), F.col("static_hit").alias("_ss"),
                          F.col("source").alias("_ssrc"))
    both = flows.join(at_dst, "dst_ip", "left").join(at_src, "src_ip", "left")
    out = F.col("_ds").isNotNull()

    def pick(at_out: Column | str, at_in: Column | str) -> Column:
        return F.when(out, at_out if isinstance(at_out, Column) else F.col(at_out)).otherwise(
            at_in if isinstance(at_in, Column) else F.col(at_in))

    return (both.where(F.col("_ds").isNotNull() | F.col("_ss").isNotNull())
            .select(*flows.columns, out.alias("outbound"), pick("dst_ip", "src_ip").alias("bad_ip"),
                    pick("src_ip", "dst_ip").alias("peer_ip"), pick("_ds", "_ss").alias("static_hit"),
                    pick("_dsrc", "_ssrc").alias("source")))


def listed_cells(flows: DataFrame, hosts: DataFrame) -> DataFrame:
    """Partial sums per (listed host, direction, peer, port): mergeable across batches."""
    return (listed_rows(flows.select("src_ip", "dst_ip", "dst_port", "packet_length", "ts_us"), hosts)
            .groupBy(*GROUP, "static_hit", "source", "peer_ip", "dst_port")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("packet_length").alias("bytes"),
                 F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us")))


def listed_groups(cells: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """One row per (listed host, direction)."""
    totals = cells.groupBy(*GROUP).agg(
        F.first("static_hit").alias("static_hit"), F.first("source").alias("source"),
        F.sum("n").alias("events"), F.sum("bytes").alias("total_bytes"),
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
        F.sort_array(F.collect_set("dst_port")).alias("dst_ports"),      # at most 65,536
    )
    peers = first_values(cells, GROUP, "peer_ip", s.list_limit, "peers")
    return totals.join(peers, GROUP).withColumn(
        "severity", F.when(F.col("outbound"), "HIGH").otherwise("MEDIUM"))


def blocklist_alerts(flows: DataFrame, s: Settings = DEFAULT, feeds: DataFrame | None = None) -> DataFrame:
    return blocklist_alerts_from(stored(listed_cells(flows, listed_hosts(flows, s, feeds)), "listed"), s)


def blocklist_alerts_from(cells: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    peer = peer_label(F.col("peers_count"), F.get("peers", F.lit(0)))
    out, static = F.col("outbound"), F.col("static_hit")
    direction = F.when(out, "Outbound connections to").otherwise("Inbound traffic from")
    subject = F.when(static, F.format_string("%s blacklisted host %s", direction, "bad_ip")).otherwise(
        F.format_string("%s host %s listed in threat feed '%s'", direction, "bad_ip", "source"))
    return as_alerts(listed_groups(cells, s).select(
        F.when(static, "BLACKLISTED_IP").otherwise("THREAT_INTEL_HIT").alias("alert_type"), "severity",
        F.when(out, peer).otherwise(F.col("bad_ip")).alias("source_ip"),
        F.when(out, F.col("bad_ip")).otherwise(peer).alias("dest_ip"),
        F.format_string("%s: %d events, %d internal peer(s), dst ports %s", subject, "events", "peers_count",
                        port_list(F.slice("dst_ports", 1, 5))).alias("description"),
        "first_us", "last_us",
        F.to_json(F.struct(
            F.col("bad_ip").alias("blacklisted_ip"), F.when(out, "outbound").otherwise("inbound").alias("direction"),
            "dst_ports", "events", seen_text(F.col("first_us")).alias("first_seen"),
            seen_text(F.col("last_us")).alias("last_seen"), "peers",
            F.when(~static, F.col("source")).alias("threat_feed"), "total_bytes")).alias("details"),
        F.array(F.col("bad_ip"), F.when(out, "outbound").otherwise("inbound")).alias("key_parts"),
    ))
