"""Traffic and alert summaries: the tables behind dashboards and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DEFAULT, Settings
from ..functions.text import clock_span, human_bytes, human_span
from ..schema import ALERT_LABEL, SEVERITY_RANK, literal_map

RECENT_DETECTORS = ("DNS_TUNNELING", "BEACONING", "TIME_OF_DAY_ANOMALY", "THREAT_INTEL_HIT")


# -- traffic ---------------------------------------------------------------------------------

def traffic_summary(flows: DataFrame) -> DataFrame:
    """One row: records, bytes, mean size, distinct ends, time span.

    Distinct counts start from (src, dst, port) cells, so the triple expansion they need runs on
    pre-aggregated rows.
    """
    cells = flows.groupBy("src_ip", "dst_ip", "dst_port").agg(
        F.count(F.lit(1)).alias("n"), F.sum("packet_length").alias("bytes"),
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    return cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"),
        (F.sum("bytes") / F.sum("n")).alias("mean_bytes"),
        F.count_distinct("src_ip").alias("sources"), F.count_distinct("dst_ip").alias("destinations"),
        F.count_distinct("dst_port").alias("dst_ports"),
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))


def traffic_display(flows: DataFrame) -> DataFrame:
    """The summary as display text."""
    seconds = (F.col("last_us") - F.col("first_us")) / F.lit(1e6)
    return traffic_summary(flows).select(
        F.format_number("records", 0).alias("records"), human_bytes(F.col("total_bytes")).alias("total_bytes"),
        human_bytes(F.col("total_bytes"), binary=True).alias("total_bytes_binary"),
        F.format_number("mean_bytes", 0).alias("mean_bytes"),
        F.date_format(F.timestamp_micros("first_us"), "yyyy-MM-dd HH:mm:ss").alias("first_seen"),
        F.date_format(F.timestamp_micros("last_us"), "yyyy-MM-dd HH:mm:ss").alias("last_seen"),
        human_span(seconds).alias("span"), clock_span(seconds).alias("clock_span"))


def protocol_distribution(flows: DataFrame) -> DataFrame:
    counts = flows.groupBy("protocol").agg(F.count(F.lit(1)).alias("records"))
    total = counts.agg(F.sum("records")).scalar()
    return counts.withColumn("percent", F.round(F.col("records") * 100 / total, 1)).orderBy(
        F.desc("records"), F.asc("protocol"))


def protocol_pie(flows: DataFrame, n: int = DEFAULT.report.top_n) -> DataFrame:
    """The n-1 most frequent protocols; the rest becomes "Other"."""
    counts = flows.groupBy("protocol").agg(F.count(F.lit(1)).alias("records"))
    top = counts.orderBy(F.desc("records"), F.asc("protocol")).limit(n - 1)
    rest = (counts.join(F.broadcast(top.select("protocol")), "protocol", "left_anti")     # n-1 rows
            .agg(F.sum("records").alias("records")).where(F.col("records").isNotNull())
            .select(F.lit("Other").alias("protocol"), "records"))
    return top.unionByName(rest)


def talkers_by_packets(flows: DataFrame, n: int = DEFAULT.report.top_n) -> DataFrame:
    """The n busiest sources, ranked."""
    cells = flows.groupBy("src_ip", "dst_port").agg(F.count(F.lit(1)).alias("n"), F.sum("packet_length").alias("bytes"))
    return (cells.groupBy("src_ip").agg(F.sum("n").alias("packets"), F.sum("bytes").alias("bytes"),
                                        F.count(F.lit(1)).alias("dst_ports"))
            .orderBy(F.desc("packets"), F.asc("src_ip")).limit(n))


def talkers_by_bytes(flows: DataFrame, n: int = DEFAULT.report.top_n) -> DataFrame:
    return (flows.groupBy("src_ip").agg(F.sum("packet_length").alias("bytes"))
            .orderBy(F.desc("bytes"), F.asc("src_ip")).limit(n))


def ranked(top: DataFrame, *order: Column) -> DataFrame:
    """Add ``rank`` to a short (already limited) table."""
    from pyspark.sql import Window
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def talkers_with_alerts(flows: DataFrame, alerts: DataFrame, n: int = DEFAULT.report.top_n) -> DataFrame:
    """Busiest sources with the number and worst severity of their alerts."""
    top = ranked(talkers_by_packets(flows, n), F.desc("packets"), F.asc("src_ip"))
    raised = alerts.join(F.broadcast(top.select(F.col("src_ip").alias("source_ip"))), "source_ip",
                         "left_semi").groupBy(F.col("source_ip").alias("src_ip")).agg(      # n rows
        F.count(F.lit(1)).alias("alerts"), F.max_by("severity", "severity_rank").alias("worst"))
    return top.join(F.broadcast(raised), "src_ip", "left").select(
        "rank", "src_ip", "packets", "bytes", "dst_ports", F.coalesce("alerts", F.lit(0)).alias("alerts"), "worst")


def _slice(ts: Column, start: Column, end: Column, slices: int) -> Column:
    """The first of ``slices`` equal steps of [start, end] whose end is not before ``ts``."""
    span = F.greatest(end - start, F.lit(1).cast("bigint"))
    return F.greatest(F.lit(1).cast("bigint"), F.call_function(
        "div", (ts - start) * slices + span - 1, span))


def replay_totals(flows: DataFrame, alerts: DataFrame, slices: int = DEFAULT.report.slices) -> DataFrame:
    """Traffic and alerts seen so far at the end of each time slice (every slice is present)."""
    bounds = flows.agg(F.struct(F.min("ts_us").alias("a"), F.max("ts_us").alias("b"))).scalar()

    def per_slice(df: DataFrame, ts: Column, *aggs: Column) -> DataFrame:
        return (df.select("*", bounds.alias("_b")).withColumn("slice", _slice(ts, F.col("_b.a"), F.col("_b.b"), slices))
                .where(F.col("slice") <= slices).groupBy("slice").agg(*aggs))

    from pyspark.sql import Window
    traffic = per_slice(flows, F.col("ts_us"), F.count(F.lit(1)).alias("n"), F.sum("packet_length").alias("bytes"))
    raised = per_slice(alerts, F.unix_micros("timestamp"), F.count(F.lit(1)).alias("alerts"))
    every = flows.sparkSession.range(1, slices + 1).withColumnRenamed("id", "slice")
    so_far = Window.partitionBy(F.lit(0)).orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)  # slices rows

    def running(c: str) -> Column:
        return F.coalesce(F.sum(F.coalesce(c, F.lit(0))).over(so_far), F.lit(0)).cast("bigint").alias(c)

    return (every.join(F.broadcast(traffic), "slice", "left").join(F.broadcast(raised), "slice", "left")
            .select("slice", running("n"), running("bytes"), running("alerts")))


# -- alerts ----------------------------------------------------------------------------------

def alert_timeline(alerts: DataFrame, buckets: int = DEFAULT.report.timeline_buckets) -> DataFrame:
    """``bucket, severity, alerts``: equal-width histogram over the alerts' own time range."""
    facts = alerts.agg(F.struct(F.min(F.unix_micros("timestamp")).alias("a"), F.max(F.unix_micros("timestamp")).alias("b"),
                                F.count(F.lit(1)).alias("n"))).scalar()
    width = F.greatest(F.col("_f.b") - F.col("_f.a"), F.lit(1_000_000).cast("bigint"))
    count = F.greatest(F.lit(1).cast("bigint"), F.least(F.lit(buckets).cast("bigint"), F.col("_f.n") * 2))
    at = F.call_function("div", (F.unix_micros("timestamp") - F.col("_f.a")) * count, width)
    return (alerts.select("timestamp", "severity", facts.alias("_f"))
            .withColumn("bucket", F.least(at, count - 1))
            .groupBy("bucket", "severity").agg(F.count(F.lit(1)).alias("alerts")))


def method_breakdown(alerts: DataFrame) -> DataFrame:
    """Per raised type: label, method and counts per severity."""
    return alerts.groupBy("alert_type", "label", "method").agg(
        F.count(F.lit(1)).alias("alerts"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("HIGH", "MEDIUM", "LOW")])


def method_totals(alerts: DataFrame) -> DataFrame:
    """Alerts per (method, type), per method, and overall; totals have null names."""
    return alerts.rollup("method", "alert_type").agg(F.count(F.lit(1)).alias("alerts"))


def top_sources(alerts: DataFrame, n: int = DEFAULT.report.top_n) -> DataFrame:
    return (alerts.groupBy("source_ip").agg(F.count(F.lit(1)).alias("alerts"))
            .orderBy(F.desc("alerts"), F.asc("source_ip")).limit(n))


def top_threats(alerts: DataFrame, n: int = 5) -> DataFrame:
    return (alerts.groupBy("alert_type", "label").agg(F.count(F.lit(1)).alias("alerts"))
            .orderBy(F.desc("alerts"), F.asc("alert_type")).limit(n))


def worst_per_source(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("source_ip").agg(
        F.count(F.lit(1)).alias("alerts"), F.max_by("severity", "severity_rank").alias("worst"))


def best_finding_per_type(alerts: DataFrame) -> DataFrame:
    """For each of the four newer detectors: count, worst severity and most notable alert."""
    order = F.struct("severity_rank", "timestamp", "alert_key")
    found = alerts.where(F.col("alert_type").isin(*RECENT_DETECTORS)).groupBy("alert_type").agg(
        F.count(F.lit(1)).alias("alerts"),
        F.max_by(F.struct("severity", "source_ip", "dest_ip", "description"), order).alias("t"))
    every = alerts.sparkSession.createDataFrame([(t,) for t in RECENT_DETECTORS], "alert_type string")
    return every.join(F.broadcast(found), "alert_type", "left").select(     # four rows
        "alert_type", F.try_element_at(literal_map(ALERT_LABEL), F.col("alert_type")).alias("label"),
        F.coalesce("alerts", F.lit(0)).alias("alerts"), F.coalesce("t.severity", F.lit("-")).alias("worst"),
        F.coalesce(F.concat("t.source_ip", F.lit(" -> "), "t.dest_ip", F.lit(": "), "t.description"),
                   F.lit("nothing detected")).alias("finding"))


def kpis(flows: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: records, alerts, counts per severity, flagged sources."""
    records = flows.agg(F.count(F.lit(1))).scalar()
    return alerts.agg(
        F.count(F.lit(1)).alias("alerts"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITY_RANK],
        F.count_distinct("source_ip").alias("flagged_sources")).select(records.alias("records"), "*")


def report_tables(flows: DataFrame, alerts: DataFrame, s: Settings = DEFAULT) -> dict[str, DataFrame]:
    """Everything a report shows, by name."""
    from .alerts import by_severity, count_by_severity, flat_view
    r = s.report
    return {
        "summary": traffic_summary(flows), "display": traffic_display(flows), "kpis": kpis(flows, alerts),
        "protocols": protocol_pie(flows, r.top_n), "talkers": talkers_by_bytes(flows, r.top_n),
        "timeline": alert_timeline(alerts, r.timeline_buckets), "severities": count_by_severity(alerts),
        "methods": method_breakdown(alerts), "method_totals": method_totals(alerts),
        "top_sources": top_sources(alerts, 5), "top_threats": top_threats(alerts, 5),
        "alerts": flat_view(by_severity(alerts)),
    }
