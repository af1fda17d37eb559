"""Registered queries: name -> function(spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import ML_FEATURES, OffHours, Settings
from ..operators import containment, incidents as inc, validate
from ..operators.quantiles import exact_quantiles
from ..plans import alerts as algebra, beaconing, blocklist, brute_force, dns_tunnel, engine, features, forest
from ..plans import off_hours, port_scan, summary
from ..schema import FLOW_FIELDS
from ..session import pin, shared_dir, stored
from ..sources import capture, feeds as feed_source, logs
from ..sources.profiles import NATIVE_HEADER, PROFILES, custom_profile, resolve_layout
from ..sources.tables import events_flows, events_to_flows, lineitem_flows
from ..streaming import live, logs as log_stream
from ..streaming.detector import EVERY, StreamDetector
from ..config import us
from . import inputs
from .inputs import EVENTS, LINEITEM

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = lambda spark, folder: fn(pin(spark), folder)
        return QUERIES[name]
    return add


def joined(array: str) -> Column:
    return F.array_join(F.col(array).cast("array<string>"), ",")


def us_times(df: DataFrame) -> DataFrame:
    """Times as epoch microseconds: comparable whatever the engine."""
    return df.select(*[F.unix_micros(c).alias(f"{c}_us") if t == "timestamp" else F.col(c) for c, t in df.dtypes])


def plain_alerts(alerts: DataFrame) -> DataFrame:
    return us_times(alerts.select("timestamp", "alert_type", "severity", "severity_rank", "method", "label",
                                  "source_ip", "dest_ip", "description", "last_seen"))


# -- flows -----------------------------------------------------------------------------------

@query("flows_from_events")
def _(spark, d):
    return events_flows(spark, d).drop("timestamp")


@query("flows_from_lineitem")
def _(spark, d):
    return lineitem_flows(spark, d).drop("timestamp").groupBy("src_ip", "dst_ip").agg(
        F.count(F.lit(1)).alias("n"), F.sum("packet_length").alias("bytes"), F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"), F.count_distinct("dst_port").alias("ports"))


@query("endpoints")
def _(spark, d):
    return containment.endpoints(events_flows(spark, d))


@query("busy_scan_pairs")
def _(spark, d):
    return inc.busy_keys(events_flows(spark, d), ["src_ip", "dst_ip"], 10, "dst_port")


@query("busy_pairs")
def _(spark, d):
    return inc.busy_keys(lineitem_flows(spark, d), ["src_ip", "dst_ip"], 100)


# -- sliding rules ---------------------------------------------------------------------------

def _scan_rows(df: DataFrame) -> DataFrame:
    return df.withColumn("sample_ports", joined("sample_ports"))


@query("port_scan_incidents")
def _(spark, d):
    return _scan_rows(port_scan.port_scan_incidents(events_flows(spark, d), EVENTS))


@query("port_scan_incidents_tied")
def _(spark, d):
    return _scan_rows(port_scan.port_scan_incidents(lineitem_flows(spark, d), LINEITEM))


@query("port_scan_alerts")
def _(spark, d):
    return plain_alerts(port_scan.port_scan_alerts(events_flows(spark, d), EVENTS))


@query("brute_force_incidents")
def _(spark, d):
    return brute_force.brute_force_incidents(events_flows(spark, d), EVENTS)


@query("brute_force_incidents_tied")
def _(spark, d):
    return brute_force.brute_force_incidents(lineitem_flows(spark, d), LINEITEM)


@query("brute_force_alerts")
def _(spark, d):
    return plain_alerts(brute_force.brute_force_alerts(lineitem_flows(spark, d), LINEITEM))


@query("dns_incidents")
def _(spark, d):
    return dns_tunnel.dns_incidents(events_flows(spark, d), EVENTS).withColumn("resolvers", joined("resolvers"))


@query("dns_alerts")
def _(spark, d):
    return plain_alerts(dns_tunnel.dns_alerts(events_flows(spark, d), EVENTS))


@query("incident_rows")
def _(spark, d):
    keys, window = ["src_ip"], us(EVENTS.dns.window_s)
    rows = brute_force.watched(events_flows(spark, d), EVENTS.dns.ports)
    units = inc.to_units(rows, ["src_ip", "dst_ip", "seq"])
    found = inc.incidents(inc.to_units(rows, keys), keys, window, EVENTS.dns.queries_over)
    return inc.rows_of_incidents(units, found, keys, window).select("src_ip", "start_us", "end_us", "peak", "seq", "ts_us")


# -- group detectors -------------------------------------------------------------------------

@query("beacon_intervals")
def _(spark, d):
    p = EVENTS.beaconing
    units = inc.to_units(events_flows(spark, d), beaconing.PAIR)
    stats = beaconing.interval_stats(beaconing.tile_summaries(units, p), p)
    return stats.select("src_ip", "dst_ip", "connections", "first_us", "last_us",
                        *[F.round(c, 2).alias(c) for c in ("mean_s", "std_s", "min_s", "max_s")])


@query("beacons")
def _(spark, d):
    return beaconing.beacons(events_flows(spark, d), EVENTS).select(
        "src_ip", "dst_ip", "connections", "severity", "first_us", "last_us", joined("dst_ports").alias("dst_ports"))


@query("beacon_alerts")
def _(spark, d):
    return plain_alerts(beaconing.beacon_alerts(events_flows(spark, d), EVENTS))


def _off(df: DataFrame) -> DataFrame:
    return df.select("src_ip", "connections", "total_bytes", "first_us", "last_us", "destinations_count", "severity",
                     joined("destinations").alias("destinations"),
                     F.array_join(F.map_keys("top_dst_ports"), ",").alias("top_ports"),
                     F.array_join(F.map_values("top_dst_ports").cast("array<string>"), ",").alias("top_hits"))


@query("off_hours_sources")
def _(spark, d):
    return _off(off_hours.off_hours_sources(off_hours.off_hours_cells(events_flows(spark, d), EVENTS.off_hours), EVENTS))


@query("off_hours_wrapped")
def _(spark, d):
    s = Settings(off_hours=OffHours(20, 4, 40, 50))
    return _off(off_hours.off_hours_sources(off_hours.off_hours_cells(events_flows(spark, d), s.off_hours), s))


@query("off_hours_alerts")
def _(spark, d):
    return plain_alerts(off_hours.off_hours_alerts(events_flows(spark, d), EVENTS))


def _supplier_feeds(spark, d) -> DataFrame:
    return feed_source.parse_feed_lines(inputs.supplier_feed_lines(spark, d))


def _merged_feeds(spark, d) -> DataFrame:
    return containment.merge_feeds(_supplier_feeds(spark, d), containment.static_entries(spark, ("10.0.0.1", "10.0.0.2/32")))


def _feed_entries(spark, d) -> DataFrame:
    """Merged feeds in one precedence order."""
    return _merged_feeds(spark, d).select("entry", "source", (F.col("feed_ord") * 1_000_000_000 + F.col("ord")).alias("ord"))


@query("feed_entries")
def _(spark, d):
    return _supplier_feeds(spark, d)


@query("feed_merge")
def _(spark, d):
    return _merged_feeds(spark, d).select("entry", "source")


@query("feed_status")
def _(spark, d):
    return feed_source.feed_status(_supplier_feeds(spark, d))


@query("feed_intake")
def _(spark, d):
    return containment.entry_count(_feed_entries(spark, d))


@query("feed_combined_view")
def _(spark, d):
    return containment.combined_view(_merged_feeds(spark, d), containment.static_entries(spark, EVENTS.blocklist))


@query("listed_hosts")
def _(spark, d):
    return blocklist.listed_hosts(events_flows(spark, d), EVENTS, _feed_entries(spark, d))


@query("listed_rows")
def _(spark, d):
    flows = events_flows(spark, d)
    hosts = blocklist.listed_hosts(flows, EVENTS, _feed_entries(spark, d))
    return blocklist.listed_rows(flows, hosts).select("seq", "outbound", "bad_ip", "peer_ip", "static_hit")


def _listed(df: DataFrame) -> DataFrame:
    return df.withColumns({"dst_ports": joined("dst_ports"), "peers": joined("peers")})


@query("blocklist_groups")
def _(spark, d):
    flows = events_flows(spark, d)
    return _listed(blocklist.listed_groups(blocklist.listed_cells(flows, blocklist.listed_hosts(flows, EVENTS)), EVENTS))


@query("threat_feed_groups")
def _(spark, d):
    s = Settings(blocklist=("198.51.100.128/28",))
    flows = events_flows(spark, d)
    hosts = blocklist.listed_hosts(flows, s, _feed_entries(spark, d))
    return _listed(blocklist.listed_groups(blocklist.listed_cells(flows, hosts), s))


@query("blocklist_alerts")
def _(spark, d):
    return plain_alerts(blocklist.blocklist_alerts(events_flows(spark, d), EVENTS, _feed_entries(spark, d)))


# -- features and anomalies ------------------------------------------------------------------

def _with_features(spark, d) -> DataFrame:
    return features.flow_features(events_flows(spark, d), EVENTS)


@query("ml_features")
def _(spark, d):
    return _with_features(spark, d).select("seq", "packet_length", "src_conn_freq", "src_bytes_window", "pair_conn_freq")


@query("ml_baseline")
def _(spark, d):
    return forest.baseline(_with_features(spark, d))


@query("exact_quantiles")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    q = exact_quantiles(rows, ["l_quantity", "l_extendedprice"], (0.0, 0.03, 0.5, 0.97, 1.0))
    return q.select("name", "prob", F.round("quantile", 6).alias("quantile"))


def _surrogate(spark, d) -> tuple[DataFrame, forest.ForestModel]:
    """Features with a score any engine computes alike, to check everything after the forest, and their
    baseline; both read the features from storage.  What no anomaly shows is not carried along."""
    flows = events_flows(spark, d).drop("timestamp", "src_port", "protocol")
    rows = stored(features.flow_features(flows, EVENTS), "features")
    facts = forest.baseline(rows).collect()      # four rows
    scored = rows.withColumn("anomaly_score", F.round(F.lit(0.1) - F.col("src_bytes_window") / 200000.0, 6)).withColumn(
        "is_anomaly", F.col("anomaly_score") < 0)
    return scored, forest.ForestModel(None, 256, 0.0, {r["name"]: r["median"] for r in facts}, {r["name"]: r["spread"] for r in facts})


@query("anomaly_groups")
def _(spark, d):
    groups = forest.anomaly_groups(*_surrogate(spark, d), EVENTS)
    return groups.select("src_ip", "dst_ip", "severity", "anomalous_records", "anomaly_score", "top_feature",
                         "top_feature_value", F.round("top_feature_z", 2).alias("top_feature_z"),
                         "max_packet_length", "max_src_conn_freq", joined("dst_ports").alias("dst_ports"),
                         "first_us", "last_us")


@query("ml_corroborated")
def _(spark, d):
    ml = forest.anomaly_alerts(*_surrogate(spark, d), EVENTS)
    rules = engine.rule_alerts(events_flows(spark, d), EVENTS, names=["dns", "time_of_day"])
    return plain_alerts(algebra.corroborate(ml, rules))


WALK_TREES, WALK_DEPTH = 12, 3


def _walk_model(facts: dict) -> forest.ForestModel:
    """Full trees drawn by rule from the baseline, for any engine to walk: children of node i are 2 i + 1 and
    2 i + 2, level l of tree t asks for feature t + l, thresholds lie up to a spread from the median."""
    import pandas as pd
    nodes, inner = [], 2 ** WALK_DEPTH - 1
    for tree in range(WALK_TREES):
        for node in range(2 * inner + 1):
            level = (node + 1).bit_length() - 1
            f = (tree + level) % len(ML_FEATURES)
            median, spread = facts[ML_FEATURES[f]]
            if node < inner:
                nodes.append((tree, node, f, median + spread * ((tree * 7 + node * 3) % 9 - 4) / 4, 2 * node + 1, 2 * node + 2, 0.0))
            else:
                nodes.append((tree, node, -1, 0.0, node, node, WALK_DEPTH + (tree + node) % 5 * 0.5))
    return forest.ForestModel(pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "length"]), 256)


@query("forest_walk")
def _(spark, d):
    """Every flow through trees drawn by rule: what scoring makes of a known model."""
    rows = stored(_with_features(spark, d).select("seq", *ML_FEATURES), "walked")
    facts = {r["name"]: (r["median"], r["spread"]) for r in forest.baseline(rows).collect()}      # four rows
    return forest.score(rows, _walk_model(facts)).select("seq", F.round("raw_score", 6).alias("raw_score"))


@query("forest_samples")
def _(spark, d):
    """Training rows drawn for each tree: how many, how many distinct."""
    rows = stored(_with_features(spark, d).select("seq", *ML_FEATURES), "sampled")
    drawn = forest.draw_samples(rows, EVENTS.forest, rows.count())
    return drawn.groupBy(F.col("tree").cast("bigint").alias("tree")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("seq").alias("distinct_rows"))


@query("forest_scores")
def _(spark, d):
    _, scored, _ = forest.detect_anomalies(events_flows(spark, d), EVENTS)
    return scored.select("seq", F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly")


@query("detect_all")
def _(spark, d):
    return plain_alerts(engine.detect(events_flows(spark, d), EVENTS, _feed_entries(spark, d)).alerts)


@query("rule_alerts")
def _(spark, d):
    flows = events_flows(spark, d)
    return plain_alerts(algebra.in_time_order(engine.rule_alerts(
        flows, EVENTS, names=["port_scan", "dns", "time_of_day", "blocklist"])))


@query("rule_alerts_all")
def _(spark, d):
    """All six rules, feeds included."""
    return plain_alerts(engine.rule_alerts(events_flows(spark, d), EVENTS, _feed_entries(spark, d)))


# -- alert algebra ---------------------------------------------------------------------------

def _alerts(spark, d) -> DataFrame:
    return inputs.event_alerts(inputs.events(spark, d))


@query("merge_duplicates")
def _(spark, d):
    merged = algebra.merge_duplicates(_alerts(spark, d), EVENTS)
    return us_times(merged.select("alert_key", "alert_type", "severity", "timestamp", "first_seen", "last_seen",
                                  "details", "merged"))


@query("alerts_selected")
def _(spark, d):
    return plain_alerts(algebra.select_alerts(_alerts(spark, d), alert_type="PORT_SCAN", min_severity="MEDIUM"))


@query("alerts_searched")
def _(spark, d):
    return plain_alerts(algebra.search_alerts(
        _alerts(spark, d), ["HIGH", "MEDIUM"], ["Port scan", "Blacklisted IP"],
        F.lit("2024-01-05 00:00:00").cast("timestamp"), F.lit("2024-01-20 12:00:00").cast("timestamp"), "SEEN 4"))


@query("alerts_flat")
def _(spark, d):
    return us_times(algebra.flat_view(algebra.by_severity(_alerts(spark, d))))


@query("alerts_recent")
def _(spark, d):
    return plain_alerts(algebra.recent(_alerts(spark, d), 15))


@query("alerts_by_severity")
def _(spark, d):
    return algebra.count_by_severity(_alerts(spark, d))


@query("alerts_by_type")
def _(spark, d):
    return algebra.count_by_type(_alerts(spark, d))


@query("alert_log_lines")
def _(spark, d):
    return algebra.log_lines(_alerts(spark, d))


@query("alert_json")
def _(spark, d):
    return algebra.alert_json(_alerts(spark, d))


@query("alert_timeline")
def _(spark, d):
    return summary.alert_timeline(_alerts(spark, d), 48)


@query("alert_methods")
def _(spark, d):
    return summary.method_breakdown(_alerts(spark, d))


@query("alert_method_totals")
def _(spark, d):
    return summary.method_totals(_alerts(spark, d))


@query("alert_top_sources")
def _(spark, d):
    return summary.top_sources(_alerts(spark, d), 10)


@query("alert_top_threats")
def _(spark, d):
    return summary.top_threats(_alerts(spark, d), 5)


@query("alert_worst_per_source")
def _(spark, d):
    return summary.worst_per_source(_alerts(spark, d))


@query("alert_best_findings")
def _(spark, d):
    return summary.best_finding_per_type(_alerts(spark, d))


@query("kpis")
def _(spark, d):
    return summary.kpis(events_flows(spark, d), _alerts(spark, d))


# -- traffic ---------------------------------------------------------------------------------

@query("traffic_summary")
def _(spark, d):
    return summary.traffic_summary(lineitem_flows(spark, d)).withColumn("mean_bytes", F.round("mean_bytes", 4))


@query("traffic_display")
def _(spark, d):
    return summary.traffic_display(events_flows(spark, d)).select("first_seen", "last_seen", "clock_span", "records")


@query("protocol_distribution")
def _(spark, d):
    return summary.protocol_distribution(events_flows(spark, d))


@query("protocol_pie")
def _(spark, d):
    return summary.protocol_pie(events_flows(spark, d), 3)


@query("talkers_by_packets")
def _(spark, d):
    return summary.talkers_by_packets(lineitem_flows(spark, d), 10)


@query("talkers_by_bytes")
def _(spark, d):
    return summary.talkers_by_bytes(events_flows(spark, d), 10)


@query("talkers_with_alerts")
def _(spark, d):
    return summary.talkers_with_alerts(events_flows(spark, d), _alerts(spark, d), 10)


@query("replay_totals")
def _(spark, d):
    return summary.replay_totals(events_flows(spark, d), _alerts(spark, d), 40)


# -- parsing ---------------------------------------------------------------------------------

def _native(spark, d) -> DataFrame:
    return validate.convert(inputs.raw_fields(inputs.events(spark, d)), PROFILES["default"])


def _flow_rows(converted: DataFrame) -> DataFrame:
    return validate.valid_rows(converted).drop("timestamp")


@query("parse_native")
def _(spark, d):
    return _flow_rows(_native(spark, d))


@query("parse_native_rejects")
def _(spark, d):
    return validate.rejected_rows(_native(spark, d))


@query("parse_reason_counts")
def _(spark, d):
    return validate.reason_counts(validate.rejected_rows(_native(spark, d)))


@query("parse_quality")
def _(spark, d):
    return validate.quality(_native(spark, d))


@query("parse_reject_sample")
def _(spark, d):
    return validate.reject_sample(validate.rejected_rows(_native(spark, d)), 100)


@query("parse_cicids")
def _(spark, d):
    return _flow_rows(validate.convert(inputs.raw_cicids(inputs.events(spark, d)), PROFILES["cicids"]))


@query("parse_unsw")
def _(spark, d):
    return _flow_rows(validate.convert(inputs.raw_unsw(inputs.events(spark, d)), PROFILES["unsw"]))


@query("parse_custom")
def _(spark, d):
    """A user mapping over a table with its own column names."""
    names = {"when": "timestamp", "from": "source_ip", "to": "destination_ip", "sp": "source_port",
             "dp": "destination_port", "proto": "protocol", "size": "packet_length"}
    profile = custom_profile(names, protocols=("TCP",))
    table = inputs.raw_fields(inputs.events(spark, d)).toDF("seq", *names)
    layout = resolve_layout([c for c in table.columns if c != "seq"], profile, logs._is_address)
    fields = [c for c in table.columns if c != "seq"]
    raw = table.select("seq", *[F.col(fields[layout.positions[c]]).alias(c) for c in FLOW_FIELDS])
    return _flow_rows(validate.convert(raw, profile))


def _parsed_lines(spark, d) -> logs.ParsedLog:
    layout = resolve_layout(NATIVE_HEADER, None, logs._is_address)
    return logs.parse_lines(inputs.log_lines(inputs.events(spark, d)), layout)


@query("parse_lines")
def _(spark, d):
    return _parsed_lines(spark, d).flows.drop("timestamp")


@query("parse_line_rejects")
def _(spark, d):
    return _parsed_lines(spark, d).rejects.select("seq", "reason")


@query("parse_line_quality")
def _(spark, d):
    return _parsed_lines(spark, d).quality


@query("log_file_scan")
def _(spark, d):
    """Write every event as CSV text files, then read them back through the log reader."""
    import uuid
    folder = f"{shared_dir(spark)}/log-files-{uuid.uuid4().hex}"
    header = ",".join(NATIVE_HEADER)
    rows = inputs.raw_fields(inputs.events(spark, d)).select(
        "seq", F.concat_ws(",", *FLOW_FIELDS).alias("value"))
    # Each file opens with the header: the least seq of its partition is preceded by it.
    lines = rows.sortWithinPartitions("seq").mapInArrow(_with_header(header), "value string")
    lines.write.text(folder)
    return validate.reason_counts(logs.read_logs(spark, folder, "auto").rejects)


def _mixed_log(spark: SparkSession, d: str) -> logs.ParsedLog:
    """A folder of files of four layouts, one of them unusable, written and read back."""
    import uuid
    folder = f"{shared_dir(spark)}/mixed-{uuid.uuid4().hex}"
    inputs.mixed_lines(inputs.events(spark, d)).repartition("file").sortWithinPartitions("file", "seq").select(
        "file", "value").write.partitionBy("file").text(folder)
    return logs.read_logs(spark, f"{folder}/file=*", "auto")


@query("parse_mixed_layouts")
def _(spark, d):
    """Flows of all usable files, each by its own layout, in one plan."""
    return _mixed_log(spark, d).flows.drop("timestamp", "seq")


@query("parse_mixed_rejects")
def _(spark, d):
    """Rejects by reason and text: damaged rows and, once for each, files without a layout."""
    return _mixed_log(spark, d).rejects.select("reason", "raw")


@query("parse_headerless")
def _(spark, d):
    """Lines of the layout without a header, detected by the first of them."""
    lines = inputs.headerless_lines(inputs.events(spark, d)).withColumn("source", F.lit("lines"))
    return logs.parse_lines(lines, logs.layout_of(lines)).flows.drop("timestamp")


@query("parse_offsets")
def _(spark, d):
    """Times with offsets become UTC."""
    return validate.valid_rows(validate.convert(inputs.offset_fields(inputs.events(spark, d)), PROFILES["default"])).select("seq", "ts_us")


def _with_header(header: str):
    def add(batches):
        import pyarrow as pa
        yield pa.record_batch([pa.array([header], pa.string())], names=["value"])
        for b in batches:
            yield pa.record_batch([b.column(1).cast(pa.string())], names=["value"])
    return add


@query("capture_flows")
def _(spark, d):
    flows, _ = capture.split_decoded(capture.decode_captures(inputs.event_captures(inputs.events(spark, d))))
    return flows.select("ts_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packet_length")


@query("capture_rejects")
def _(spark, d):
    _, rejects = capture.split_decoded(capture.decode_captures(inputs.event_captures(inputs.events(spark, d))))
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


# -- streams ---------------------------------------------------------------------------------

def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return events_to_flows(spark.readStream.schema(schema).parquet(f"{folder}/events.parque[t]"))


@query("stream_live_traffic")
def _(spark, d):
    """Daily counts per protocol kept by a streaming aggregation."""
    import uuid
    folder = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"

    def keep(counts: DataFrame, batch: int) -> None:
        """The counts that changed, stored by batch; a retry overwrites its own."""
        counts.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{folder}/counts/{batch}")
    counts = live.live_traffic(_event_stream(spark, d), "1 day", "1 hour")
    counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/query").trigger(
        availableNow=True).start().awaitTermination()
    stored = spark.read.parquet(f"{folder}/counts/*")
    return us_times(stored.groupBy("window_start", "protocol").agg(
        F.max_by("records", "batch").alias("records"), F.max_by("bytes", "batch").alias("bytes")))


@query("stream_port_scan_alerts")
def _(spark, d):
    """Port scans found by the incremental detector: the batch result."""
    import uuid
    state = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    found = StreamDetector(spark, state, EVENTS, delay_s=3600.0, names=["port_scan"], ml=False)
    found.start(_event_stream(spark, d), availableNow="true").awaitTermination()
    return plain_alerts(found.finish().rules)


# -- sinks -----------------------------------------------------------------------------------

def _written(spark: SparkSession, d: str, write) -> tuple[DataFrame, str]:
    import uuid
    alerts, folder = _alerts(spark, d), f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}"
    write(alerts, folder)
    return alerts, folder


@query("alerts_csv_sink")
def _(spark, d):
    """The flat view written as CSV files and read back."""
    alerts, folder = _written(spark, d, algebra.write_csv)
    return us_times(spark.read.option("header", True).option("escape", '"').schema(algebra.flat_view(alerts).schema).csv(folder))


@query("alerts_json_sink")
def _(spark, d):
    """Whole alerts written as JSON lines; the flat view of what is read back."""
    alerts, folder = _written(spark, d, algebra.write_json)
    return us_times(algebra.flat_view(spark.read.schema(alerts.schema).json(folder)))


@query("alerts_log_sink")
def _(spark, d):
    """Log lines written and read back, by severity and type as they stand in the text."""
    _, folder = _written(spark, d, algebra.write_log)
    fields = F.split(F.regexp_replace("value", r"^\[[^\]]*\] ", ""), r" \| ")
    return spark.read.text(folder).select(F.trim(fields[1]).alias("severity"), F.trim(fields[2]).alias("alert_type")).groupBy(
        "severity", "alert_type").agg(F.count(F.lit(1)).alias("alerts"))


SLICES, SLICE_FILES, SLICE_DELAY_S = 5, 2, 3600.0
LOG_FILES = 4


def _streamed(spark: SparkSession, d: str, names: tuple[str, ...], again: bool = False, feeds: DataFrame | None = None) -> StreamDetector:
    """The events as files of five consecutive time slices, one slice per micro-batch, through the
    incremental detector with a delay far below a slice.  ``again``: a sixth slice repeats every
    50th event of the first one, too late for the watermark."""
    import uuid
    folder = f"{shared_dir(spark)}/sliced-{uuid.uuid4().hex}"
    ev = spark.read.parquet(f"{d}/events.parquet")
    flows = events_to_flows(ev)
    low, high = flows.agg(F.min("ts_us"), F.max("ts_us")).first()
    width = (high - low) // SLICES
    for i in range(SLICES):                   # written one after the other: their files are in time order
        upto = F.lit(True) if i + 1 == SLICES else F.col("ts_us") < low + (i + 1) * width
        flows.where((F.col("ts_us") >= low + i * width) & upto).repartition(SLICE_FILES).write.mode("append").parquet(folder)
    if again:
        flows.where((F.col("ts_us") < low + width) & (F.col("seq") % 50 == 0)).repartition(SLICE_FILES).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(flows.schema).option("maxFilesPerTrigger", SLICE_FILES).parquet(folder)
    found = StreamDetector(spark, f"{folder}-state", EVENTS, delay_s=SLICE_DELAY_S, feeds=feeds, names=names, ml=False)
    found.start(stream, availableNow="true").awaitTermination()
    return found


@query("stream_rule_alerts")
def _(spark, d):
    """All six rules with feeds over five micro-batches: the batch result."""
    return plain_alerts(_streamed(spark, d, EVERY, feeds=_feed_entries(spark, d)).finish().rules)


@query("stream_late_rows")
def _(spark, d):
    return _streamed(spark, d, ("time_of_day",), again=True).late.read_all().select("seq", "ts_us", "src_ip", "dst_ip")


@query("stream_counters")
def _(spark, d):
    return _streamed(spark, d, ("time_of_day",), again=True).counters().select(F.col("batch").cast("bigint").alias("batch"), "rows", "late", "final_rows")


@query("stream_log_counts")
def _(spark, d):
    """The native log lines as four files, a micro-batch each, through the log stream: totals of each."""
    import uuid
    folder = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    lines = inputs.log_lines(inputs.events(spark, d))
    for i in range(LOG_FILES):                # written one after the other: their files are in time order
        lines.where(F.col("seq") % LOG_FILES == i).select("value").coalesce(1).write.mode("append").text(folder)
    found = StreamDetector(spark, f"{folder}-state", EVENTS, names=("time_of_day",), ml=False)
    log_stream.detect_logs(spark, f"{folder}/*.txt", resolve_layout(NATIVE_HEADER, None, lambda text: False), found).awaitTermination()
    return log_stream.log_counts(spark, found.folder).read_all(with_batch=True).select(F.col("batch").cast("bigint").alias("batch"), "total", "valid", "invalid")
