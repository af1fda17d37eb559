"""Each detector around its thresholds."""

from __future__ import annotations

import json
from dataclasses import replace

import pytest

from samples import beacon, benign, burst, dns, flow, kinds, night, scan
from flowspark.config import DEFAULT, Forest, OffHours
from flowspark.plans import engine, forest
from flowspark.plans.beaconing import beacon_alerts
from flowspark.plans.blocklist import blocklist_alerts
from flowspark.plans.brute_force import brute_force_alerts
from flowspark.plans.dns_tunnel import dns_alerts
from flowspark.plans.off_hours import off_hours_alerts
from flowspark.plans.port_scan import port_scan_alerts


def severities(alerts):
    return [r.severity for r in alerts.collect()]


@pytest.mark.parametrize("ports, span, want", [(10, 4, []), (15, 4, ["MEDIUM"]), (60, 4, ["HIGH"]), (15, 120, [])])
def test_port_scan(flows, ports, span, want):
    assert severities(port_scan_alerts(flows(benign(), scan(ports, span)))) == want


@pytest.mark.parametrize("n, port, want", [(20, 22, []), (25, 22, ["MEDIUM"]), (45, 22, ["HIGH"]), (45, 8081, [])])
def test_brute_force(flows, n, port, want):
    assert severities(brute_force_alerts(flows(benign(), burst(n, port)))) == want


@pytest.mark.parametrize("n, span, want", [(40, 30, []), (60, 30, ["MEDIUM"]), (130, 55, ["HIGH"]), (120, 600, [])])
def test_dns(flows, n, span, want):
    assert severities(dns_alerts(flows(dns(n, span)))) == want


def test_beacons(flows):
    assert severities(beacon_alerts(flows(benign(), beacon(40, 30, 0.1)))) == ["HIGH"]
    assert severities(beacon_alerts(flows(beacon(15, 60)))) == ["MEDIUM"]
    irregular = [flow(t * t % 977 + t * 40, "10.0.0.77", "203.0.113.150") for t in range(40)]
    assert severities(beacon_alerts(flows(irregular, burst(200)))) == []


def test_beacon_packets_of_a_session_count_once(flows):
    doubled = [flow(30 * i + d, "10.0.0.77", "203.0.113.150") for i in range(40) for d in (0.0, 0.3, 0.6)]
    one = beacon_alerts(flows(doubled)).first()
    details = json.loads(one["details"])
    assert details["connections"] == 40 and details["mean_interval_seconds"] == 30.0
    assert details["std_interval_seconds"] == 0.0


@pytest.mark.parametrize("n, shift, want", [(100, -5, []), (150, -5, ["MEDIUM"]), (600, -6, ["HIGH"]), (150, 2, [])])
def test_off_hours(flows, n, shift, want):
    assert severities(off_hours_alerts(flows(night(n, shift)))) == want


def test_off_hours_past_midnight(flows):
    s = replace(DEFAULT, off_hours=OffHours(20, 4))
    assert severities(off_hours_alerts(flows(night(150, 2)), s)) == ["MEDIUM"]
    assert severities(off_hours_alerts(flows(night(150, -6)), s)) == []


def test_blocklist_directions_and_feeds(spark, flows):
    rows = [flow(0, "10.0.0.5", "192.0.2.66"), flow(1, "198.51.100.130", "10.0.0.6"), flow(2, "10.0.0.7", "45.9.9.9"),
            flow(3, "100.64.0.9", "10.0.0.8"), flow(4, "2001:DB8::1", "10.0.0.9"), flow(5, "192.0.2.99", "192.0.2.66")]
    feeds = spark.createDataFrame(
        [("45.9.9.9", "hosts", 0), ("100.64.0.0/24", "nets", 1), ("nonsense", "x", 2), ("192.0.2.66", "x", 3),
         ("2001:db8::/32", "six", 4)], "entry string, source string, ord bigint")
    got = kinds(blocklist_alerts(flows(benign(), rows), feeds=feeds))
    assert got == [
        ("BLACKLISTED_IP", "HIGH", "2 hosts", "192.0.2.66"),
        ("BLACKLISTED_IP", "MEDIUM", "198.51.100.130", "10.0.0.6"),
        ("THREAT_INTEL_HIT", "HIGH", "10.0.0.7", "45.9.9.9"),
        ("THREAT_INTEL_HIT", "MEDIUM", "100.64.0.9", "10.0.0.8"),
        ("THREAT_INTEL_HIT", "MEDIUM", "2001:DB8::1", "10.0.0.9"),
    ]


SMALL = replace(DEFAULT, forest=Forest(trees=60))


def test_forest_flags_jumbo_rows(flows):
    jumbo = [flow(100 + i * 60, "10.0.0.250", "192.168.1.9", size=64_000) for i in range(5)]
    alerts, scored, _ = forest.detect_anomalies(flows(benign(), jumbo), SMALL)
    assert ("10.0.0.250", "192.168.1.9") in {(r.source_ip, r.dest_ip) for r in alerts.collect()}
    assert scored.where("is_anomaly").count() < 15


def test_forest_samples_are_whole_and_repeatable(flows):
    p = Forest(trees=7, max_samples=64)
    features = forest.flow_features(flows(benign(400)), SMALL)
    draw = [sorted((r.tree, r.seq) for r in forest.draw_samples(features, p, 400).collect()) for _ in range(2)]
    assert draw[0] == draw[1] and len(draw[0]) == len(set(draw[0])) == 7 * 64


def test_too_few_rows_warn(flows):
    result = engine.detect(flows(benign(30)), SMALL, names=["dns"])
    assert result.ml is None and "at least 50" in result.warnings[0]


def test_engine_merges_orders_and_corroborates(flows):
    rows = flows(benign(), scan(60, 4, start=50), [flow(60 + i, "203.0.113.9", "192.168.1.200", size=64_000) for i in range(4)])
    result = engine.detect(rows, SMALL, names=["port_scan", "blocklist"])
    got = result.alerts.collect()
    assert [(r.timestamp, -r.severity_rank) for r in got] == sorted((r.timestamp, -r.severity_rank) for r in got)
    ml = [r for r in got if r.alert_type == "ML_ANOMALY" and r.source_ip == "203.0.113.9"]
    assert ml and ml[0].description.endswith("[corroborates PORT_SCAN]")
    assert json.loads(ml[0].details)["corroborated_by"] == ["PORT_SCAN"]


def test_registered_detector_runs_by_name(flows):
    engine.register("mine", lambda df, s: port_scan_alerts(df, s))
    try:
        assert len(kinds(engine.rule_alerts(flows(scan(15, 4)), names=["mine"]))) == 1
    finally:
        engine.DETECTORS.pop("mine")
    with pytest.raises(ValueError):
        engine.rule_alerts(flows(scan(15, 4)), names=["unknown"])


def test_features_rank_ties_by_row(flows):
    """Rows of one instant count those before them, even across ranking blocks."""
    rows = flows([flow(0, size=10)] * 5 + [flow(9, size=1)] + [flow(10.5, size=2)] * 2)
    s = replace(DEFAULT, seq_block=2)
    got = [(r.src_conn_freq, r.src_bytes_window, r.pair_conn_freq)
           for r in forest.flow_features(rows, s).orderBy("seq").collect()]
    assert got == [(1, 10, 1), (2, 20, 2), (3, 30, 3), (4, 40, 4), (5, 50, 5), (6, 51, 6), (2, 3, 2), (3, 5, 3)]
