"""Alert algebra, summaries and sinks."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from samples import BASE_US, benign, scan
from flowspark.plans import alerts as algebra, summary
from flowspark.plans.port_scan import port_scan_alerts
from flowspark.schema import as_alerts


def make(spark, rows):
    """(type, severity, source, dest, first s, last s)"""
    df = spark.createDataFrame([(t, s, a, b, BASE_US + int(x * 1e6), BASE_US + int(y * 1e6)) for t, s, a, b, x, y in rows],
                               "alert_type string, severity string, source_ip string, dest_ip string, first_us long, last_us long")
    return as_alerts(df.withColumn("description", F.lit("found")).withColumn(
        "details", F.lit('{"first_seen":"x","last_seen":"y"}')).withColumn("key_parts", F.array("source_ip", "dest_ip")))


SOME = [("PORT_SCAN", "MEDIUM", "a", "b", 0, 3), ("PORT_SCAN", "HIGH", "a", "b", 2, 6), ("PORT_SCAN", "MEDIUM", "a", "b", 600, 602),
        ("BEACONING", "LOW", "c", "d", 0, 1), ("BEACONING", "MEDIUM", "c", "d", 9000, 9001), ("ML_ANOMALY", "LOW", "e", "f", 5, 5)]


def test_duplicates_merge_by_time_or_always(spark):
    merged = algebra.merge_duplicates(make(spark, SOME)).orderBy("alert_key", "timestamp").collect()
    assert [(r.alert_type, r.severity, r.merged) for r in merged] == [
        ("BEACONING", "MEDIUM", 2), ("ML_ANOMALY", "LOW", 1), ("PORT_SCAN", "HIGH", 2), ("PORT_SCAN", "MEDIUM", 1)]
    assert json.loads(merged[2].details) == {"first_seen": "2026-10-05 08:00:00", "last_seen": "2026-10-05 08:00:06", "merged_alerts": 2}


def test_counts_include_zeros(spark):
    alerts = make(spark, SOME)
    assert {r.severity: r.alerts for r in algebra.count_by_severity(alerts).collect()} == {"LOW": 2, "MEDIUM": 3, "HIGH": 1}
    by_type = {r.alert_type: r.alerts for r in algebra.count_by_type(alerts).collect()}
    assert len(by_type) == 8 and by_type["DNS_TUNNELING"] == 0 and by_type["PORT_SCAN"] == 3


def test_filters(spark):
    alerts = make(spark, SOME)
    assert algebra.select_alerts(alerts, severity="LOW").count() == 2
    assert algebra.select_alerts(alerts, alert_type="PORT_SCAN", min_severity="HIGH").count() == 1
    assert algebra.search_alerts(alerts, text=" BEACON ").count() == 2
    assert algebra.search_alerts(alerts, text=".*").count() == 0
    assert [r.severity for r in algebra.recent(alerts, 2).collect()] == ["MEDIUM", "MEDIUM"]


def test_sinks(spark, flows, folder):
    alerts = port_scan_alerts(flows(benign(), scan(60, 4), scan(15, 4, 300)))
    algebra.write_log(alerts, f"{folder}/log")
    algebra.write_log(alerts, f"{folder}/log", append=True)
    lines = [r.value for r in spark.read.text(f"{folder}/log").collect()]
    assert len(lines) == 4 and all("| PORT_SCAN      | 203.0.113.9 -> 192.168.1.200 |" in v and v.startswith("[") for v in lines)
    algebra.write_json(alerts, f"{folder}/json")
    assert {r.severity for r in spark.read.json(f"{folder}/json").collect()} == {"HIGH", "MEDIUM"}
    algebra.write_csv(alerts, f"{folder}/csv")
    assert spark.read.csv(f"{folder}/csv", header=True).count() == 2


def test_report_tables(spark, flows):
    rows = flows(benign())
    tables = {k: v.collect() for k, v in summary.report_tables(rows, make(spark, SOME)).items()}
    assert tables["summary"][0]["records"] == 200 and tables["kpis"][0]["flagged_sources"] == 3
    assert [r.severity for r in tables["alerts"]] == ["HIGH", "MEDIUM", "MEDIUM", "MEDIUM", "LOW", "LOW"]
    assert sum(r.alerts for r in tables["timeline"]) == 6 and max(r.bucket for r in tables["timeline"]) == 11
    empty = summary.report_tables(rows.limit(0), make(spark, SOME).limit(0))
    assert empty["summary"].first()["records"] == 0 and empty["timeline"].count() == 0 and empty["alerts"].count() == 0


def test_members_of_json_details(spark):
    rows = spark.createDataFrame([('{}',), ('{"a":1}',), ('{"a":{"b":"}"}}',)], "details string")
    got = [r[0] for r in rows.select(algebra.with_member(F.col("details"), F.lit('"n":2'))).collect()]
    assert got == ['{"n":2}', '{"a":1,"n":2}', '{"a":{"b":"}"},"n":2}']


def test_plug_in_types_are_counted_and_labelled(spark):
    from flowspark.plans import engine
    from flowspark.schema import as_alerts
    rows = spark.createDataFrame([("MINE", "LOW", "a", "b", "d", 1, 2, "{}", ["k"])], "alert_type string, severity string, source_ip string, "
                                 "dest_ip string, description string, first_us bigint, last_us bigint, details string, key_parts array<string>")
    alerts = as_alerts(rows)
    assert alerts.first()["label"] == "MINE"
    counts = {r["alert_type"]: r["alerts"] for r in algebra.count_by_type(alerts).collect()}
    assert counts["MINE"] == 1 and counts["PORT_SCAN"] == 0
    with pytest.raises(ValueError, match="no such detector: prot_scan"):
        engine.rule_alerts(spark.createDataFrame([], "seq long"), names=["port_scan", "prot_scan"])
