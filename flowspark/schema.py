"""Row types: flows, rejected rows, alerts; and the fixed alert vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

FLOW_FIELDS = ("timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packet_length")

FLOW = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("ts_us", T.LongType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("packet_length", T.LongType()),
])

REJECT = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("reason", T.StringType()),
    T.StructField("raw", T.StringType()),
])

ALERT = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("alert_type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("severity_rank", T.IntegerType()),
    T.StructField("method", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("source_ip", T.StringType()),
    T.StructField("dest_ip", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("first_seen", T.TimestampType()),
    T.StructField("last_seen", T.TimestampType()),
    T.StructField("details", T.StringType()),
    T.StructField("alert_key", T.StringType()),
])

# Severity ranks and alert types with their display labels.
SEVERITY_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}
ALERT_LABEL = {
    "PORT_SCAN": "Port scan",
    "BRUTE_FORCE": "Brute force",
    "BLACKLISTED_IP": "Blacklisted IP",
    "ML_ANOMALY": "ML anomaly",
    "DNS_TUNNELING": "DNS tunneling",
    "BEACONING": "C2 beaconing",
    "TIME_OF_DAY_ANOMALY": "Off-hours activity",
    "THREAT_INTEL_HIT": "Threat intel hit",
}
# Types that summarise a whole capture: their duplicates merge whatever the time.
WHOLE_CAPTURE_TYPES = ("BLACKLISTED_IP", "THREAT_INTEL_HIT", "ML_ANOMALY", "BEACONING",
                       "TIME_OF_DAY_ANOMALY")


def literal_map(mapping: dict) -> Column:
    """A small constant map as a column."""
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def severity_rank(severity: Column) -> Column:
    return F.try_element_at(literal_map(SEVERITY_RANK), severity)


def as_alerts(df: DataFrame) -> DataFrame:
    """Complete a detector's typed columns to the common alert row.

    Expects ``alert_type, severity, source_ip, dest_ip, description, first_us, last_us,
    details`` (JSON text) and ``key_parts`` (array naming the incident's identity).
    """
    return df.select(
        F.timestamp_micros("first_us").alias("timestamp"),
        "alert_type",
        "severity",
        severity_rank(F.col("severity")).alias("severity_rank"),
        F.when(F.col("alert_type") == "ML_ANOMALY", "ML").otherwise("Rule").alias("method"),
        F.coalesce(F.try_element_at(literal_map(ALERT_LABEL), F.col("alert_type")), F.col("alert_type")).alias("label"),
        "source_ip",
        "dest_ip",
        "description",
        F.timestamp_micros("first_us").alias("first_seen"),
        F.timestamp_micros("last_us").alias("last_seen"),
        "details",
        F.array_join(F.concat(F.array("alert_type"), F.col("key_parts")), "|").alias("alert_key"),
    )
