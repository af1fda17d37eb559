"""Alert algebra: union, corroboration, duplicate merging, filters, counts, sinks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DEFAULT, Settings, us
from ..functions.text import seen_text
from ..operators.tiles import clusters
from ..schema import ALERT, ALERT_LABEL, SEVERITY_RANK, WHOLE_CAPTURE_TYPES, literal_map
from ..session import stored



def union_alerts(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def in_time_order(alerts: DataFrame) -> DataFrame:
    """By event time, most severe first; the rest only makes the order total."""
    return alerts.orderBy(F.asc("timestamp"), F.desc("severity_rank"), F.asc("alert_key"))


def by_severity(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(F.desc("severity_rank"), F.asc("timestamp"), F.asc("alert_key"))


def recent(alerts: DataFrame, n: int) -> DataFrame:
    return alerts.orderBy(F.desc("timestamp"), F.desc("severity_rank"), F.asc("alert_key")).limit(n)


def with_member(details: Column, member: Column) -> Column:
    """A JSON object (possibly empty) with one more member at its end."""
    body = F.rtrim(F.substring(details, F.lit(1), F.length(details) - 1))
    return F.concat(body, F.when(body == "{", "").otherwise(","), member, F.lit("}"))


def corroborate(ml: DataFrame, rules: DataFrame) -> DataFrame:
    """Mark ML alerts whose source a rule caught as well."""
    types = rules.groupBy("source_ip").agg(
        F.sort_array(F.collect_set("alert_type")).alias("_types"))       # at most 7 values
    joined = ml.join(types, "source_ip", "left")
    hit = F.col("_types").isNotNull()
    shown = F.concat(F.col("description"), F.lit(" [corroborates "), F.array_join("_types", ", "), F.lit("]"))
    extended = with_member(F.col("details"), F.concat(F.lit('"corroborated_by":'), F.to_json("_types")))
    return joined.withColumn("description", F.when(hit, shown).otherwise(F.col("description"))).withColumn(
        "details", F.when(hit, extended).otherwise(F.col("details"))).select(*[f.name for f in ALERT.fields])


def merge_duplicates(alerts: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """One alert per incident when overlapping batches reported it more than once.

    Alerts of one ``alert_key`` merge when their seen ranges touch within the rule's window, or
    always for the whole-capture types.  The most severe one (then most detailed, then earliest)
    is kept, with the earliest time, the widest range and ``merged_alerts``.
    """
    gaps = {"PORT_SCAN": us(s.port_scan.window_s), "BRUTE_FORCE": us(s.brute_force.window_s),
            "DNS_TUNNELING": us(s.dns.window_s)}
    columns = [f.name for f in ALERT.fields]
    best = F.struct("severity_rank", F.length("details").alias("_detail"),
                    (-F.unix_micros("timestamp")).alias("_early"), F.struct(*columns).alias("alert"))
    rows = stored(alerts.select("alert_type", "alert_key", best.alias("best"),
                                F.unix_micros("timestamp").alias("at_us"),
                                F.unix_micros(F.coalesce("first_seen", "timestamp")).alias("start_us"),
                                F.unix_micros(F.coalesce("last_seen", "timestamp")).alias("end_us"),
                                F.monotonically_increasing_id().alias("id")), "alerts")
    # Only keys and times are sorted into clusters; the alerts join their cluster afterwards.
    gap = F.coalesce(F.try_element_at(literal_map(gaps), F.col("alert_type")), F.lit(0))
    timed = rows.where(~F.col("alert_type").isin(*WHOLE_CAPTURE_TYPES)).select("alert_key", gap.alias("gap_us"), "start_us", "end_us", "id")
    numbered = clusters(timed, ["alert_key", "gap_us"], "start_us", "end_us", F.col("gap_us")).select("id", "gap_us", "cluster")
    merged = rows.join(numbered, "id", "left").groupBy("alert_key", "gap_us", "cluster").agg(
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.max("best").alias("best"), F.min("at_us").alias("at_us"),
        F.count(F.lit(1)).alias("merged"))

    first, last = F.timestamp_micros("start_us"), F.timestamp_micros("end_us")
    several = F.col("merged") > 1
    details = F.regexp_replace(F.col("best.alert.details"), F.lit('"first_seen":"[^"]*"'),
                               F.concat(F.lit('"first_seen":"'), seen_text(F.col("start_us")), F.lit('"')))
    details = F.regexp_replace(details, F.lit('"last_seen":"[^"]*"'),
                               F.concat(F.lit('"last_seen":"'), seen_text(F.col("end_us")), F.lit('"')))
    details = with_member(details, F.format_string('"merged_alerts":%d', "merged"))
    changed = {"timestamp": F.timestamp_micros("at_us"), "first_seen": first, "last_seen": last, "details": details}
    return merged.select(*[
        (F.when(several, changed[c]).otherwise(F.col(f"best.alert.{c}")) if c in changed
         else F.col(f"best.alert.{c}")).alias(c) for c in columns], "merged")


# -- filters ---------------------------------------------------------------------------------

def select_alerts(alerts: DataFrame, severity: str | None = None, alert_type: str | None = None,
                  min_severity: str | None = None) -> DataFrame:
    """Alerts meeting every given criterion."""
    if severity is not None:
        alerts = alerts.where(F.col("severity") == severity)
    if alert_type is not None:
        alerts = alerts.where(F.col("alert_type") == alert_type)
    if min_severity is not None:
        alerts = alerts.where(F.col("severity_rank") >= SEVERITY_RANK[min_severity])
    return alerts


def search_alerts(alerts: DataFrame, severities: Sequence[str] | None = None, labels: Sequence[str] | None = None,
                  low: Column | None = None, high: Column | None = None, text: str = "") -> DataFrame:
    """Interactive filter: severities, type labels, ``[low, high + 1 s)``, and a literal,
    case-insensitive text looked for in five columns."""
    if severities is not None:
        alerts = alerts.where(F.col("severity").isin(*severities))
    if labels is not None:
        alerts = alerts.where(F.col("label").isin(*labels))
    if low is not None:
        alerts = alerts.where(F.col("timestamp") >= low)
    if high is not None:
        alerts = alerts.where(F.col("timestamp") < high + F.expr("interval 1 second"))
    needle = text.strip().lower()
    if needle:
        found = [F.contains(F.lower(F.col(c)), F.lit(needle))
                 for c in ("source_ip", "dest_ip", "label", "alert_type", "description")]
        alerts = alerts.where(reduce(Column.__or__, found))
    return alerts


def flat_view(alerts: DataFrame) -> DataFrame:
    """The eight display columns."""
    return alerts.select(F.col("timestamp").alias("time"), "severity", F.col("label").alias("type"),
                         F.col("alert_type").alias("code"), "method", "source_ip",
                         F.col("dest_ip").alias("destination"), "description")


# -- counts ----------------------------------------------------------------------------------

def _zero_filled(alerts: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    every = alerts.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    counts = alerts.where(F.col(column).isin(*values)).groupBy(column).agg(F.count(F.lit(1)).alias("alerts"))
    return every.join(F.broadcast(counts), column, "left").select(      # at most one row per listed value
        column, F.coalesce("alerts", F.lit(0)).alias("alerts"))


def count_by_severity(alerts: DataFrame) -> DataFrame:
    return _zero_filled(alerts, "severity", list(SEVERITY_RANK))


def count_by_type(alerts: DataFrame) -> DataFrame:
    """Every known type, with 0 where there is none, and every other type that occurs."""
    others = alerts.where(~F.col("alert_type").isin(*ALERT_LABEL)).groupBy("alert_type").agg(F.count(F.lit(1)).alias("alerts"))
    return _zero_filled(alerts, "alert_type", list(ALERT_LABEL)).unionByName(others)


# -- text and sinks --------------------------------------------------------------------------

def log_lines(alerts: DataFrame) -> DataFrame:
    """``value``: one pipe-delimited line per alert."""
    return alerts.select(F.concat_ws(
        " | ", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSS"), F.rpad("severity", 6, " "),
        F.when(F.length("alert_type") < 14, F.rpad("alert_type", 14, " ")).otherwise(F.col("alert_type")),
        F.concat("source_ip", F.lit(" -> "), "dest_ip"), "description", "details").alias("value"))


def alert_json(alerts: DataFrame) -> DataFrame:
    """``value``: each alert as a JSON object."""
    return alerts.select(F.to_json(F.struct(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "alert_type", "severity",
        "source_ip", "dest_ip", "description", "details")).alias("value"))


def write_log(alerts: DataFrame, path: str, append: bool = False) -> None:
    """Log lines prefixed with the detection time, in time order across the part files."""
    stamped = log_lines(in_time_order(alerts)).select(F.concat(
        F.lit("["), F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"), F.lit("] "), "value").alias("value"))
    stamped.write.mode("append" if append else "overwrite").text(path)


#: Files keep the microseconds of a time.
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def write_json(alerts: DataFrame, path: str) -> None:
    in_time_order(alerts).withColumn("detected_at", F.current_timestamp()).write.mode("overwrite").option(
        "timestampFormat", TIME_FORMAT).json(path)


def write_csv(alerts: DataFrame, path: str) -> None:
    flat_view(in_time_order(alerts)).write.mode("overwrite").option("header", True).option("escape", '"').option(
        "timestampFormat", TIME_FORMAT).csv(path)
