"""Adapters from general event/order tables to the flow schema.

They are projections only, so column pruning and pushed filters reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def as_flows(df: DataFrame, *, seq: Column, ts: Column, src: Column, dst: Column,
             sport: Column, dport: Column, protocol: Column, length: Column) -> DataFrame:
    stamp = ts.cast("timestamp")      # Parquet may hand us TIMESTAMP_NTZ; watermarks need TIMESTAMP
    return df.select(
        seq.cast("bigint").alias("seq"),
        stamp.alias("timestamp"),
        F.unix_micros(stamp).alias("ts_us"),
        src.alias("src_ip"),
        dst.alias("dst_ip"),
        sport.cast("int").alias("src_port"),
        dport.cast("int").alias("dst_port"),
        protocol.alias("protocol"),
        length.cast("bigint").alias("packet_length"),
    )


DST_BY_EVENT = {
    "click": "192.168.1.10",
    "view": "192.168.1.20",
    "error": "192.0.2.66",
    "signup": "198.51.100.130",
    "purchase": "93.184.216.34",
}


def events_to_flows(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    dst = F.lit(None).cast("string")
    for kind, host in DST_BY_EVENT.items():
        dst = F.when(F.col("event_type") == kind, host).otherwise(dst)
    return as_flows(
        events,
        seq=F.col("event_id"),
        ts=F.col("ts"),
        src=F.concat(F.lit("10.0."), F.expr("cast(user_id div 256 as string)"), F.lit("."),
                     (F.col("user_id") % 256).cast("string")),
        dst=dst,
        sport=F.lit(49152) + F.col("event_id") % 16384,
        dport=k,
        protocol=F.when(k % 10 < 7, "TCP").when(k % 10 < 9, "UDP").otherwise("ICMP"),
        length=F.round(F.col("value") * 100),
    )


def lineitem_to_flows(lineitem: DataFrame) -> DataFrame:
    return as_flows(
        lineitem,
        seq=F.col("l_orderkey") * 8 + F.col("l_linenumber"),
        ts=F.col("l_shipdate"),
        src=F.concat(F.lit("10.1.0."), F.col("l_suppkey").cast("string")),
        dst=F.concat(F.lit("192.168.2."), (F.col("l_partkey") % 4).cast("string")),
        sport=F.lit(40000) + F.col("l_linenumber"),
        dport=F.col("l_partkey") % 1024,
        protocol=F.lit("TCP"),
        length=F.round(F.col("l_extendedprice")),
    )


def events_flows(spark: SparkSession, folder: str) -> DataFrame:
    return events_to_flows(spark.read.parquet(f"{folder}/events.parquet"))


def lineitem_flows(spark: SparkSession, folder: str) -> DataFrame:
    return lineitem_to_flows(spark.read.parquet(f"{folder}/lineitem.parquet"))
