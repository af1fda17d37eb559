"""Inputs of the registered queries, derived by Spark from the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import Beaconing, BruteForce, DnsTunnel, Forest, OffHours, PortScan, Settings
from ..schema import FLOW_FIELDS, as_alerts
from ..sources.profiles import NATIVE_HEADER, UNSW_HEADERLESS

HOUR = 3600.0
DAY = 24 * HOUR

#: Thresholds at which the test tables, which are far sparser than traffic, show incidents.
EVENTS = Settings(
    port_scan=PortScan(72 * HOUR, 3, 5),
    brute_force=BruteForce(120 * HOUR, 1, 3, tuple(range(50))),
    dns=DnsTunnel(72 * HOUR, 2, 3, (10, 20, 30, 40, 50, 53)),
    beaconing=Beaconing(10, 155_000.0, 120_000.0, 20, 5.0, HOUR, DAY),
    off_hours=OffHours(6, 22, 25, 40),
    forest=Forest(window_s=HOUR),
)
LINEITEM = Settings(
    port_scan=PortScan(3 * DAY, 4, 6),
    brute_force=BruteForce(60 * DAY, 1, 3, ()),
)


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with ``k`` read from the properties."""
    return spark.read.parquet(f"{folder}/events.parquet").withColumn(
        "k", F.get_json_object("props", "$.k").cast("int"))


def raw_fields(ev: DataFrame) -> DataFrame:
    """Native-layout text fields of every event, some of them damaged in a known way."""
    i = F.col("event_id")
    k = F.col("k")
    return ev.select(
        i.alias("seq"),
        F.when(i % 29 == 0, "not-a-date").otherwise(
            F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("timestamp"),
        F.when(i % 19 == 0, "10.0.0.999").when(i % 31 == 0, F.concat(F.lit("2001:db8::"), F.lower(F.hex("user_id"))))
        .otherwise(F.concat(F.lit(" 10.0.0."), (F.col("user_id") % 256).cast("string"))).alias("src_ip"),
        F.lit("192.168.1.10").alias("dst_ip"),
        F.when(i % 23 == 0, F.concat(F.lit("0x"), F.lower(F.hex(k)))).otherwise(k.cast("string")).alias("src_port"),
        F.when(i % 17 == 0, "70000").otherwise((k * 3).cast("string")).alias("dst_port"),
        F.when(i % 37 == 0, "XYZ").when(i % 3 == 0, "udp").otherwise("TCP").alias("protocol"),
        F.when(i % 41 == 0, "-5").when(i % 43 == 0, "12.5").otherwise(
            (F.round(F.col("value") * 100).cast("bigint") + 1).cast("string")).alias("packet_length"))


def raw_cicids(ev: DataFrame) -> DataFrame:
    """Day-first dates to the minute, protocol numbers, unbounded lengths."""
    i = F.col("event_id")
    k = F.col("k")
    return ev.select(
        i.alias("seq"), F.date_format(F.col("ts").cast("timestamp"), "d/M/yyyy H:mm").alias("timestamp"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 256).cast("string")).alias("src_ip"),
        F.lit("192.168.1.10").alias("dst_ip"), k.cast("string").alias("src_port"),
        F.when(i % 7 == 0, F.concat(k.cast("string"), F.lit(".0"))).otherwise(k.cast("string")).alias("dst_port"),
        F.when(i % 5 == 0, "6").when(i % 5 == 1, "17.0").when(i % 5 == 2, "0").when(i % 5 == 3, "200")
        .otherwise("arp").alias("protocol"),
        (F.round(F.col("value") * 100).cast("bigint") * 1000).cast("string").alias("packet_length"))


def raw_unsw(ev: DataFrame) -> DataFrame:
    """Epoch seconds or milliseconds, missing and hexadecimal ports."""
    i = F.col("event_id")
    k = F.col("k")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return ev.select(
        i.alias("seq"),
        F.when(i % 2 == 0, seconds).otherwise(seconds * 1000).cast("string").alias("timestamp"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 256).cast("string")).alias("src_ip"),
        F.lit("192.168.1.10").alias("dst_ip"),
        F.when(i % 3 == 0, "-").when(i % 3 == 1, F.concat(F.lit("0x00"), F.hex(k))).otherwise(k.cast("string")).alias("src_port"),
        F.when(i % 11 == 0, "").otherwise(k.cast("string")).alias("dst_port"),
        F.when(i % 13 == 0, "bad name").otherwise("tcp").alias("protocol"),
        F.lit("0").alias("packet_length"))


def log_lines(ev: DataFrame) -> DataFrame:
    """Lines of a native CSV with blank, short and repeated-header lines in between."""
    i = F.col("event_id")
    f = raw_fields(ev)
    body = F.concat_ws(",", "timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packet_length")
    header = "Timestamp,Source IP,Destination IP,Source Port,Destination Port,Protocol,Packet Length"
    i = F.col("seq")
    return f.select(
        F.concat(F.lit("part-"), (i % 4).cast("string")).alias("source"), "seq",
        F.when(i % 101 < 4, header).when(i % 53 == 0, ",,,,,,").when(i % 59 == 0, "  ")
        .when(i % 61 == 0, F.concat(body, F.lit(",extra"))).when(i % 67 == 0, "1,2,3")
        .when(i % 71 == 0, F.concat(F.lit('"'), "timestamp", F.lit('", "'), "src_ip", F.lit('",'), "dst_ip",
                                    F.lit(","), "src_port", F.lit(","), "dst_port", F.lit(","), "protocol",
                                    F.lit(","), "packet_length"))
        .otherwise(body).alias("value"))


#: Events of one log file of the mixed folder.
FILE_EVENTS = 500
CICIDS_HEADER = ("Flow ID,Source IP,Source Port,Destination IP,Destination Port,Protocol,Timestamp,Flow Duration,"
                 "Total Length of Fwd Packets,Label")


def headerless_lines(ev: DataFrame) -> DataFrame:
    """``seq, value``: events as lines of the layout that has no header."""
    fields = {"srcip": "src_ip", "sport": "src_port", "dstip": "dst_ip", "dsport": "dst_port", "proto": "protocol",
              "sbytes": "packet_length", "Stime": "timestamp"}
    return raw_unsw(ev).select("seq", F.concat_ws(",", *[F.col(fields[c]) if c in fields else F.lit("0") for c in UNSW_HEADERLESS]).alias("value"))


def mixed_lines(ev: DataFrame) -> DataFrame:
    """``file, seq, value``: each file holds consecutive events in one of four layouts, the fourth unusable;
    a header has seq -1."""
    file = F.call_function("div", F.col("seq"), F.lit(FILE_EVENTS).cast("bigint"))
    native = raw_fields(ev).select("seq", F.concat_ws(",", *FLOW_FIELDS).alias("value"))
    cicids = raw_cicids(ev).select("seq", F.concat_ws(
        ",", F.lit("f"), "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "timestamp", F.lit("1"), "packet_length", F.lit("x")).alias("value"))
    junk = ev.select(F.col("event_id").alias("seq"), F.format_string("%d,%d", "event_id", "k").alias("value"))
    heads = (",".join(NATIVE_HEADER), CICIDS_HEADER, None, "what,is")
    parts = [rows.withColumn("file", file).where(F.col("file") % len(heads) == kind)
             for kind, rows in enumerate((native, cicids, headerless_lines(ev), junk))]
    opened = [rows.select("file").distinct().select(F.lit(-1).cast("bigint").alias("seq"), F.lit(head).alias("value"), "file")
              for rows, head in zip(parts, heads) if head]
    return reduce(DataFrame.unionByName, [*parts, *opened])


def offset_fields(ev: DataFrame) -> DataFrame:
    """Native fields whose times carry offsets, in four spellings."""
    at = F.col("ts").cast("timestamp")
    kind = F.col("event_id") % 4
    shown = F.when(kind == 0, F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0200"))).when(
        kind == 1, F.concat(F.date_format(at, "yyyy/MM/dd HH:mm:ss"), F.lit(" -05:30"))).when(
        kind == 2, F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))).otherwise(
        F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
    return ev.select(F.col("event_id").alias("seq"), shown.alias("timestamp"), F.lit("10.0.0.1").alias("src_ip"), F.lit("10.0.0.2").alias("dst_ip"),
                     F.lit("1").alias("src_port"), F.lit("2").alias("dst_port"), F.lit("tcp").alias("protocol"), F.lit("3").alias("packet_length"))


def supplier_feed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Two blocklists' text lines made from suppliers: hosts, networks, notes, comments, junk."""
    s = F.col("s_suppkey")
    net = F.concat(F.lit("10.0.0."), (s % 256).cast("string"))
    return spark.read.parquet(f"{folder}/supplier.parquet").select(
        F.concat(F.lit("feed_"), (s % 2).cast("string")).alias("source"), (s % 2).cast("int").alias("feed_ord"),
        s.alias("ord"),
        F.when(s % 11 == 0, "# comment").when(s % 13 == 0, "; note").when(s % 17 == 0, "   ")
        .when(s % 19 == 0, "not-an-ip").when(s % 23 == 0, "0.0.0.0/0")
        .when(s % 5 == 0, F.concat(net, F.lit("/"), (F.lit(28) + F.col("s_nationkey") % 4).cast("string"), F.lit(" # net")))
        .when(s % 7 == 0, F.concat(net, F.lit(",extra,words")))
        .otherwise(F.concat(F.lit("  "), net)).alias("value"))


def event_alerts(ev: DataFrame) -> DataFrame:
    """An alert table with one alert per event, for the alert algebra: type by event kind, a seen
    range of ``value`` minutes, three severities."""
    kinds = {"click": "PORT_SCAN", "view": "BRUTE_FORCE", "error": "BLACKLISTED_IP", "signup": "DNS_TUNNELING",
             "purchase": "ML_ANOMALY"}
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    k = F.col("k")
    kind: Column = F.lit(None).cast("string")
    for event, alert in kinds.items():
        kind = F.when(F.col("event_type") == event, alert).otherwise(kind)
    src = F.concat(F.lit("10.0.0."), (F.col("user_id") % 256).cast("string"))
    dst = F.concat(F.lit("host-"), (k % 3).cast("string"))
    return as_alerts(ev.select(
        kind.alias("alert_type"),
        F.when(k % 7 == 0, "HIGH").when(k % 2 == 0, "MEDIUM").otherwise("LOW").alias("severity"),
        src.alias("source_ip"), dst.alias("dest_ip"),
        F.format_string("%s seen %d times", "event_type", k).alias("description"),
        at.alias("first_us"), (at + F.round(F.col("value") * 60).cast("bigint") * 1_000_000).alias("last_us"),
        F.to_json(F.struct(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first_seen"),
                           k.alias("hits"), F.col("event_id").alias("id"))).alias("details"),
        F.array(src, dst).alias("key_parts")))


def event_captures(ev: DataFrame) -> DataFrame:
    """``path, content``: pcap files whose packets carry the events (1,000 per file), as raw IPv4
    TCP, UDP or ICMP; every 50th packet is an unsupported protocol.  A source is 10.0.0.0 plus the
    low 24 bits of the user's number."""
    def hex_of(x: Column, digits: int) -> Column:
        return F.lpad(F.hex(x.cast("bigint")), digits, "0")

    at = F.unix_micros(F.col("ts").cast("timestamp"))
    k = F.col("k").cast("bigint")
    i = F.col("event_id")
    proto = F.when(i % 50 == 0, 47).when(i % 3 == 0, 17).when(i % 3 == 1, 6).otherwise(1)
    size = F.lit(40) + k
    ip = F.concat(F.lit("4500"), hex_of(size, 4), F.lit("0000000040"), hex_of(proto, 2), F.lit("0000"),
                  F.lit("0A"), hex_of(F.col("user_id") % (1 << 24), 6), F.lit("C0A8010A"))
    payload = F.concat(hex_of(F.lit(49152) + i % 16384, 4), hex_of(k, 4), F.lit("0" * 32))
    head = F.concat(hex_of(F.call_function("div", at, F.lit(1_000_000).cast("bigint")), 8), hex_of(at % 1_000_000, 8),
                    F.lit("0000002800000028"))
    packets = ev.select(F.call_function("div", i, F.lit(1000).cast("bigint")).alias("file"), i.alias("i"),
                        F.concat(head, ip, payload).alias("hex"))
    start = "A1B2C3D4" + "00020004" + "00000000" * 2 + "0000FFFF" + "00000065"
    files = packets.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("i", "hex"))).alias("p"))
    return files.select(
        F.concat(F.lit("capture-"), F.lpad(F.col("file").cast("string"), 9, "0"), F.lit(".pcap")).alias("path"),
        F.unhex(F.concat(F.lit(start), F.array_join("p.hex", ""))).alias("content"))
