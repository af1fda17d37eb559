"""Logs, feeds and captures from files."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from flowspark.operators import containment
from flowspark.operators.validate import reason_counts
from flowspark.plans.port_scan import port_scan_alerts
from flowspark.sources import capture, feeds, logs
from flowspark.sources.profiles import NATIVE_HEADER, UNSW_HEADERLESS, LogFormatError, custom_profile, resolve_profile

HEADER = ",".join(NATIVE_HEADER)
GOOD = "2026-10-05 08:00:0{i}.000000,10.0.0.{i},192.168.1.1,5000{i},443,tcp,500"


def write(folder, name, lines, encoding="utf-8"):
    path = f"{folder}/{name}"
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write("\n".join(lines))
    return path


def test_malformed_rows_are_quarantined(spark, folder):
    bad = ["never,10.0.0.1,192.168.1.1,1,2,TCP,5", "2026-10-05 08:00:00,10.0.0.999,192.168.1.1,1,2,TCP,5",
           "2026-10-05 08:00:00,10.0.0.1,192.168.1.1,70000,2,TCP,5", "2026-10-05 08:00:00,10.0.0.1,192.168.1.1,1,2,XYZ,5",
           "2026-10-05 08:00:00,10.0.0.1,192.168.1.1,1,2,TCP,-5", "2026-10-05 08:00:00,10.0.0.1"]
    path = write(folder, "a.csv", [HEADER, *[GOOD.format(i=i) for i in range(5)], *bad, "", ",,,,,,", HEADER, "   "])
    log = logs.read_logs(spark, path)
    assert log.flows.count() == 5 and log.flows.first()["protocol"] == "TCP"
    assert {r["reason"] for r in log.rejects.collect()} == {
        "invalid timestamp", "invalid src_ip", "invalid src_port", "invalid protocol", "invalid packet_length",
        "wrong field count (expected 7, got 2)", "repeated header row"}
    assert tuple(log.quality.first()) == (12, 5, 7)
    assert sum(r["rows"] for r in reason_counts(log.rejects).collect()) == 7
    assert len(list(log.records())) == 5


def test_lines_that_broke_a_parser(spark, folder):
    quotes = '"' * 1_000_000
    long = "never" + "x" * 5_000 + ",10.0.0.1,192.168.1.1,1,2,TCP,5"
    path = write(folder, "a.csv", [HEADER, quotes + "x", long, '"","",""', '"2026-10-05 08:00:00",\t10.0.0.1\u00a0,"192.168.1.1",1,2,"TCP",5',
                                   '"2026-10-05, 08:00",10.0.0.1,192.168.1.1,1,2,TCP,5'])
    log = logs.read_logs(spark, path)
    assert log.flows.first()["src_ip"] == "10.0.0.1" and log.flows.count() == 1
    rejects = {r["raw"]: r["reason"] for r in log.rejects.collect()}        # whole lines, not their beginnings
    assert rejects.pop(quotes + "x").startswith("wrong field count") and rejects.pop(long) == "invalid timestamp"
    assert list(rejects.values()) == ["invalid timestamp"]


def test_all_reasons_of_a_row(spark, folder):
    path = write(folder, "a.csv", [HEADER, "x,y,z,-1,1.5,?,0"])
    assert logs.read_logs(spark, path).rejects.first()["reason"] == (
        "invalid timestamp; invalid src_ip; invalid dst_ip; invalid src_port; invalid dst_port; invalid protocol; "
        "invalid packet_length")


def test_byte_order_mark_quotes_and_two_files(spark, folder):
    write(folder, "a.csv", ["timestamp,src_ip,dst_ip,src_port,dst_port,protocol,packet_length", GOOD.format(i=1)], "utf-8-sig")
    write(folder, "b.csv", ["timestamp,src_ip,dst_ip,src_port,dst_port,protocol,packet_length",
                            '"2026-10-05 08:00:02", "10.0.0.2","192.168.1.1",1,"2",UDP,9\r'])
    log = logs.read_logs(spark, folder, "auto")
    assert log.layout.profile.name == "default" and log.flows.count() == 2 and log.rejects.count() == 0


def test_cicids_layout_is_detected(spark, folder):
    head = "Flow ID, Source IP, Source Port, Destination IP, Destination Port, Protocol, Timestamp, Flow Duration, Total Length of Fwd Packets, Label"
    rows = [f"f,10.0.0.1,5000,10.0.0.2,53,{p},3/7/2017 8:55,1,100000,BENIGN" for p in ("17", "6", "0")]
    log = logs.read_logs(spark, write(folder, "c.csv", [head, *rows]), "auto")
    assert log.layout.profile.name == "cicids"
    assert [r["protocol"] for r in log.flows.orderBy("seq").collect()] == ["UDP", "TCP", "HOPOPT"]
    assert log.flows.first()["timestamp"].strftime("%d.%m") == "03.07"


def test_headerless_unsw(spark, folder):
    def row(i):
        values = {"srcip": f"10.0.0.{i}", "sport": "0x0050" if i else "-", "dstip": "10.0.0.9", "dsport": "53",
                  "proto": "udp", "sbytes": "0", "Stime": "1421927414"}
        return ",".join(values.get(c, "0") for c in UNSW_HEADERLESS)
    log = logs.read_logs(spark, write(folder, "u.csv", [row(i) for i in range(4)]), "auto")
    assert log.layout.headerless and log.flows.count() == 4
    assert {r["src_port"] for r in log.flows.collect()} == {0, 80}


def test_each_file_has_its_own_layout(spark, folder):
    head = "Flow ID, Source IP, Source Port, Destination IP, Destination Port, Protocol, Timestamp, Flow Duration, Total Length of Fwd Packets, Label"
    write(folder, "a.csv", [HEADER, GOOD.format(i=1), HEADER])
    write(folder, "b.csv", [head, "f,10.0.0.1,5000,10.0.0.2,53,17,3/7/2017 8:55,1,100000,BENIGN", "f,10.0.0.1"])
    write(folder, "c.csv", ["protocol,timestamp,src_ip,dst_ip,src_port,dst_port,packet_length", "UDP,2026-10-05 08:00:00,10.0.0.7,10.0.0.8,1,2,77"])
    write(folder, "d.csv", ["what,is,this", "1,2,3"])
    log = logs.read_logs(spark, folder, "auto")
    assert {(r["src_ip"], r["protocol"], r["packet_length"]) for r in log.flows.collect()} == {
        ("10.0.0.1", "TCP", 500), ("10.0.0.1", "UDP", 100_000), ("10.0.0.7", "UDP", 77)}
    reasons = sorted(r["reason"] for r in log.rejects.collect())
    assert len(reasons) == 3 and reasons[0].startswith("file skipped: closest profile") and reasons[1:] == [
        "repeated header row", "wrong field count (expected 10, got 2)"]
    assert tuple(log.quality.first()) == (6, 3, 3)


def test_profiles_and_errors(spark, folder):
    path = write(folder, "x.csv", ["ts,src,dst,sp,dp,proto,len", "1700000000,10.0.0.1,10.0.0.2,-,443,6,70000"])
    names = {"ts": "timestamp", "src": "source_ip", "dst": "dst_ip", "sp": "source_port", "dp": "destination_port",
             "proto": "protocol", "len": "packet_length"}
    assert logs.read_logs(spark, path, names).flows.first()["protocol"] == "TCP"
    with pytest.raises(LogFormatError, match="missing"):
        logs.read_logs(spark, path, "auto")
    with pytest.raises(LogFormatError, match="'default' is missing"):
        logs.read_logs(spark, path)
    with pytest.raises(ValueError, match="unknown target"):
        custom_profile({"a": "nothing"})
    with pytest.raises(ValueError, match="unknown profile"):
        resolve_profile("other")
    with pytest.raises(ValueError, match="column mapping"):
        resolve_profile("custom")
    assert resolve_profile("CICIDS2017").name == "cicids" and resolve_profile("auto") is None
    with pytest.raises(LogFormatError, match="empty"):
        logs.read_logs(spark, write(folder, "e.csv", [""]))


def test_feed_files_and_precedence(spark, folder):
    first = write(folder, "alpha.txt", ["# note", "; note", "", "1.2.3.4 # bad host", "5.6.7.8,extra", "junk", "10.1.2.3/24",
                                        "2001:DB8:0::1", "0.0.0.0/0", "::/0"])
    second = write(folder, "beta.txt", ["1.2.3.4", "9.9.9.9", "192.0.2.66"])
    read = feeds.read_feeds(spark, [first, second])
    assert {(r["source"], r["entries"]) for r in feeds.feed_status(read).collect()} == {("alpha", 4), ("beta", 3)}
    static = containment.static_entries(spark, ("192.0.2.66",))
    merged = containment.merge_feeds(read, static)
    assert {(r["entry"], r["source"]) for r in merged.collect()} == {
        ("1.2.3.4/32", "alpha"), ("5.6.7.8/32", "alpha"), ("10.1.2.0/24", "alpha"), ("2001:db8::1/128", "alpha"), ("9.9.9.9/32", "beta")}
    view = {(r["entry"], r["source"]) for r in containment.combined_view(read, static).collect()}
    assert ("192.0.2.66/32", "static") in view and len(view) == 6


def ipv4(src, dst, proto, payload, length=None):
    return struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(payload) if length is None else length, 0, 0, 64, proto, 0,
                       bytes(src), bytes(dst)) + payload


def tcp(sport, dport):
    return struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 0x50, 0, 0, 0, 0)


def pcap(link, frames, order="<"):
    out = struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, link)
    for i, f in enumerate(frames):
        out += struct.pack(order + "IIII", 1_700_000_000 + i, 250_000, len(f), len(f)) + f
    return out


def pcapng(frames):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        return struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))
    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 101, 0, 0))
    for i, f in enumerate(frames):
        at = (1_700_000_000 + i) * 1_000_000
        out += block(6, struct.pack("<IIIII", 0, at >> 32, at & 0xFFFFFFFF, len(f), len(f)) + f)
    return out


A, B = (10, 0, 0, 1), (10, 0, 0, 2)


def test_captures(spark, folder):
    ether = b"\0" * 12
    six = struct.pack(">IHBB", 6 << 28, 8, 17, 64) + b"\x20\x01" + b"\0" * 13 + b"\1" + b"\x20\x01" + b"\0" * 13 + b"\2" + struct.pack(">HHHH", 53, 53, 8, 0)
    frames = [ether + b"\x08\0" + ipv4(A, B, 6, tcp(5000, 80)), ether + b"\x08\0" + ipv4(A, B, 17, struct.pack(">HHHH", 1, 53, 8, 0)),
              ether + b"\x08\0" + ipv4(A, B, 1, b"\0" * 8), ether + b"\x86\xdd" + six, ether + b"\x08\x06" + b"\0" * 28]
    files = {"eth.pcap": pcap(1, frames), "big.cap": pcap(101, [ipv4(A, B, 6, tcp(1, 2), 0)], ">"),
             "next.pcapng": pcapng([ipv4(A, B, 6, tcp(3, 4))]), "cut.pcap": pcap(101, [ipv4(A, B, 6, tcp(5, 6))] * 2)[:-5],
             "renamed.bin": pcap(101, [ipv4(A, B, 6, tcp(7, 8)[:10])]), "text.txt": b"hello", "broken.pcap": b"junkjunk"}
    for name, data in files.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    flows, rejects = capture.read_captures(spark, f"{folder}/*")
    got = sorted((r["protocol"], r["src_ip"], r["src_port"], r["dst_port"], r["packet_length"]) for r in flows.collect())
    assert got == sorted([("TCP", "10.0.0.1", 5000, 80, 40), ("UDP", "10.0.0.1", 1, 53, 28), ("ICMP", "10.0.0.1", 0, 0, 28),
                          ("UDP", "2001::1", 53, 53, 48), ("TCP", "10.0.0.1", 1, 2, 40), ("TCP", "10.0.0.1", 3, 4, 40),
                          ("TCP", "10.0.0.1", 5, 6, 40)])
    assert flows.agg(F.min("ts_us")).first()[0] == 1_700_000_000_000_000
    reasons = sorted(r["reason"] for r in rejects.collect())
    assert reasons == ["file skipped: not a capture (magic 6a756e6b)", "packet skipped: capture truncated: incomplete block",
                       "packet skipped: non-IP packet", "packet skipped: truncated TCP header"]
    assert flows.select("seq").distinct().count() == 7
    limited = capture.decode_captures(capture.capture_files(spark, f"{folder}/eth.pcap"), max_packets=2)
    assert limited.count() == 2


def test_detectors_run_on_captures(spark, folder):
    frames = [ipv4(A, B, 6, tcp(5000, 1000 + i)) for i in range(15)]
    header = pcap(101, frames)
    fast = bytearray(header)
    for i in range(15):      # all within one second
        struct.pack_into("<I", fast, 24 + i * 56, 1_700_000_000)
        struct.pack_into("<I", fast, 28 + i * 56, i * 1000)
    with open(f"{folder}/scan.pcap", "wb") as f:
        f.write(bytes(fast))
    flows, _ = capture.read_captures(spark, f"{folder}/scan.pcap")
    assert port_scan_alerts(flows).first()["severity"] == "MEDIUM"


def test_many_files_without_a_layout_add_no_scan(spark, folder):
    head = "Flow ID,Source IP,Source Port,Destination IP,Destination Port,Protocol,Timestamp,Flow Duration,Total Length of Fwd Packets,Label"
    write(folder, "a.csv", ["", HEADER, GOOD.format(i=1), HEADER])
    write(folder, "b.csv", [head, "f,10.0.0.1,5000,10.0.0.2,53,17,3/7/2017 8:55,1,100000,BENIGN"])
    few = logs.read_logs(spark, folder, "auto")
    for i in range(20):
        write(folder, f"bad{i}.csv", [f"what,is,{i}", "1,2,3"])
        write(folder, f"bare{i}.csv", [",".join({"srcip": f"10.9.0.{i}", "sport": "1", "dstip": "10.0.0.9", "dsport": "53", "proto": "udp",
                                                 "Stime": "1421927414"}.get(c, "0") for c in UNSW_HEADERLESS)])
    write(folder, "empty.csv", ["", "  "])
    many = logs.read_logs(spark, folder, "auto")

    def scans(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("Relation ")
    assert scans(many.flows) == scans(few.flows) == 2 and scans(many.rejects) == 5     # the text and the manifest, twice, and the skipped files
    assert many.flows.count() == 22 and many.flows.where("src_ip like '10.9.%'").count() == 20
    assert tuple(many.quality.first()) == (43, 22, 21)
    skipped = many.rejects.where("reason like 'file skipped: closest%'")
    assert {r["raw"] for r in skipped.collect()} == {f"what,is,{i}" for i in range(20)}


def test_manifest_rows(spark, folder):
    write(folder, "a.csv", ["﻿" + HEADER, GOOD.format(i=1)])
    write(folder, "b.csv", ["one", "two"])
    found = {r["source"][-5:]: r for r in logs.manifest(spark, folder, None).collect()}
    assert found["a.csv"]["positions"] == list(range(7)) and found["a.csv"]["names"][0] == "timestamp" and found["a.csv"]["splits"] == 1
    assert not found["a.csv"]["headerless"] and found["a.csv"]["profile"] == 0
    assert found["b.csv"]["positions"] is None and found["b.csv"]["profile"] is None and "is missing" in found["b.csv"]["why"]
