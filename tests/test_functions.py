"""Field and address functions."""

from __future__ import annotations

import datetime as dt
import ipaddress
import random

from pyspark.sql import functions as F

from flowspark.functions import fields
from flowspark.functions.ip import is_ip, masked, with_address, with_network
from flowspark.functions.text import clock_span, human_bytes, human_span


def parsed(fn, text):
    try:
        return fn(text)
    except ValueError:
        return None


def odd_addresses(rng, n):
    parts4 = ["0", "1", "9", "10", "99", "100", "199", "200", "255", "256", "300", "01", "a", ""]
    parts6 = ["", "0", "0", "1", "ffff", "AbCd", "0001", "12345", "g"]
    for _ in range(n):
        yield ".".join(rng.choice(parts4) for _ in range(rng.choice([3, 4, 4, 4, 5])))
        yield ":".join(rng.choice(parts6) for _ in range(rng.randint(2, 9)))
        yield str(ipaddress.IPv6Address(rng.getrandbits(128) & rng.getrandbits(128) & rng.getrandbits(128)))
        yield ":".join(rng.choice(["", "0", "1"]) for _ in range(rng.randint(1, 7))) + ":1.2.3.4"


def test_addresses_agree_with_the_standard_library(spark):
    texts = [*odd_addresses(random.Random(1), 400), "::", "::1", "1::", "fe80::1%eth0", "1:2:3:4:5:6:7::"]
    df = spark.createDataFrame([(t,) for t in texts], "s string").withColumn("ok", is_ip(F.col("s")))
    for r in with_address(df, "s").collect():
        want = parsed(ipaddress.ip_address, r.s)
        assert r.ok == (want is not None), r.s
        if want is not None:
            assert ((r.hi & (2**64 - 1)) << 64) | (r.lo & (2**64 - 1)) == int(want), r.s


def test_networks_and_masks(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(300):
        base = rng.choice([ipaddress.IPv4Address(rng.getrandbits(32)), ipaddress.IPv6Address(rng.getrandbits(128))])
        texts.append(f"{base}{rng.choice(['', f'/{rng.randint(0, 34)}', f'/{rng.randint(0, 130)}', '/255.255.0.0', '/0.0.0.255', '/', '/a'])}")
    nets = with_network(spark.createDataFrame([(t,) for t in texts], "s string"), "s")
    for r in nets.collect():
        want = parsed(lambda t: ipaddress.ip_network(t, strict=False), r.s)
        assert r.entry == (str(want) if want else None)
    some = nets.where("prefix is not null").select("entry", "family", "prefix", "hi", "lo")
    hi, lo = masked(F.col("family"), F.col("hi"), F.col("lo"), F.col("prefix"))
    assert some.where((hi != F.col("hi")) | (lo != F.col("lo"))).count() == 0


def test_timestamps(spark):
    utc = dt.timezone.utc
    cases = {
        "2026-10-05 08:00:00.123456": dt.datetime(2026, 10, 5, 8, 0, 0, 123456),
        "2026-10-05T08:00:00-05:00": dt.datetime(2026, 10, 5, 13), "2026-10-05 08:00:00 +0200": dt.datetime(2026, 10, 5, 6),
        "1700000000": dt.datetime(2023, 11, 14, 22, 13, 20), "1700000000123": dt.datetime(2023, 11, 14, 22, 13, 20, 123000),
        "7/7/2017 3:30": dt.datetime(2017, 7, 7, 3, 30), "03/07/2017 08:55:58": dt.datetime(2017, 7, 3, 8, 55, 58),
        "2/13/2024": dt.datetime(2024, 2, 13), "13/02/2024 01:02:03 PM": dt.datetime(2024, 2, 13, 13, 2, 3),
        "5 Oct 2026 08:00:00": dt.datetime(2026, 10, 5, 8), "0": None, "-5": None, "": None, "12:30": None, "not-a-date": None,
        "2026-13-01": None, "99/99/2024": None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "s string")
    got = {r.s: r.us for r in df.select("s", F.unix_micros(fields.timestamp(F.col("s"), dayfirst=True)).alias("us")).collect()}
    assert got == {t: None if v is None else round(v.replace(tzinfo=utc).timestamp() * 1e6) for t, v in cases.items()}


def test_ports_and_protocols(spark):
    ports = {"80": 80, "80.0": 80, "80.5": None, "0x0050": 80, "0xzz": None, "-": None, "70000": None, "-1": None, "1e3": 1000}
    got = spark.createDataFrame([(t,) for t in ports], "s string").select("s", fields.port(F.col("s")).alias("p")).collect()
    assert {r.s: r.p for r in got} == ports
    assert spark.sql("select '-' s").select(fields.port(F.col("s"), True)).first()[0] == 0
    names = {"6": "TCP", "17.0": "UDP", "tcp": "TCP", "200": "PROTO-200", "0": "HOPOPT", "6.5": "6.5"}
    got = spark.createDataFrame([(t,) for t in names], "s string").select("s", fields.protocol(F.col("s")).alias("p")).collect()
    assert {r.s: r.p for r in got} == names


def test_display_text(spark):
    one = spark.range(1).select(
        human_bytes(F.lit(1536)).alias("kb"), human_bytes(F.lit(512)).alias("b"), human_bytes(F.lit(3 * 1024**2), True).alias("mib"),
        human_span(F.lit(600.0)).alias("min"), human_span(F.lit(7200.0)).alias("h"), clock_span(F.lit(90061.5)).alias("clock")).first()
    assert tuple(one) == ("1.5 KB", "512 B", "3.0 MiB", "10.0 min", "2.0 h", "25:01:01")
