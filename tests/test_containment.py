"""Addresses among nested networks against ipaddress."""
from __future__ import annotations

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from flowspark.operators import containment, scan


def winner(text, entries):
    """(static_hit, source) of the first entry, in precedence order, that contains the address."""
    address = ipaddress.ip_address(text)
    held = [(kind, net.prefixlen < net.max_prefixlen, order, source) for kind, order, source, net in entries
            if net.version == address.version and address in net]
    return (min(held)[0] == 0, min(held)[3]) if held else None


@pytest.mark.parametrize("seed", [1, 2])
def test_nested_networks(spark, seed):
    """Networks inside networks of both families, the same network in several feeds, the ends of the number line."""
    draw = random.Random(seed)
    wide = ["10.0.0.0/8", "10.1.0.0/16", "255.0.0.0/8", "0.0.0.0/1", "ff00::/8", "2001:db8::/32", "::/3", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff"]
    nets = [f"10.{draw.randrange(3)}.{draw.randrange(4)}.{draw.randrange(256)}/{draw.choice([24, 25, 28, 30, 31, 32])}" for _ in range(60)]
    nets += [f"2001:db8:{draw.randrange(3)}::{draw.randrange(9):x}/{draw.choice([48, 64, 96, 126, 128])}" for _ in range(40)]
    feeds = [(t, f"feed{i % 3}", i) for i, t in enumerate(draw.sample(wide + nets + nets[:20], k=len(wide) + len(nets)))]
    static = ("10.2.0.0/20", "10.1.1.7", "2001:db8:1::/64")
    entries = [(0, i, "static", ipaddress.ip_network(t)) for i, t in enumerate(static)]
    last = {}
    for text, source, order in feeds:                       # the last entry that names a host counts
        net = ipaddress.ip_network(text, strict=False)
        last[(net, order) if net.prefixlen < net.max_prefixlen else net] = (1, order, source, net)
    entries += last.values()
    ips = [f"10.{draw.randrange(4)}.{draw.randrange(5)}.{draw.randrange(256)}" for _ in range(300)]
    ips += [f"2001:db8:{draw.randrange(4)}::{draw.randrange(12):x}" for _ in range(100)]
    ips += ["255.255.255.255", "0.0.0.0", "128.0.0.0", "127.255.255.255", "11.0.0.0", "9.255.255.255", "::", "1::", "3fff::", "4000::",
            "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:fffe", "7fff::", "8000::"]
    want = {t: w for t in ips if (w := winner(t, entries))}
    got = containment.listed(spark.createDataFrame([(t,) for t in [*ips, "no address"]], "ip string"), containment.static_entries(spark, static),
                             spark.createDataFrame(feeds, "entry string, source string, ord long"))
    assert {r["ip"]: (r["static_hit"], r["source"]) for r in got.collect()} == want and len(want) > 150
    assert len({w for _, w in want.values()}) == 4


def test_static_entries_alone_and_nothing(spark):
    ips = spark.createDataFrame([("192.0.2.66",), ("192.0.2.67",)], "ip string")
    assert [tuple(r) for r in containment.listed(ips, containment.static_entries(spark, ("192.0.2.66",))).collect()] == [("192.0.2.66", True, "static")]
    assert containment.listed(ips, containment.static_entries(spark, ())).count() == 0
    assert containment.listed(ips.limit(0), containment.static_entries(spark, ("192.0.2.66",))).count() == 0


def test_a_wide_network_is_no_hot_key(spark, monkeypatch):
    """All addresses inside one /8: the parts of the scan hold like numbers of them."""
    sizes, plain = [], scan._local

    def probe(*args):
        local = plain(*args)
        sizes.extend(r["count"] for r in local.groupBy("part").count().collect())
        return local
    monkeypatch.setattr(scan, "_local", probe)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ips = spark.range(20_000).select(F.format_string("10.%d.%d.%d", F.col("id") % 7, F.col("id") % 256, (F.col("id") / 100).cast("int")).alias("ip"))
        got = containment.listed(ips, containment.static_entries(spark, ("10.0.0.0/8",)))
        assert got.where("static_hit").count() == ips.distinct().count()
        assert len(sizes) == 4 and max(sizes) < 2 * sum(sizes) / 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
