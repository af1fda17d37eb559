"""Address-in-network joins and feed merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.ip import masked, parse_network, with_address, with_network
from .scan import running

NETWORK = "entry string, source string, ord bigint, family int, prefix int, hi bigint, lo bigint, host boolean"


def static_entries(spark: SparkSession, blocklist: tuple[str, ...]) -> DataFrame:
    """The configured blocklist as networks (a handful of literals, parsed where they are)."""
    rows = []
    for i, text in enumerate(blocklist):
        net = parse_network(text)
        if net is None:
            raise ValueError(f"not an address or network: {text!r}")
        family, prefix, hi, lo, entry = net
        rows.append((entry, "static", i, family, prefix, hi, lo, prefix == (128 if family == 6 else 32)))
    return spark.createDataFrame(rows, NETWORK)


def intake(entries: DataFrame) -> DataFrame:
    """Valid entries as networks: ``entry`` (canonical), ``source, ord, family, prefix, hi, lo, host``.

    Invalid text is dropped.  ``host`` marks single addresses; when several entries name one
    host the last one counts, networks keep every entry.
    """
    nets = with_network(entries, "entry").where(F.col("family").isNotNull())
    nets = nets.withColumn("host", F.col("prefix") == F.when(F.col("family") == 6, 128).otherwise(32))
    latest = Window.partitionBy("entry").orderBy(F.col("ord").desc())
    return (nets.withColumn("_again", F.row_number().over(latest))
            .where(~F.col("host") | (F.col("_again") == 1)).drop("_again"))


def entry_count(entries: DataFrame) -> DataFrame:
    """Hosts plus networks taken in."""
    return intake(entries).agg(F.count_if("host").alias("hosts"), F.count_if(~F.col("host")).alias("networks"),
                               F.count(F.lit(1)).alias("size"))


def merge_feeds(feeds: DataFrame, static: DataFrame | None = None) -> DataFrame:
    """One row per canonical entry: the first feed (by ``feed_ord``, then ``ord``) wins, and
    entries already listed statically are removed."""
    first = Window.partitionBy("entry").orderBy("feed_ord", "ord")
    merged = feeds.withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first")
    if static is not None:
        merged = merged.join(static.select("entry"), "entry", "left_anti")
    return merged


def combined_view(feeds: DataFrame, static: DataFrame) -> DataFrame:
    """``entry, source`` of static and feed entries together; static wins."""
    both = static.select("entry", F.lit("static").alias("source"), F.lit(0).alias("kind"),
                        F.lit(0).alias("feed_ord"), "ord").unionByName(
        feeds.select("entry", "source", F.lit(1).alias("kind"), F.col("feed_ord").cast("int").alias("feed_ord"), "ord"))
    first = Window.partitionBy("entry").orderBy("kind", "feed_ord", "ord")
    return both.withColumn("_first", F.row_number().over(first)).where("_first = 1").select("entry", "source")


def endpoints(flows: DataFrame) -> DataFrame:
    """Every address seen at either end, once."""
    return flows.select(F.col("src_ip").alias("ip")).union(flows.select("dst_ip")).distinct()


def _unsigned(half: Column) -> Column:
    """A half of an address as a long that sorts by its unsigned value."""
    return half.bitwiseXOR(F.lit(-(1 << 63)))


def network_marks(entries: DataFrame) -> DataFrame:
    """entries (family, prefix, hi, lo, source, kind, host, ord) -> the ends of the networks along the
    addresses: ``family, hi, lo, turn`` and the winning entry (``kind, source``) from there on.

    Networks are nested or apart.  Inside one the winner is the least of its own rank and the ranks of
    the networks around it, behind it the least of those around; kind -1 stands for none.  At one
    address networks begin from the outside in (turn: prefix length), and end from the inside out."""
    rank = F.struct("kind", (~F.col("host")).alias("net"), "ord", "source")
    nets = entries.groupBy("family", "prefix", "hi", "lo").agg(F.min(rank).alias("own"))
    lengths = nets.select("family", F.col("prefix").alias("wide")).distinct()         # at most 33 + 129 rows
    hi, lo = masked(F.col("family"), F.col("hi"), F.col("lo"), F.col("wide"))
    probes = nets.join(F.broadcast(lengths), "family").where("wide < prefix").select(
        "family", "prefix", F.col("hi").alias("net_hi"), F.col("lo").alias("net_lo"), F.col("wide"), hi.alias("hi"), lo.alias("lo"))
    around = probes.join(nets.select("family", F.col("prefix").alias("wide"), "hi", "lo", F.col("own").alias("outer")), ["family", "wide", "hi", "lo"])
    around = around.groupBy("family", "prefix", F.col("net_hi").alias("hi"), F.col("net_lo").alias("lo")).agg(F.min("outer").alias("outer"))
    both = nets.join(around, ["family", "prefix", "hi", "lo"], "left")
    width = F.when(F.col("family") == 6, 128).otherwise(32)
    top, bottom = masked(F.col("family"), F.lit(-1).cast("bigint"), F.lit(-1).cast("bigint"), F.col("prefix"))
    last_hi = F.when(F.col("family") == 6, F.col("hi").bitwiseOR(F.bitwise_not(top))).otherwise(F.lit(0).cast("bigint"))
    last_lo = F.when(F.col("family") == 6, F.col("lo").bitwiseOR(F.bitwise_not(bottom))).otherwise(
        F.col("lo").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), width - F.col("prefix")) - 1))

    def mark(hi: Column, lo: Column, turn: Column, winner: Column) -> Column:
        return F.struct(_unsigned(hi).alias("hi"), _unsigned(lo).alias("lo"), turn.cast("int").alias("turn"),
                        F.coalesce(winner["kind"], F.lit(-1)).alias("kind"), F.coalesce(winner["source"], F.lit("")).alias("source"))
    return both.select("family", F.explode(F.array(
        mark(F.col("hi"), F.col("lo"), F.col("prefix"), F.least("own", "outer")),
        mark(last_hi, last_lo, F.lit(1000) - F.col("prefix"), F.col("outer")))).alias("m")).select("family", "m.*")


def listed(addresses: DataFrame, static: DataFrame, feeds: DataFrame | None = None) -> DataFrame:
    """``ip, static_hit, source`` for each address that some entry contains.

    ``static`` comes from ``static_entries``, ``feeds`` holds ``entry, source, ord``.  Addresses and the
    ends of networks are merged along the number line in one scan by volume: each address takes the
    winner of the last end before it, so neither many entries nor a wide network gathers rows anywhere.
    Static entries come before feeds, hosts before networks, then feed order.
    """
    entries = static.withColumn("kind", F.lit(0))
    if feeds is not None:
        entries = entries.unionByName(intake(feeds).withColumn("kind", F.lit(1)))
    known = with_address(addresses.select("ip").distinct(), "ip").where(F.col("family").isNotNull())
    points = known.select("family", _unsigned(F.col("hi")).alias("hi"), _unsigned(F.col("lo")).alias("lo"), F.lit(500).alias("turn"), "ip")
    line = network_marks(entries).unionByName(points, allowMissingColumns=True)
    found = running(line, ["family"], ["hi", "lo", "turn"], {"winner_kind": ("last", "kind"), "winner": ("last", "source")})
    return found.where("ip IS NOT NULL AND winner_kind >= 0").select("ip", (F.col("winner_kind") == 0).alias("static_hit"), F.col("winner").alias("source"))
