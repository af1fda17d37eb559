"""Beaconing: a pair that connects at a suspiciously regular interval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..config import DEFAULT, Beaconing, Settings, us
from ..functions.text import plain, port_list, seen_text
from ..operators.firsts import top_per_group
from ..operators.incidents import only_busy, to_units
from ..operators.tiles import tile_of
from ..schema import as_alerts
from ..session import stored

PAIR = ["src_ip", "dst_ip"]


#: tile_summaries() as a table.
TILE = ("src_ip string, dst_ip string, tile bigint, head_us bigint, last_us bigint, inner_n bigint, inner_first_us bigint, "
        "inner_last_us bigint, steps bigint, step_mean double, step_var double, step_min bigint, step_max bigint")


def tile_summaries(units: DataFrame, p: Beaconing) -> DataFrame:
    """Per (pair, tile): what later steps need to know about the connections inside it.

    A row is a new connection when it comes at least ``session_gap`` after the row before.  For
    the first row of a tile that depends on an earlier tile, so it is kept apart (``head_us``);
    the statistics cover the steps between the connections after it.
    """
    gap = us(p.session_gap_s)
    if gap < 1:
        raise ValueError("the session gap must be positive")
    w = Window.partitionBy(*PAIR, "tile").orderBy("ts_us")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    since = F.col("ts_us") - F.lag("ts_us").over(w)
    rows = (units.select(*PAIR, "ts_us", tile_of("ts_us", us(p.tile_s)).alias("tile"))
            .withColumn("since", since)
            .withColumn("opens", F.col("since").isNull() | (F.col("since") >= gap))
            .withColumn("head_us", F.min("ts_us").over(w))
            .withColumn("previous_us", F.max(F.when(F.col("opens"), F.col("ts_us"))).over(before)))
    inner = F.col("opens") & F.col("since").isNotNull()
    step = F.when(inner & (F.col("previous_us") > F.col("head_us")), F.col("ts_us") - F.col("previous_us"))
    return rows.groupBy(*PAIR, "tile").agg(
        F.min("ts_us").alias("head_us"), F.max("ts_us").alias("last_us"),
        F.count_if(inner).alias("inner_n"),
        F.min(F.when(inner, F.col("ts_us"))).alias("inner_first_us"),
        F.max(F.when(inner, F.col("ts_us"))).alias("inner_last_us"),
        F.count(step).alias("steps"), F.avg(step).alias("step_mean"), F.var_pop(step).alias("step_var"),
        F.min(step).alias("step_min"), F.max(step).alias("step_max"))


def interval_stats(tiles: DataFrame, p: Beaconing) -> DataFrame:
    """Per pair: connections and mean, population deviation, least and greatest interval (s).

    ``tiles`` are summaries of stretches of time that follow each other; a tile may come in several.
    Spread is summed around the exact overall mean, within tiles plus between tiles, so nothing
    cancels and no pair's rows are gathered: a pair contributes one row per tile.
    """
    gap = us(p.session_gap_s)
    w = Window.partitionBy(*PAIR).orderBy("head_us")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*PAIR)
    tiles = tiles.withColumn("_prior", F.lag("last_us").over(w))
    starts = F.col("_prior").isNull() | (F.col("head_us") - F.col("_prior") >= gap)
    tiles = (tiles.withColumn("starts", starts)
             .withColumn("first_conn", F.when(F.col("starts"), F.col("head_us")).otherwise(F.col("inner_first_us")))
             .withColumn("last_conn", F.coalesce("inner_last_us", F.when(F.col("starts"), F.col("head_us"))))
             .withColumn("conns", F.col("inner_n") + F.col("starts").cast("bigint"))
             .withColumn("head_step", F.when(F.col("starts"), F.col("inner_first_us") - F.col("head_us")))
             .withColumn("cross_step", F.col("first_conn") - F.max("last_conn").over(before))
             .withColumn("connections", F.sum("conns").over(whole))
             .withColumn("span", F.max("last_conn").over(whole) - F.min("first_conn").over(whole)))
    tiles = tiles.where(F.col("connections") > p.connections_over).withColumn(
        "mean", F.col("span") / (F.col("connections") - 1))

    def off(x):
        return F.coalesce(F.pow(x - F.col("mean"), 2), F.lit(0.0))

    spread = (F.coalesce(F.col("steps") * (F.col("step_var") + F.pow(F.col("step_mean") - F.col("mean"), 2)), F.lit(0.0))
              + off(F.col("head_step")) + off(F.col("cross_step")))
    return (tiles.groupBy(*PAIR, "connections", "mean").agg(
        F.sum(spread).alias("_spread"),
        F.min(F.least("step_min", "head_step", "cross_step")).alias("_min"),
        F.max(F.greatest("step_max", "head_step", "cross_step")).alias("_max"),
        F.min("head_us").alias("first_us"), F.max("last_us").alias("last_us"))
        .select(*PAIR, "connections", (F.col("mean") / 1e6).alias("mean_s"),
                (F.sqrt(F.col("_spread") / (F.col("connections") - 1)) / 1e6).alias("std_s"),
                (F.col("_min") / 1e6).alias("min_s"), (F.col("_max") / 1e6).alias("max_s"),
                "first_us", "last_us"))


def beacons(flows: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    rows = only_busy(flows.select(*PAIR, "dst_port", "ts_us"), PAIR, s.beaconing.connections_over)
    units = stored(to_units(rows, [*PAIR, "dst_port"]), "units-beaconing")       # instants may repeat: no time lies between
    return beacons_from(tile_summaries(units, s.beaconing), units, s)


def beacons_from(tiles: DataFrame, ports: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Beacons by the summaries of all stretches of time and the ports met in them (repeats allowed)."""
    p = s.beaconing
    found = interval_stats(tiles, p).where((F.col("mean_s") >= p.mean_from_s) & (F.col("std_s") < p.std_below_s))
    ports = ports.groupBy(*PAIR, "dst_port").agg(F.lit(1).alias("_one"))
    shown = (top_per_group(ports, PAIR, [F.asc("dst_port")], s.port_limit)
             .groupBy(*PAIR).agg(F.sort_array(F.collect_list("dst_port")).alias("dst_ports")))
    high = (F.col("std_s") < p.high_std_below_s) & (F.col("connections") >= p.high_from_connections)
    return found.join(shown, PAIR).withColumn("severity", F.when(high, "HIGH").otherwise("MEDIUM"))


def beacon_alerts(flows: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    return _alerts(beacons(flows, s), s)


def beacon_alerts_from(tiles: DataFrame, ports: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    return _alerts(beacons_from(tiles, ports, s), s)


def _alerts(table: DataFrame, s: Settings) -> DataFrame:
    p = s.beaconing
    return as_alerts(table.select(
        F.lit("BEACONING").alias("alert_type"), "severity",
        F.col("src_ip").alias("source_ip"), F.col("dst_ip").alias("dest_ip"),
        F.format_string("Possible C2 beaconing: %d connections every %.1fs (std %.2fs, threshold "
                        f"<{plain(p.std_below_s)}s), dst ports %s", "connections", "mean_s", "std_s",
                        port_list(F.slice("dst_ports", 1, 5))).alias("description"),
        "first_us", "last_us",
        F.to_json(F.struct(
            "connections", "dst_ports", seen_text(F.col("first_us")).alias("first_seen"),
            seen_text(F.col("last_us")).alias("last_seen"),
            F.round("max_s", 3).alias("max_interval_seconds"), F.round("mean_s", 3).alias("mean_interval_seconds"),
            F.round("min_s", 3).alias("min_interval_seconds"), F.round("std_s", 3).alias("std_interval_seconds"),
        )).alias("details"),
        F.array("src_ip", "dst_ip").alias("key_parts"),
    ))
