"""Incidents: maximal periods in which a sliding rule is violated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .scan import parts_for
from .tiles import cluster_intervals, tile_of, trailing_metric


def by_volume(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df dealt by keys to as many parts as its volume asks for, if those are more than the session's: what a
    task holds does not grow with the input."""
    parts = parts_for(df, df.count())
    return df.repartition(parts, *keys) if parts else df


def busy_keys(df: DataFrame, keys: Sequence[str], over: int, value: str | None = None) -> DataFrame:
    """Keys whose whole-input count (or distinct count) exceeds ``over``.

    Distinct values are counted in two grouping steps, so a hot key is split by value.
    """
    keys = list(keys)
    if value is None:
        sized = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    else:
        sized = df.groupBy(*keys, value).agg(F.lit(1).alias("one")).groupBy(*keys).agg(
            F.count(F.lit(1)).alias("size"))
    return sized.where(F.col("size") > over)


def only_busy(df: DataFrame, keys: Sequence[str], over: int, value: str | None = None) -> DataFrame:
    """Semi-join reduction before an expensive window: a necessary condition, never a filter
    on results.  Adaptive execution broadcasts the key set when its measured bytes allow it."""
    keys = list(keys)
    return df.join(busy_keys(df, keys, over, value).select(*keys), keys, "left_semi")


def to_units(df: DataFrame, dims: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """One row per (dims, instant) with its row count ``n``: ties collapse map-side, so coarse
    clocks cannot pile a flood onto one (key, instant) task."""
    return df.groupBy(*dims, "ts_us").agg(F.count(F.lit(1)).alias("n"), *extra)


def incidents(units: DataFrame, keys: Sequence[str], window_us: int, over: int,
              value: str | None = None) -> DataFrame:
    """``keys, start_us, end_us, peak`` for every incident of every key.

    A row violates when its trailing metric is strictly above ``over``.  An incident begins at
    the oldest row of its first violating window, ends at its last violating row, and absorbs
    later violating windows that start no more than one window after that end.
    """
    hits = trailing_metric(units, keys, window_us, over, value)
    spans = hits.select(*keys, F.col("left_us").alias("start_us"), F.col("ts_us").alias("end_us"), F.col("metric").alias("peak"))
    return cluster_intervals(spans, keys, "start_us", "end_us", window_us, {"peak": F.max("peak")})


def rows_of_incidents(units: DataFrame, found: DataFrame, keys: Sequence[str], window_us: int,
                      tile_windows: int = 16) -> DataFrame:
    """Every unit that lies between start and end of its key's incident.

    The range condition rides on an equality over (keys, tile): a tile holds at most
    ``tile_windows + 2`` incidents of a key, so no key's rows meet all of its incidents.
    """
    keys = list(keys)
    tile_us = window_us * tile_windows
    spread = found.withColumn("tile", F.explode(F.sequence(
        tile_of("start_us", tile_us), tile_of("end_us", tile_us))))
    return (units.withColumn("tile", tile_of("ts_us", tile_us))
            .join(spread, keys + ["tile"])
            .where(F.col("ts_us").between(F.col("start_us"), F.col("end_us")))
            .drop("tile"))
