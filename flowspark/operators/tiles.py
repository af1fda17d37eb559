"""Window metrics and clusters that survive a hot key.

A window partitioned by a busy key puts that key's whole history into one task.  Here windows are
running sums over "enter" and "leave" marks, scanned by volume (``scan.running``): no key, and no
stretch of time of a key, has to fit one task, and no per-row frame or set is held.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from . import scan
from .scan import running


def tile_of(ts: Column | str, tile_us: int) -> Column:
    """Index of the tile holding ``ts`` (exact for times before 1970 too)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    width = F.lit(tile_us).cast("bigint")
    return F.call_function("div", ts - F.pmod(ts, width), width)


def trailing_metric(units: DataFrame, keys: Sequence[str], window_us: int, over: int,
                    value: str | None = None, weight: str = "n") -> DataFrame:
    """Rows whose trailing-window metric exceeds ``over``.

    The window at ``t`` is ``[t - window, t]``, both ends included.  The metric is the sum
    of ``weight`` (``value`` is None) or the number of distinct ``value``.  ``units`` must
    hold ``keys``, ``ts_us`` and ``weight`` or ``value``; it may repeat instants, and the last
    row of an instant has the instant's metric.

    Returns ``keys, ts_us, metric, left_us`` with ``left_us`` the time of the oldest row
    inside the window.
    """
    if over < 1:
        raise ValueError("the threshold of a sliding rule must be at least 1")
    keys = list(keys)
    size = units.count()                               # of stored units: from the files' footers
    if value is None:
        enter = leave = F.col(weight)
        rows = units.select(*keys, "ts_us", weight)
    else:
        rows = running(units.select(*keys, value, "ts_us"), [*keys, value], ["ts_us"],
                       {"before_us": ("lag", "ts_us"), "after_us": ("next", "ts_us")}, scan.parts_for(units, size))
        before, after = F.col("before_us"), F.col("after_us")
        enter = F.when(before.isNull() | (F.col("ts_us") - before > window_us), 1).otherwise(0)
        leave = F.when(after.isNull() | (after - F.col("ts_us") > window_us), 1).otherwise(0)

    # A row enters at its time and leaves one microsecond after the window; who leaves goes first.
    marks = rows.select(*keys, F.explode(F.array(
        F.struct(F.col("ts_us").alias("at"), F.lit(1).alias("enters"), F.lit(0).alias("leaves"), enter.cast("bigint").alias("delta")),
        F.struct((F.col("ts_us") + window_us + 1).alias("at"), F.lit(0).alias("enters"), F.lit(1).alias("leaves"),
                 (-leave).cast("bigint").alias("delta")))).alias("mark")).select(*keys, "mark.*")
    scanned = running(marks, keys, ["at", "enters"], {
        "metric": ("sum", "delta"), "entered": ("sum", "enters"), "left": ("sum", "leaves")}, scan.parts_for(units, 2 * size)).where("enters = 1")
    hits = scanned.where(F.col("metric") > over).select(*keys, F.col("at").alias("ts_us"), "metric", (F.col("left") + 1).alias("nth"))
    # Rows leave in the order they came, so the oldest one inside is known by its number.
    oldest = scanned.select(*keys, F.col("entered").alias("nth"), F.col("at").alias("left_us"))
    return hits.join(oldest, [*keys, "nth"]).select(*keys, "ts_us", "metric", "left_us")


def clusters(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: Column | int) -> DataFrame:
    """df with ``cluster``, the same number for all intervals of a key whose union they are: those that
    overlap or lie at most ``gap`` apart; a gap given by a column must be the same for all rows of a key."""
    gap = F.lit(gap) if isinstance(gap, int) else gap
    return scan.clusters(df.withColumn("_gap", gap.cast("bigint")), keys, start, end, "_gap").drop("_gap")


def cluster_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: Column | int,
                      folds: dict[str, Column]) -> DataFrame:
    """One row for each of the ``clusters``: ``keys``, its ``start`` and ``end``, and ``folds``,
    aggregates by name over its rows."""
    return clusters(df, keys, start, end, gap).groupBy(*keys, "cluster").agg(
        F.min(start).alias(start), F.max(end).alias(end), *[fold.alias(name) for name, fold in folds.items()]).drop("cluster")
