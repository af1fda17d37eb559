"""Short sorted lists per group, without collecting the group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group.  Spark limits each map partition to ``k`` rows per
    group before the shuffle, so a hot group sends at most k rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_values(df: DataFrame, keys: Sequence[str], value: str, k: int, out: str) -> DataFrame:
    """``keys, {out}`` (the k smallest distinct values, sorted) and ``{out}_count`` (all of them).

    ``df`` may repeat values; they are made distinct first, which spreads a hot group by value.
    """
    keys = list(keys)
    cells = df.groupBy(*keys, value).agg(F.lit(1).alias("_one"))
    counts = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{out}_count"))
    shown = (top_per_group(cells, keys, [F.col(value)], k)
             .groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias(out)))
    return counts.join(shown, keys)
