"""Evaluate expensive expressions once per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def once(df: DataFrame, keep: Sequence[str], computed: Sequence[Column]) -> DataFrame:
    """``keep`` plus the aliased ``computed`` columns.

    A filter on a computed column would be pushed below a plain projection, repeating its
    expressions there; it stops at this one-row generator and tests the value instead.
    """
    return df.select(*keep, F.explode(F.array(F.struct(*computed))).alias("_v")).select(*keep, "_v.*")
