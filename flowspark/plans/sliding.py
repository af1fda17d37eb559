"""The common shape of the sliding rules, shared by batch and streaming runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.incidents import by_volume, incidents, only_busy, to_units
from ..session import stored


@dataclass(frozen=True)
class SlidingRule:
    """A key, a metric over a trailing window, and what to report about an incident."""

    name: str
    keys: tuple[str, ...]
    window_us: int
    over: int
    value: str | None                                   # None: count rows
    select: Callable[[DataFrame], DataFrame]             # flows -> the rows and columns it needs
    units: Callable[[DataFrame], DataFrame]              # those rows, pre-counted per instant
    summarise: Callable[[DataFrame, DataFrame], DataFrame]   # units, incidents -> typed incident table
    alerts: Callable[[DataFrame], DataFrame]             # that table -> alert rows
    typed: Callable[[DataFrame], DataFrame]              # keys, times, peak and counts of incidents -> that table
    cell: str | None = None                              # what an incident lists: a column of ``select``
    numeric: bool = False                                # its cells are numbers
    limit: int = 20                                      # and how many are listed
    tile_windows: int = 16

    def found(self, units: DataFrame) -> DataFrame:
        return incidents(units, self.keys, self.window_us, self.over, self.value)

    def metric_units(self, rows: DataFrame) -> DataFrame:
        return to_units(rows, [*self.keys, self.value] if self.value else self.keys)

    def table(self, flows: DataFrame) -> DataFrame:
        """Typed incidents of a whole flow table."""
        # Metric and summary read the counted rows from storage, not from the flows.
        rows = by_volume(self.select(flows), self.keys)
        units = stored(self.units(only_busy(rows, self.keys, self.over, self.value)), f"units-{self.name}")
        return self.summarise(units, self.found(units))
