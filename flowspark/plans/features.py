"""Per-row traffic features over a trailing window, exact to the row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..config import DEFAULT, Settings, us
from ..operators import scan
from ..session import stored


def _trailing(rows: DataFrame, keys: Sequence[str], window_us: int, sums: dict[str, str | int], size: int) -> DataFrame:
    """``rows`` plus the ``sums`` (of a column or a constant) over each row and the rows of its keys that
    precede it, in (time, seq) order, and lie at most one window back.

    Every row enters at its time and leaves one microsecond after the window; the enter marks carry
    the rows, so nothing is joined back to them.  The marks are scanned by volume: neither a hot key
    nor a hot instant meets one task.
    """
    carried = [c for c in rows.columns if c not in (*keys, "seq")]
    types = dict(rows.dtypes)
    amounts = {name: F.coalesce(F.lit(v) if isinstance(v, int) else F.col(v), F.lit(0)).cast("bigint") for name, v in sums.items()}
    enter = F.struct(F.col("ts_us").alias("_at"), F.lit(1).alias("_enters"), *[F.col(c) for c in carried],
                     *[a.alias(f"{name}_own") for name, a in amounts.items()])
    leave = F.struct((F.col("ts_us") + window_us + 1).alias("_at"), F.lit(0).alias("_enters"),
                     *[F.lit(None).cast(types[c]).alias(c) for c in carried], *[(-a).alias(f"{name}_own") for name, a in amounts.items()])
    marks = rows.select(*keys, "seq", F.explode(F.array(enter, leave)).alias("_m")).select(*keys, "seq", "_m.*")
    scanned = scan.running(marks, keys, ["_at", "_enters", "seq"], {name: ("sum", f"{name}_own") for name in sums},
                           scan.parts_for(rows, 2 * size))
    return scanned.where("_enters = 1").select(*rows.columns, *sums)


def flow_features(flows: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Flows plus ``src_conn_freq, src_bytes_window, pair_conn_freq``.

    A row counts itself and the rows before it, in (time, seq) order, whose time lies at most one
    window back.  Two scans give them, one of the pairs and one of the sources.
    """
    window = us(s.forest.window_s)
    rows = stored(flows, "flows")
    size = rows.count()                                 # from the files' footers
    pairs = _trailing(rows, ["src_ip", "dst_ip"], window, {"pair_conn_freq": 1}, size)
    both = _trailing(pairs, ["src_ip"], window, {"src_conn_freq": 1, "src_bytes_window": "packet_length"}, size)
    return both.select(*flows.columns, "src_conn_freq", "src_bytes_window", "pair_conn_freq")
