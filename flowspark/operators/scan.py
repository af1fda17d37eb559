"""Running values along the rows of a key, for keys of any size.

A window partitioned by a key puts the key's rows into one task.  Here rows are range-partitioned by
(key, order), so a busy key is cut into as many parts as its volume asks for, wherever in time its rows
lie.  Each part is scanned once and stored with its local values; the values at the two ends of each
part, two rows a part, then give what every part must add from the parts before it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import stored

#: Stands for null inside a task; no time, count or number of bytes comes near it.
_NULL = np.iinfo(np.int64).min
#: Rows of one part, about: what a task sorts does not grow with the input.
PART_ROWS = 500_000
#: What a fold keeps of the rows so far; "before" leaves out the row itself.
FOLDS = ("sum", "max", "min", "max_before", "lag", "next", "last")


def parts_for(df: DataFrame, rows: int) -> int | None:
    """Parts that so many rows ask for; None leaves it to the session, whose number is large enough."""
    parts = -(-rows // PART_ROWS)
    return parts if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def _differs(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are equal."""
    a, b = column[1:], column[:-1]
    same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
    return ~(same | (a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False)))


def _joined(op: str, a, b):
    """The value of two stretches of rows, one after the other."""
    if a is None or b is None:
        return a if b is None else b
    return a + b if op == "sum" else min(a, b) if op == "min" else b if op == "last" else max(a, b)


class _Stretch:
    """Scans the sorted rows of one part, batch by batch."""

    def __init__(self, keys: int, folds: Sequence[tuple[str, int]]):
        self.keys, self.folds = keys, folds
        self.key: list | None = None                      # of the last row scanned
        self.state: list = []
        self.segments = 0

    @staticmethod
    def _last(column: pa.Array, segment: np.ndarray, before: pa.Scalar | None) -> pa.Array:
        """The last known value up to each row of its segment; ``before`` goes on in segment 0."""
        known = column.is_valid().to_numpy(zero_copy_only=False)
        at = np.maximum.accumulate(np.where(known, np.arange(len(column)), -1))
        lost = (at < 0) | (segment[np.maximum(at, 0)] != segment)
        held = pa.concat_arrays([column, pa.array([None if before is None else before.as_py()], column.type)])
        at[lost] = len(column)
        return held.take(pa.array(at, mask=lost & (segment > 0) if before is not None else lost))

    def rows(self, batch: pa.RecordBatch, behind: pa.RecordBatch | None) -> list[pa.Array]:
        """The folds of the rows of batch and whether they belong to the part's first key;
        ``behind`` is the row that follows them."""
        n = batch.num_rows
        new = np.zeros(n, dtype=bool)
        for i in range(self.keys):
            new[1:] |= _differs(batch.column(i))
        first = [batch.column(i)[0].as_py() for i in range(self.keys)]
        new[0] = self.key is None or first != self.key
        last = [batch.column(i)[n - 1].as_py() for i in range(self.keys)]
        goes_on = behind is not None and [behind.column(i)[0].as_py() for i in range(self.keys)] == last
        segment = np.cumsum(new) - 1 + (not new[0])        # 0: the key of the batch before goes on
        begins = np.flatnonzero(new)
        out, state = [], []
        for at, (op, column) in enumerate(self.folds):
            if op == "last":
                found = self._last(batch.column(column), segment, None if new[0] else self.state[at])
                state.append(found[n - 1])
                out.append(found)
                continue
            if op == "opened":
                start, gap = (batch.column(i).cast(pa.int64()).to_numpy() for i in column)
                found = _opened(start, reach, segment, gap, None if new[0] else self.state[at])
                state.append(int(found[-1]))
                out.append(pa.array(found))
                continue
            values = batch.column(column).cast(pa.int64())
            known = values.is_valid().to_numpy(zero_copy_only=False)
            values = values.fill_null(_NULL).to_numpy()
            before = None if new[0] else self.state[at]
            if op == "sum":
                plain = np.where(known, values, 0)
                total = np.cumsum(plain)
                base = total[begins] - plain[begins]
                if not new[0]:
                    base = np.concatenate(([-before], base))
                found = total - base[segment]
                state.append(int(found[-1]))
            elif op in ("max", "min", "max_before"):
                if op == "min":
                    values = np.where(known, -values, _NULL)
                run = pd.Series(values).groupby(segment).cummax().to_numpy()
                if not new[0]:
                    own = slice(0, begins[0] if len(begins) else n)
                    run[own] = np.maximum(run[own], -before if op == "min" and before != _NULL else before)
                found = run
                if op == "max_before":
                    found = np.concatenate(([_NULL if new[0] else before], run[:-1]))
                    found[begins] = _NULL
                    reach = found
                elif op == "min":
                    found = np.where(run == _NULL, _NULL, -run)
                state.append(int(run[-1]) if op != "min" else int(found[-1]))
            elif op == "lag":
                found = np.concatenate(([_NULL if new[0] else before], values[:-1]))
                found[begins] = _NULL
                state.append(int(values[-1]))
            else:
                after = behind.column(column).cast(pa.int64())[0].as_py() if goes_on else None
                found = np.append(values[1:], _NULL if after is None else after)
                found[begins[begins > 0] - 1] = _NULL
                state.append(_NULL)
            out.append(pa.array(found, pa.int64(), mask=found == _NULL))
        head = np.full(n, self.segments == 0) & (segment == 0) if not new[0] else (segment == 0) & (self.key is None)
        self.segments += len(begins) - (self.key is None)
        self.key, self.state = last, state
        return [*out, pa.array(head)]


def _opened(start: np.ndarray, reach: np.ndarray, segment: np.ndarray, gap: np.ndarray, before: int | None) -> np.ndarray:
    """The start of the interval that opened each row's cluster; reach: the greatest end before the row."""
    breaks = (reach == _NULL) | (start - gap > reach)
    at = np.maximum.accumulate(np.where(breaks, np.arange(len(start)), -1))
    return np.where(at < 0, _NULL if before is None else before, start[np.maximum(at, 0)])


def _ends(edges: list, keys: Sequence[str], folds: dict[str, tuple[str, str]]) -> list[tuple]:
    """From the first and last row of each part, what the rows of its first key must add from before
    and what follows its last row."""
    parts: dict[int, list] = {}
    for row in edges:
        parts.setdefault(row["part"], [None, None])
        if row["is_first"]:
            parts[row["part"]][0] = row
        if row["is_last"]:
            parts[row["part"]][1] = row
    order, out = sorted(parts), []
    key, state = None, {}
    for place, part in enumerate(order):
        first, last = parts[part]
        follower = parts[order[place + 1]][0] if place + 1 < len(order) else None
        met = key is not None and [first[k] for k in keys] == key
        goes_on = follower is not None and [follower[k] for k in keys] == [last[k] for k in keys]
        out.append((part, *[(follower[column] if goes_on else None) if op == "next" else state[name] if met else None
                            for name, (op, column) in folds.items()]))
        whole = {}
        for name, (op, column) in folds.items():
            own = last[column] if op in ("lag", "next") else last[name]
            if op == "max_before":
                own = _joined("max", own, last[column])
            whole[name] = _joined(op, state[name], own) if met and last["head"] and op != "lag" else own
        key, state = [last[k] for k in keys], whole
    return out


def _local(df: DataFrame, keys: Sequence[str], order: Sequence[str], folds: dict[str, tuple[str, str]], parts: int | None = None) -> DataFrame:
    """The stored parts: df with the folds inside each part, ``part``, ``head`` (a row of the part's
    first key), ``is_first`` and ``is_last`` (row of the part)."""
    names = [*keys, *[c for c in df.columns if c not in keys]]
    steps = [(op, names.index(column) if isinstance(column, str) else [names.index(c) for c in column]) for op, column in folds.values()]
    ranged = df.select(*names).repartitionByRange(*([parts] if parts else []), *keys, *order).sortWithinPartitions(*keys, *order)
    added = [*folds, "head", "is_first", "is_last", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, part, started = _Stretch(len(keys), steps), TaskContext.get().partitionId(), False
        held: pa.RecordBatch | None = None

        def close(batch: pa.RecordBatch, behind: pa.RecordBatch | None) -> pa.RecordBatch:
            n = batch.num_rows
            found = stretch.rows(batch, behind)
            first, last = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
            first[0], last[-1] = not started, behind is None
            return pa.RecordBatch.from_arrays([*batch.columns, *found, pa.array(first), pa.array(last), pa.array(np.full(n, part, dtype=np.int32))],
                                              names=[*batch.schema.names, *added])
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield close(held, batch.slice(0, 1))
                started = True
            held = batch
        if held is not None:
            yield close(held, None)
    types = dict(df.dtypes)
    schema = ", ".join([f"`{n}` {types[n]}" for n in names] + [f"`{n}` {types[c] if op == 'last' else 'bigint'}" for n, (op, c) in folds.items()]
                       + ["head boolean, is_first boolean, is_last boolean, part int"])
    return stored(ranged.mapInArrow(run, schema), "scan")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], folds: dict[str, tuple[str, str]], parts: int | None = None) -> DataFrame:
    """df with a column for each fold: name -> (one of FOLDS, an integer column; "last" takes any type).
    ``parts``: how many parts to scan, where the caller knows the volume.

    Values follow the rows of a key in the given order: "sum", "max", "min" and "last" (the last value
    that is not null) up to and with the row, "max_before" without it, "lag" and "next" of the
    neighbouring rows; nulls count for nothing, and what has no row is null.  Rows that tie in the order come in any order, side by side."""
    keys = list(keys)
    unknown = [op for op, _ in folds.values() if op not in FOLDS]
    if unknown:
        raise ValueError(f"no such fold: {', '.join(unknown)}")
    local = _local(df, keys, order, folds, parts)
    needed = dict.fromkeys([*keys, *[c for _, c in folds.values()], *folds, "part", "head", "is_first", "is_last"])
    edges = local.where("is_first OR is_last").select(*needed).collect()          # two rows a part
    types = dict(df.dtypes)
    schema = ", ".join(["part int"] + [f"_{name} {types[c] if op == 'last' else 'bigint'}" for name, (op, c) in folds.items()])
    added = df.sparkSession.createDataFrame(_ends(edges, keys, folds), schema)
    rows = local.join(F.broadcast(added), "part", "left")                          # one row a part
    out = []
    for name, (op, _) in folds.items():
        here, there = F.col(name), F.col(f"_{name}")
        if op == "sum":
            value = F.when(F.col("head"), here + F.coalesce(there, F.lit(0))).otherwise(here)
        elif op in ("max", "max_before"):
            value = F.when(F.col("head"), F.greatest(here, there)).otherwise(here)
        elif op == "min":
            value = F.when(F.col("head"), F.least(here, there)).otherwise(here)
        elif op == "last":
            value = F.when(F.col("head"), F.coalesce(here, there)).otherwise(here)
        elif op == "lag":
            value = F.when(F.col("is_first"), F.coalesce(here, there)).otherwise(here)
        else:
            value = F.when(F.col("is_last"), F.coalesce(here, there)).otherwise(here)
        out.append(value.alias(name))
    return rows.select(*df.columns, *out)


def clusters(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: str) -> DataFrame:
    """df with ``cluster``, which tells apart the unions of a key's intervals that overlap or lie at
    most ``gap`` (a column that is the same for all rows of a key) apart: the start of the first one.

    A part takes its first key for a new one; where an earlier part reaches up to a cluster's start,
    the cluster goes on from there, and only clusters of the part's first key can."""
    keys = list(keys)
    local = _local(df, keys, [start, end], {"_reach": ("max_before", end), "cluster": ("opened", (start, gap))})
    edges = local.where("is_first OR is_last").select(*dict.fromkeys([*keys, end, gap, "_reach", "cluster", "part", "head", "is_first", "is_last"])).collect()
    firsts, lasts = ({r["part"]: r for r in edges if r[flag]} for flag in ("is_first", "is_last"))      # two rows a part
    out, key, reach, opened = [], None, None, None
    for part in sorted(firsts):
        first, last = firsts[part], lasts[part]
        met = key is not None and [first[k] for k in keys] == key
        out.append((part, reach if met else None, opened if met else None))
        goes_on = met and last["head"]
        if not (goes_on and last["cluster"] <= reach + last[gap]):
            opened = last["cluster"]
        own = _joined("max", last["_reach"], last[end])
        key, reach = [last[k] for k in keys], max(reach, own) if goes_on else own
    added = df.sparkSession.createDataFrame(out, "part int, _before bigint, _opened bigint")
    goes_on = F.col("head") & (F.col("cluster") <= F.col("_before") + F.col(gap))
    return local.join(F.broadcast(added), "part", "left").select(                       # one row a part
        *df.columns, F.when(goes_on, F.col("_opened")).otherwise(F.col("cluster")).alias("cluster"))
