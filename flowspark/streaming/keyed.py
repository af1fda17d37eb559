"""Sliding rules as keyed state: a key keeps what its next rows can still need, and nothing else.

Rows are counted per (key, instant, cell) before they are dealt out.  A key's state holds the counted
rows of the last window (and those that the watermark has not passed), the open incident, and the cells
of that incident: ports of a scan, resolvers of a tunnel.  Rows become final in time order as the
watermark passes them; an incident is reported once a later row begins another, or nothing can extend
it any more.

A call of Spark for each key costs far more than the few rows that most keys have, so a state is held
for each of ``BUCKETS`` hashes of the key.  All keys of a bucket are trimmed at once; only keys with more
rows than the rule allows, and those with an open incident, are walked one by one.  A timer goes through
the bucket when one of its keys is two windows past its last row.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..plans.sliding import SlidingRule

FOREVER = 1 << 62
NEVER = -(1 << 62)
#: Fixed for the life of a checkpoint.
BUCKETS = 4096
#: A bucket's timer fires at most so many times a window.
TIMERS = 8
STATE = "mark_us long, timer_ms long, body binary"
KEY_STATE = "mark_us long, body binary"
INCIDENT = "start_us long, end_us long, peak long, events long, bytes long, cells long, first array<string>"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class KeyState:
    """Counted rows in time order, the open incident and its cells; ``mark_us``: all up to it is final."""

    window_us: int
    over: int
    distinct: bool                                       # the metric counts cells, not rows
    limit: int                                           # cells listed in a report
    numeric: bool = False                                # cells are listed in the order of numbers
    mark_us: int = NEVER
    ts: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    cell: np.ndarray = field(default_factory=lambda: np.empty(0, object))
    n: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    bytes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    open: list[int] | None = None                        # start, end, peak
    cells: dict[str | None, list[int]] = field(default_factory=dict)

    def add(self, ts: np.ndarray, cell: np.ndarray, n: np.ndarray, size: np.ndarray) -> None:
        """Rows later than the mark; earlier ones come too late for the key and are left out."""
        on_time = ts > self.mark_us
        parts = [np.concatenate([a, b[on_time]]) for a, b in zip((self.ts, self.cell, self.n, self.bytes), (ts, cell, n, size))]
        order = np.argsort(parts[0], kind="stable")
        self.ts, self.cell, self.n, self.bytes = (x[order] for x in parts)

    def _metric(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """At instants t of rows: the metric of the window that ends there, and its oldest row's time."""
        enter = leave = self.n
        if self.distinct:
            code = np.unique(self.cell.astype(str), return_inverse=True)[1]
            order = np.lexsort((self.ts, code))
            far = np.append((code[order][1:] != code[order][:-1]) | (np.diff(self.ts[order]) > self.window_us), True)
            enter, leave = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
            leave[order] = far
            enter[order] = np.append(True, far[:-1])
        came, went = (np.concatenate(([0], np.cumsum(x))) for x in (enter, leave))
        low = np.searchsorted(self.ts, t - self.window_us, "left")
        return came[np.searchsorted(self.ts, t, "right")] - went[low], self.ts[low]

    def _absorb(self, after: int, upto: int) -> None:
        """Add the rows of after < time <= upto to the open incident's cells."""
        for i in range(*np.searchsorted(self.ts, [after, upto], "right").tolist()):
            held = self.cells.setdefault(self.cell[i], [0, 0])
            held[0] += int(self.n[i])
            held[1] += int(self.bytes[i])

    def _report(self) -> tuple:
        order = sorted((c for c in self.cells if c is not None), key=int if self.numeric else None)
        out = (*self.open, sum(n for n, _ in self.cells.values()), sum(b for _, b in self.cells.values()), len(order), order[:self.limit])
        self.open, self.cells = None, {}
        return out

    def advance(self, mark_us: int) -> list[tuple]:
        """Make all rows up to the mark final; the incidents that ended, as INCIDENT rows."""
        out = []
        if mark_us > self.mark_us:
            t = np.unique(self.ts[(self.ts > self.mark_us) & (self.ts <= mark_us)])
            if len(t):
                metric, left = self._metric(t)
                hit = metric > self.over
                t, metric, left = t[hit], metric[hit], left[hit]
            if len(t):
                before = np.append(self.open[1] if self.open else NEVER, t[:-1])
                begins = np.flatnonzero(left > before + self.window_us)
                ends = np.append(begins[1:], len(t)) if len(begins) else np.empty(0, np.int64)
                grown = int(begins[0]) if len(begins) else len(t)
                if grown:                                        # the first hits extend what is open
                    self._absorb(self.open[1], int(t[grown - 1]))
                    self.open = [self.open[0], int(t[grown - 1]), max(self.open[2], int(metric[:grown].max()))]
                for a, b in zip(begins.tolist(), ends.tolist()):
                    if self.open:
                        out.append(self._report())
                    self.open = [int(left[a]), int(t[b - 1]), int(metric[a:b].max())]
                    self._absorb(self.open[0] - 1, self.open[1])
            self.mark_us = mark_us
        if self.open and self.open[1] + 2 * self.window_us < mark_us:
            out.append(self._report())
        # Later windows reach back one window; later hits may extend the incident over what follows its end.
        kept = self.ts > min(mark_us - self.window_us, self.open[1] if self.open else FOREVER)
        self.ts, self.cell, self.n, self.bytes = self.ts[kept], self.cell[kept], self.n[kept], self.bytes[kept]
        return out

    def body(self) -> bytes:
        return pickle.dumps((self.ts, self.cell, self.n, self.bytes, self.open, self.cells))

    def load(self, mark_us: int, body: bytes) -> KeyState:
        self.mark_us = mark_us
        self.ts, self.cell, self.n, self.bytes, self.open, self.cells = pickle.loads(body)
        return self


def _rows(keys: tuple[str, ...], found: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(found, columns=[*keys, *[c.split()[0] for c in INCIDENT.split(", ")]])


class Bucket:
    """The keys of one hash: their counted rows, and the open incident (with its cells) of each key that has one."""

    def __init__(self, rule: SlidingRule):
        self.keys, self.names = list(rule.keys), [*rule.keys, "ts_us", "cell", "n", "bytes"]
        self.make = (rule.window_us, rule.over, rule.value is not None, rule.limit, rule.numeric)
        self.mark_us = NEVER
        self.rows: pd.DataFrame | None = None
        self.open: dict[tuple, tuple[list[int], dict]] = {}

    def body(self) -> bytes:
        return pickle.dumps(({c: self.rows[c].to_numpy() for c in self.names} if self.rows is not None else None, self.open))

    def load(self, mark_us: int, body: bytes) -> Bucket:
        self.mark_us = mark_us
        rows, self.open = pickle.loads(body)
        self.rows = None if rows is None else pd.DataFrame(rows)
        return self

    def add(self, frames: Iterator[pd.DataFrame]) -> None:
        """Rows later than the mark; earlier ones come too late and are left out."""
        new = [frame.loc[frame["ts_us"] > self.mark_us, self.names] for frame in frames]
        parts = [part for part in (self.rows, *new) if part is not None and len(part)]
        self.rows = pd.concat(parts, ignore_index=True) if parts else None

    def _held(self, key: tuple, part: pd.DataFrame | None) -> KeyState:
        held = KeyState(*self.make, mark_us=self.mark_us)
        if part is not None:
            part = part.sort_values("ts_us", kind="stable")
            held.ts, held.n, held.bytes = (part[c].to_numpy(np.int64) for c in ("ts_us", "n", "bytes"))
            held.cell = part["cell"].to_numpy(object)
        held.open, held.cells = self.open.get(key, (None, {}))
        return held

    def _by_key(self, rows: pd.DataFrame | None) -> Iterator[tuple[tuple, pd.DataFrame]]:
        return iter(()) if rows is None else iter(rows.groupby(self.keys, sort=False, dropna=False))

    def states(self) -> Iterator[tuple[tuple, KeyState]]:
        """Every key with its state."""
        for key, part in self._by_key(self.rows):
            yield key, self._held(key, part)
        known = set() if self.rows is None else set(self.rows[self.keys].itertuples(index=False, name=None))
        for key in self.open.keys() - known:
            yield key, self._held(key, None)

    def advance(self, mark_us: int) -> list[tuple]:
        """Make all rows up to the mark final; the incidents that ended, as keys and INCIDENT."""
        out, opened, kept, walk = [], {}, [], None
        idle = set(self.open)
        if self.rows is not None:
            group = self.rows.groupby(self.keys, sort=False, dropna=False)
            # No window holds more than all rows of the key.
            size = group["ts_us"].transform("size") if self.make[2] else group["n"].transform("sum")
            busy = (size > self.make[1]).to_numpy()
            if self.open:
                busy |= pd.Index(self.rows[self.keys].itertuples(index=False, name=None), tupleize_cols=False).isin(list(self.open))
            kept.append(self.rows[~busy & (self.rows["ts_us"] > mark_us - self.make[0]).to_numpy()])
            walk = self.rows[busy]

        def take(key: tuple, held: KeyState) -> None:
            out.extend((*key, *found) for found in held.advance(mark_us))
            if held.open:
                opened[key] = held.open, held.cells
            if len(held.ts):
                kept.append(pd.DataFrame({**dict(zip(self.keys, key)), "ts_us": held.ts, "cell": held.cell, "n": held.n, "bytes": held.bytes}))
        for key, part in self._by_key(walk):
            idle.discard(key)
            take(key, self._held(key, part))
        for key in idle:
            take(key, self._held(key, None))
        kept = [part for part in kept if len(part)]
        self.mark_us, self.open = max(self.mark_us, mark_us), opened
        self.rows = pd.concat(kept, ignore_index=True)[self.names] if kept else None
        return out

    def ends_us(self) -> int | None:
        """When the first key is two windows past its last row; None if there is no key."""
        last = [end for (_, end, _), _ in self.open.values()]
        if self.rows is not None:
            last.append(int(self.rows.groupby(self.keys, sort=False, dropna=False)["ts_us"].max().min()))
        return min(last) + 2 * self.make[0] if last else None


class SlidingProcessor(StatefulProcessor):
    """The buckets between micro-batches, each with a timer while it has keys."""

    def __init__(self, rule: SlidingRule):
        # Parts of the rule are plans, which do not go to the workers.
        self.rule = replace(rule, **{f: None for f in ("select", "units", "summarise", "alerts", "typed")})

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("key", STATE)

    def _step(self, frames: Iterator[pd.DataFrame], mark_us: int) -> pd.DataFrame:
        held, timer = Bucket(self.rule), None
        if self.state.exists():
            mark, timer, body = self.state.get()
            held.load(mark, body)
        held.add(frames)
        found = _rows(self.rule.keys, held.advance(mark_us))
        ends = held.ends_us()
        if ends is not None:
            step = max(1, self.rule.window_us // 1000 // TIMERS)
            ends = -(-max(ends // 1000 + 1, mark_us // 1000 + 1) // step) * step
        if ends != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if ends is not None:
                self.handle.registerTimer(ends)
        if ends is None:
            self.state.clear()
        else:
            self.state.update((held.mark_us, ends, held.body()))
        return found

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield self._step(rows, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and self.state.get()[1] <= expiredTimerInfo.getExpiryTimeInMs():
            yield self._step(iter(()), timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def counted(flows: DataFrame, rule: SlidingRule) -> DataFrame:
    """The rows a rule needs, counted per (key, instant, cell) inside each task, before any shuffle."""
    keys = list(rule.keys)
    chosen = rule.select(flows)
    cell = F.col(rule.cell).cast("string") if rule.cell else F.lit(None).cast("string")
    size = F.col("packet_length") if "packet_length" in chosen.columns else F.lit(0)
    by = [*keys, "cell", "ts_us"]
    rows = chosen.select(*keys, cell.alias("cell"), "ts_us", F.lit(1).cast("long").alias("n"), F.coalesce(size.cast("long"), F.lit(0)).alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = pa.Table.from_batches([batch]).group_by(by).aggregate([("n", "sum"), ("bytes", "sum")])
            yield from groups.select([*by, "n_sum", "bytes_sum"]).rename_columns([*by, "n", "bytes"]).combine_chunks().to_batches()
    types = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in by) + ", n long, bytes long")


def _schema(rule: SlidingRule, flows: DataFrame) -> str:
    types = dict(flows.dtypes)
    return ", ".join([f"{k} {types[k]}" for k in rule.keys] + [INCIDENT])


def incident_stream(flows: DataFrame, rule: SlidingRule, delay_s: float) -> DataFrame:
    """A stream of flows -> the stream of ended incidents (keys and INCIDENT)."""
    at = counted(flows, rule).withColumn("at", F.timestamp_micros("ts_us")).withWatermark("at", f"{round(delay_s * 1e6)} microseconds")
    bucket = F.pmod(F.xxhash64(*rule.keys), F.lit(BUCKETS)).cast("int")
    return at.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(
        SlidingProcessor(rule), _schema(rule, flows), "append", "eventTime")


class SlidingStream:
    """The keyed query of one rule below ``folder``: ended incidents go to Parquet, open ones stay state."""

    def __init__(self, spark: SparkSession, folder: str, rule: SlidingRule, delay_s: float):
        self.spark, self.rule, self.delay_s = spark, rule, delay_s
        self.out, self.checkpoint = f"{folder}/incidents_{rule.name}", f"{folder}/keyed_{rule.name}"

    def start(self, flows: DataFrame) -> StreamingQuery:
        """Take in what has arrived."""
        self.types = flows
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
        return incident_stream(flows, self.rule, self.delay_s).writeStream.format("parquet").option("path", self.out).option(
            "checkpointLocation", self.checkpoint).trigger(availableNow=True).start()

    def ended(self) -> DataFrame:
        """Incidents reported so far."""
        return self.spark.read.schema(_schema(self.rule, self.types)).parquet(self.out)

    def buckets(self) -> DataFrame:
        """(key, value) of every bucket that has state."""
        return self.spark.read.format("statestore").option("path", self.checkpoint).option("stateVarName", "key").load()

    def _of_buckets(self, make: Callable[[Bucket], pd.DataFrame], schema: str) -> DataFrame:
        """A batch job over the stored buckets."""
        rule = SlidingProcessor(self.rule).rule

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row in frame.itertuples(index=False):
                    yield make(Bucket(rule).load(row.mark_us, row.body))
        return self.buckets().select("value.mark_us", "value.body").mapInPandas(run, schema)

    def states(self) -> DataFrame:
        """(key, value) of every key that has state; a value is KEY_STATE."""
        keys, types = self.rule.keys, dict(self.types.dtypes)

        def each(held: Bucket) -> pd.DataFrame:
            return pd.DataFrame([(*key, state.mark_us, state.body()) for key, state in held.states()], columns=[*keys, "mark_us", "body"])
        return self._of_buckets(each, ", ".join([*[f"{k} {types[k]}" for k in keys], KEY_STATE])).select(
            F.struct(*keys).alias("key"), F.struct("mark_us", "body").alias("value"))

    def unfinished(self) -> DataFrame:
        """The incidents that the stored states give if no more rows come."""
        keys = self.rule.keys
        return self._of_buckets(lambda held: _rows(keys, held.advance(FOREVER)), _schema(self.rule, self.types))

    def incidents(self) -> DataFrame:
        return self.rule.typed(self.ended().unionByName(self.unfinished()))
