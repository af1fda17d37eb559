"""Incremental detection over a stream of flows, with the results of a batch run.

Each micro-batch advances a watermark (greatest event time seen, minus a delay).  Rows become
final when the watermark passes them; a row later than the watermark goes to the table ``late``.

* Sliding rules run as keyed state (``keyed``) over the final rows, which a second streaming query
  of each rule reads as they are written.
* Whole-capture rules append mergeable partial results per batch (sums, and moments of the time
  between connections) and are combined when read: no result reads the flows again.
* The forest trains once on the first ``warmup_rows`` final rows, in time order, and is stored;
  all rows are scored against it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, Settings, us
from ..operators.containment import endpoints, listed, static_entries
from ..operators.incidents import to_units
from ..plans import alerts as algebra, beaconing, blocklist, forest, off_hours
from ..plans.brute_force import brute_force_rule
from ..plans.dns_tunnel import dns_rule
from ..plans.engine import Detection
from ..plans.features import flow_features
from ..plans.port_scan import port_scan_rule
from ..plans.sliding import SlidingRule
from ..schema import FLOW
from .keyed import FOREVER, NEVER, SlidingStream
from .state import StateTable

CELL = "n bigint, bytes bigint, first_us bigint, last_us bigint"
PROGRESS = ("watermark_us bigint, greatest_us bigint, rows bigint, late bigint, final_rows bigint, "
            "has_model boolean")
SLIDING = ("port_scan", "brute_force", "dns")
EVERY = (*SLIDING, "blocklist", "beaconing", "time_of_day")


class StreamDetector:
    """State and steps of one detection stream; ``folder`` is on shared storage."""

    def __init__(self, spark: SparkSession, folder: str, settings: Settings = DEFAULT, delay_s: float = 60.0,
                 feeds: DataFrame | None = None, names: Iterable[str] = EVERY, ml: bool = True):
        self.spark, self.folder, self.s, self.feeds, self.ml = spark, folder, settings, feeds, ml
        self.delay_us = us(delay_s)
        self.names = tuple(names)
        makers = {"port_scan": port_scan_rule, "brute_force": brute_force_rule, "dns": dns_rule}
        self.rules: list[SlidingRule] = [makers[n](settings) for n in SLIDING if n in self.names]
        self.context_us = 2 * us(settings.forest.window_s) if ml else 0

        def table(name: str, schema) -> StateTable:
            return StateTable(spark, folder, name, schema)

        self.progress = table("progress", PROGRESS)
        self.flows = table("flows", FLOW)                  # final rows, once each
        self.late = table("late", FLOW)                    # rows that came after the watermark
        self.carry = table("carry", FLOW)                  # rows still needed as context or not final
        self.sliding = [SlidingStream(spark, folder, r, 0.0) for r in self.rules]
        self.beacon_tiles = table("beacon_tiles", beaconing.TILE)
        self.beacon_ports = table("beacon_ports", "src_ip string, dst_ip string, dst_port int")
        self.off_cells = table("off_hours", f"src_ip string, dst_ip string, dst_port int, {CELL}")
        self.listed_cells = table("listed", "bad_ip string, outbound boolean, static_hit boolean, source string, "
                                            f"peer_ip string, dst_port int, {CELL}")
        self.anomalies = table("anomalies", FLOW.simpleString()[7:-1].replace(":", " ").replace(",", ", ") +
                               ", src_conn_freq bigint, src_bytes_window bigint, pair_conn_freq bigint, "
                               "anomaly_score double, is_anomaly boolean")

    # -- stream ------------------------------------------------------------------------------

    def start(self, stream: DataFrame, **options: str) -> StreamingQuery:
        """Run over a stream of FLOW rows; ``options`` go to the writer."""
        writer = stream.writeStream.foreachBatch(self.process).option(
            "checkpointLocation", f"{self.folder}/query")
        once = options.pop("availableNow", None)
        for key, value in options.items():
            writer = writer.option(key, value)
        return (writer.trigger(availableNow=True) if once else writer).start()

    def last(self, batch: int) -> dict:
        rows = self.progress.read(batch).collect()         # one row
        if rows:
            return rows[0].asDict()
        return {"watermark_us": NEVER, "greatest_us": NEVER, "rows": 0, "late": 0, "final_rows": 0, "has_model": False}

    def process(self, batch_rows: DataFrame, batch: int) -> None:
        """One micro-batch: idempotent given the state of the batch before."""
        before = self.last(batch - 1)
        mark = before["watermark_us"]
        pending = self.carry.read(batch - 1)
        seen = batch_rows.select(*[f.name for f in FLOW.fields])
        facts = seen.agg(F.max("ts_us").alias("greatest"), F.count(F.lit(1)).alias("rows"),
                         F.count_if(F.col("ts_us") <= mark).alias("late")).first()
        if facts["late"]:
            self.late.write(seen.where(F.col("ts_us") <= mark), batch)
        if facts["rows"] == 0:
            greatest, new_mark = before["greatest_us"], mark
        else:
            greatest = max(before["greatest_us"], facts["greatest"])
            new_mark = max(mark, greatest - self.delay_us)
        self._advance(pending.unionByName(seen.where(F.col("ts_us") > mark)), batch, before, mark, new_mark,
                      greatest, facts["rows"], facts["late"])

    def finish(self, batch: int | None = None) -> Detection:
        """Close everything: treat all rows as final and combine the results."""
        last = self.latest() if batch is None else batch
        before = self.last(last)
        if before["watermark_us"] < FOREVER:
            self._advance(self.carry.read(last), last + 1, before, before["watermark_us"], FOREVER,
                          before["greatest_us"], 0, 0)
        return self.result()

    def latest(self) -> int:
        return self.progress.read_all(with_batch=True).agg(F.max("batch")).first()[0]

    # -- one step ----------------------------------------------------------------------------

    def _advance(self, pending: DataFrame, batch: int, before: dict, mark: int, new_mark: int, greatest: int,
                 rows: int, late: int) -> None:
        known = self.carry.write(pending.where(F.col("ts_us") > max(mark - self.context_us, NEVER)), batch)
        is_final = (F.col("ts_us") > mark) & (F.col("ts_us") <= new_mark)
        # Written once, as the keyed queries take every new file for new rows.
        final = self.flows.write_once(known.where(is_final), batch)
        final_rows = before["final_rows"] + final.count()
        if "beaconing" in self.names:
            # The rows of a batch are a stretch of time of each pair, so its summaries follow those before.
            units = to_units(final, beaconing.PAIR)
            self.beacon_tiles.write(beaconing.tile_summaries(units, self.s.beaconing), batch)
            self.beacon_ports.write(final.select(*beaconing.PAIR, "dst_port").distinct(), batch)
        if "time_of_day" in self.names:
            self.off_cells.write(off_hours.off_hours_cells(final, self.s.off_hours), batch)
        if "blocklist" in self.names:
            hosts = listed(endpoints(final), static_entries(self.spark, self.s.blocklist), self.feeds)
            self.listed_cells.write(blocklist.listed_cells(final, hosts), batch)
        has_model = self._score(known.where(F.col("ts_us") <= new_mark), batch, before, mark, final_rows, new_mark == FOREVER)
        self.progress.write(self.spark.createDataFrame(
            [(new_mark, greatest, before["rows"] + rows, before["late"] + late, final_rows, has_model)],
            PROGRESS), batch)

    def slide(self) -> None:
        """Take the final rows written so far through the keyed query of every sliding rule."""
        final = self.spark.readStream.schema(FLOW).parquet(f"{self.flows.path}/batch=*")
        for query in [one.start(final) for one in self.sliding]:
            query.awaitTermination()

    def _score(self, known: DataFrame, batch: int, before: dict, mark: int, final_rows: int, last: bool) -> bool:
        path = f"{self.folder}/model"
        if not self.ml:
            return False
        if not before["has_model"]:
            if final_rows < self.s.forest.min_rows or (final_rows < self.s.forest.warmup_rows and not last):
                return False
            features = flow_features(self.flows.read_all(), self.s)
            features = StateTable(self.spark, self.folder, "warmup", features.schema).write(features, batch)
            # The first warmup_rows by time, however the batches were cut.
            first = features.orderBy("ts_us", "seq").limit(self.s.forest.warmup_rows)
            model = forest.fit(first, self.s, min(final_rows, self.s.forest.warmup_rows))
            forest.score_and_cut(first, model, self.s)
            model.save(self.spark, path)
            scored = forest.score_and_cut(features, model, self.s, refit=False)
        else:
            model = forest.ForestModel.load(self.spark, path)
            features = flow_features(known, self.s).where(F.col("ts_us") > mark)
            scored = forest.score_and_cut(features, model, self.s, refit=False)
        self.anomalies.write(scored.where("is_anomaly"), batch)
        return True

    # -- results -----------------------------------------------------------------------------

    def result(self) -> Detection:
        """Alerts so far, combined as in a batch run."""
        self.slide()
        parts = [one.rule.alerts(one.incidents()) for one in self.sliding]
        if "blocklist" in self.names:
            parts.append(blocklist.blocklist_alerts_from(self.listed_cells.read_all(), self.s))
        if "time_of_day" in self.names:
            parts.append(off_hours.off_hours_alerts_from(self.off_cells.read_all(), self.s))
        if "beaconing" in self.names:
            parts.append(beaconing.beacon_alerts_from(self.beacon_tiles.read_all(), self.beacon_ports.read_all(), self.s))
        rules = algebra.merge_duplicates(algebra.union_alerts(parts), self.s).drop("merged")
        out = Detection(rules, rules)
        if self.ml and self.last(self.latest())["has_model"]:
            model = forest.ForestModel.load(self.spark, f"{self.folder}/model")
            found = forest.anomaly_alerts(self.anomalies.read_all(), model, self.s)
            out.ml = algebra.corroborate(algebra.merge_duplicates(found, self.s).drop("merged"), rules)
            out.alerts = rules.unionByName(out.ml)
        elif self.ml:
            out.warnings.append("ML detection skipped: too few records to train")
        out.alerts = algebra.in_time_order(out.alerts)
        return out

    def counters(self) -> DataFrame:
        """Rows read, late and final after each batch."""
        return self.progress.read_all(with_batch=True)
