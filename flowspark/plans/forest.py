"""Isolation forest (Liu, Ting, Zhou, ICDM 2008): fit on Spark-drawn samples, score on Spark.

Training rows are drawn by hash, so a re-run or a lost executor draws the same ones.  The model
is bounded by trees x (2 x max_samples - 1) nodes whatever the data; it is the only thing that
reaches the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import DEFAULT, ML_FEATURES, Forest, Settings
from ..functions.text import seen_text
from ..operators.firsts import top_per_group
from ..operators.quantiles import exact_quantiles
from ..schema import as_alerts
from ..session import stored
from .features import flow_features

PAIR = ["src_ip", "dst_ip"]
NODE = "tree int, node int, feature int, threshold double, left int, right int, length double"


def draw_samples(features: DataFrame, p: Forest, rows: int) -> DataFrame:
    """``tree, features...``: for each tree, min(max_samples, rows) distinct rows, uniformly from all
    rows.

    A tree takes the rows with its smallest hashes out of about 1.5 times as many candidates.  A row
    is a candidate of ``copies`` trees on average: the whole part for certain, one more by hash,
    each another tree, so about trees x (1.5 x max_samples + 64) rows meet whatever the input.
    """
    def unit(*cols) -> Column:
        return (F.pmod(F.xxhash64(*cols), F.lit(1 << 53).cast("bigint"))) / F.lit(float(1 << 53))

    copies = p.trees * min(1.0, (1.5 * p.max_samples + 64) / max(rows, 1))
    steps = [i for i in range(1, p.trees + 1) if math.gcd(i, p.trees) == 1]      # i, 2i, ... visit every tree
    n = F.lit(int(copies)) + (unit(F.lit(p.seed), F.lit("more"), "seq") < copies % 1).cast("int")
    first = F.pmod(F.xxhash64(F.lit(p.seed), F.lit("first"), "seq"), F.lit(p.trees))
    step = F.get(F.array(*[F.lit(i) for i in steps]), F.pmod(F.xxhash64(F.lit(p.seed), F.lit("step"), "seq"), F.lit(len(steps))).cast("int"))
    drawn = (features.select("seq", *ML_FEATURES).withColumn("_n", n).where("_n > 0")
             .withColumns({"_first": first, "_step": step})
             .withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
             .withColumn("tree", F.pmod(F.col("_first") + F.col("_i") * F.col("_step"), F.lit(p.trees)).cast("int"))
             .withColumn("draw", unit(F.lit(p.seed), "tree", "seq")).drop("_n", "_first", "_step", "_i"))
    return top_per_group(drawn, ["tree"], [F.asc("draw"), F.asc("seq")], p.max_samples)


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        full = 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n
    return np.where(n > 2, full, np.where(n == 2, 1.0, 0.0))


def grow_tree(tree: int, x: np.ndarray, seed: int) -> pd.DataFrame:
    """Random splits down to single rows, equal rows or the depth limit."""
    rng = np.random.default_rng([seed, tree])
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes: list[list] = []
    todo = [(np.arange(len(x)), 0, -1, 0)]
    while todo:
        rows, depth, parent, slot = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][slot] = me
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        open_ = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(open_):
            nodes.append([tree, me, -1, 0.0, me, me, depth + float(average_path(len(rows)))])
            continue
        f = int(rng.choice(open_))
        cut = rng.uniform(low[f], high[f])
        goes_left = x[rows, f] <= cut
        nodes.append([tree, me, f, cut, 0, 0, 0.0])
        todo.append((rows[~goes_left], depth + 1, me, 5))
        todo.append((rows[goes_left], depth + 1, me, 4))
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "length"])


class TooFewRecords(ValueError):
    """A table too small to train on."""


@dataclass
class ForestModel:
    """Nodes of all trees, flattened, with the baseline used to explain alerts."""

    nodes: pd.DataFrame
    sample_size: int
    offset: float = 0.0
    median: dict[str, float] | None = None
    spread: dict[str, float] | None = None

    def arrays(self) -> dict:
        n = self.nodes.sort_values(["tree", "node"], kind="stable").reset_index(drop=True)
        roots = np.flatnonzero(n["node"].to_numpy() == 0)
        base = np.repeat(roots, np.diff(np.append(roots, len(n))))
        leaf = n["feature"].to_numpy() < 0
        # A leaf asks for any feature and leads to itself on both sides.
        return {"roots": roots, "feature": np.where(leaf, 0, n["feature"].to_numpy()).astype(np.intp),
                "threshold": n["threshold"].to_numpy(float),
                "children": np.column_stack([n["right"].to_numpy() + base, n["left"].to_numpy() + base]).astype(np.intp).ravel(),
                "length": n["length"].to_numpy(float), "norm": float(average_path(self.sample_size))}

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes, NODE).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        facts = [(k, f, float(v)) for k, d in (("median", self.median), ("spread", self.spread))
                 for f, v in (d or {}).items()]
        facts += [("offset", "", float(self.offset)), ("sample_size", "", float(self.sample_size))]
        spark.createDataFrame(facts, "kind string, name string, value double").coalesce(1).write.mode(
            "overwrite").parquet(f"{path}/facts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ForestModel":
        nodes = spark.read.parquet(f"{path}/nodes").toPandas()
        facts = spark.read.parquet(f"{path}/facts").toPandas()

        def named(kind: str) -> dict:
            part = facts[facts["kind"] == kind]
            return dict(zip(part["name"], part["value"]))

        return cls(nodes, int(named("sample_size")[""]), named("offset")[""], named("median"), named("spread"))


def score(features: DataFrame, model: ForestModel, out: str = "raw_score") -> DataFrame:
    """Add the sample score, -1 (most anomalous) .. 0, in Arrow batches."""
    shared = features.sparkSession.sparkContext.broadcast(model.arrays())

    @F.pandas_udf("double")
    def sample_score(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        m = shared.value
        x = np.column_stack([v.to_numpy(float) for v in (a, b, c, d)])
        total = np.zeros(len(x))
        values, row = x.ravel(), np.arange(len(x), dtype=np.intp) * x.shape[1]
        for root in m["roots"]:
            at = np.full(len(x), root, dtype=np.intp)
            while True:
                left = values.take(row + m["feature"].take(at)) <= m["threshold"].take(at)
                below = m["children"].take(2 * at + left)
                if np.array_equal(below, at):
                    break
                at = below
            total += m["length"].take(at)
        return pd.Series(-np.exp2(-total / len(m["roots"]) / m["norm"]))

    return features.withColumn(out, sample_score(*[F.col(c).cast("double") for c in ML_FEATURES]))


def baseline(features: DataFrame) -> DataFrame:
    """``name, median, spread`` per feature; spread is the interquartile range, at least 1."""
    q = exact_quantiles(features, ML_FEATURES, (0.25, 0.5, 0.75))

    def at(p: float) -> Column:
        return F.max(F.when(F.col("prob") == p, F.col("quantile")))

    return q.groupBy("name").agg(at(0.5).alias("median"), F.greatest(at(0.75) - at(0.25), F.lit(1.0)).alias("spread"))


def fit(features: DataFrame, s: Settings = DEFAULT, rows: int | None = None) -> ForestModel:
    """Train on all of ``features`` (callers pass a stored frame: it is read several times)."""
    p = s.forest
    rows = features.count() if rows is None else rows
    if rows < p.min_rows:
        raise TooFewRecords(f"need at least {p.min_rows} records to train, got {rows}")
    names, seed = list(ML_FEATURES), p.seed

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["draw", "seq"])
        return grow_tree(int(key[0]), pdf[names].to_numpy(float), seed)

    nodes = draw_samples(features, p, rows).groupBy("tree").applyInPandas(build, NODE).toPandas()
    facts = {r["name"]: r for r in baseline(features).collect()}      # four rows
    model = ForestModel(nodes, min(p.max_samples, rows),
                        median={k: r["median"] for k, r in facts.items()},
                        spread={k: r["spread"] for k, r in facts.items()})
    return model


def score_and_cut(features: DataFrame, model: ForestModel, s: Settings = DEFAULT, refit: bool = True) -> DataFrame:
    """Scored rows with ``anomaly_score`` (below 0: outside the learned boundary) and ``is_anomaly``.

    When ``refit``, the boundary is the contamination quantile of these very scores.
    """
    scored = score(features, model)
    if refit:
        scored = stored(scored, "scored")
        model.offset = exact_quantiles(scored, ["raw_score"], (s.forest.contamination,)).collect()[0]["quantile"]
    return (scored.withColumn("anomaly_score", F.col("raw_score") - F.lit(model.offset)).drop("raw_score")
            .withColumn("is_anomaly", F.col("anomaly_score") < 0))


def with_explanation(df: DataFrame, median: dict[str, float], spread: dict[str, float]) -> DataFrame:
    """Add ``top_feature, top_feature_z, top_feature_value``: the greatest robust deviation, the
    first feature on ties."""
    # Ordered by |z|, then by earlier position.
    best = F.array_max(F.array(*[
        F.struct(F.abs((F.col(f) - F.lit(float(median[f]))) / F.lit(float(spread[f]))).alias("size"),
                 F.lit(-i).alias("place"), F.lit(f).alias("name"),
                 ((F.col(f) - F.lit(float(median[f]))) / F.lit(float(spread[f]))).alias("z"),
                 F.col(f).cast("bigint").alias("value"), F.lit(float(median[f])).alias("median"))
        for i, f in enumerate(ML_FEATURES)]))
    return (df.withColumn("_best", best)
            .withColumns({"top_feature": F.col("_best.name"), "top_feature_z": F.col("_best.z"),
                          "top_feature_value": F.col("_best.value"), "top_feature_median": F.col("_best.median")})
            .drop("_best"))


def anomaly_groups(scored: DataFrame, model: ForestModel, s: Settings = DEFAULT) -> DataFrame:
    """Anomalous rows grouped per pair, described by their worst row."""
    p = s.forest
    bad = scored.where("is_anomaly")
    worst = F.min_by(F.struct(*ML_FEATURES, "anomaly_score"), F.struct("anomaly_score", "ts_us", "seq"))
    groups = bad.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("anomalous_records"), worst.alias("worst"),
        F.max("packet_length").alias("max_packet_length"), F.max("src_conn_freq").alias("max_src_conn_freq"),
        F.slice(F.sort_array(F.collect_set("dst_port")), 1, s.port_limit).alias("dst_ports"),   # <= 65,536
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    groups = with_explanation(groups.select("*", "worst.*"), model.median, model.spread)
    level = (F.when(F.col("anomaly_score") <= p.high_at, "HIGH")
             .when(F.col("anomaly_score") <= p.medium_at, "MEDIUM").otherwise("LOW"))
    return groups.withColumn("severity", level)


def anomaly_alerts(scored: DataFrame, model: ForestModel, s: Settings = DEFAULT) -> DataFrame:
    return as_alerts(anomaly_groups(scored, model, s).select(
        F.lit("ML_ANOMALY").alias("alert_type"), "severity",
        F.col("src_ip").alias("source_ip"), F.col("dst_ip").alias("dest_ip"),
        F.format_string("Traffic deviates from baseline: %s=%s (baseline median %s); %d anomalous record(s)",
                        "top_feature", F.format_number("top_feature_value", 0),
                        F.format_number("top_feature_median", 0), "anomalous_records").alias("description"),
        "first_us", "last_us",
        F.to_json(F.struct(
            "anomalous_records", "dst_ports", seen_text(F.col("first_us")).alias("first_seen"),
            seen_text(F.col("last_us")).alias("last_seen"), "max_packet_length", "max_src_conn_freq",
            F.round("anomaly_score", 4).alias("min_anomaly_score"), "top_feature",
            F.round("top_feature_z", 2).alias("top_feature_robust_z"), "top_feature_value")).alias("details"),
        F.array("src_ip", "dst_ip").alias("key_parts"),
    ))


def detect_anomalies(flows: DataFrame, s: Settings = DEFAULT) -> tuple[DataFrame, DataFrame, ForestModel]:
    """``(alerts, scored rows, model)`` with a model trained on ``flows``."""
    features = stored(flow_features(flows, s), "features")
    model = fit(features, s)
    scored = score_and_cut(features, model, s)
    return anomaly_alerts(scored, model, s), scored, model
