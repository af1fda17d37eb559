"""Document quality by Bradley-Terry ranking: P(a is better than b) = logistic(score a - score b).

A score is a weighted sum of text features; the weights minimise the logistic loss on feature
differences of preference pairs (a labelled good document over a labelled bad one). All labelled documents
take part: they are dealt to small groups, a group gives all its pairs. The threshold is the quantile of
their scores at the share of bad ones among them. Only sums, a row a task, reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.quantiles import exact_quantiles
from .tables import stored

#: Documents of one label in a group, about: the pairs of a group are one small matrix.
GROUP = 128
RIDGE = 1e-3
STEPS = 25
_FOLDS, _HELD = 3, 1
#: Sums count whole units of 2^-40, so that they do not depend on the order of what is added.
_UNIT = 40

_UPPER, _LOWER = slice(65, 91), slice(97, 123)
_PLAIN = b" \n.,;:'\"-?()"
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum() and b not in _PLAIN]] = True


def features(text: bytes | None) -> np.ndarray:
    """Features of a whole UTF-8 text; a null one counts as empty."""
    text = text or b""
    count = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    words = text.split()
    n, size = max(len(words), 1), max(len(text), 1)
    letters = max(int(count[_UPPER].sum() + count[_LOWER].sum()), 1)
    lines = [x for x in text.split(b"\n") if x]
    shares = np.array([
        count[_PUNCTUATION].sum() / size, count[33] / size, count[124] / size, count[48:58].sum() / size,
        count[_UPPER].sum() / letters, count[10] / size, count[128:].sum() / size,
        sum(map(eq, words, words[1:])) / n, 1 - len(set(words)) / n, 1 - len(set(lines)) / max(len(lines), 1)])
    return np.concatenate([shares, np.log1p(100 * shares), [np.log1p(len(words)), np.log1p(size / n), float(not words)]])


N_FEATURES = len(features(b""))


@dataclass
class Ranking:
    """score(x) = logistic(weights . (x - centre) / scale - threshold): 0.5 at the threshold."""
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    threshold: float = 0.0

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) / self.scale * self.weights).sum(axis=-1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.threshold, -30, 30)))


def _summed(df: DataFrame, width: int, vectors: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of the vectors (rows x width) that are made of the batches of df."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for batch in batches:
            units = np.rint(np.ldexp(vectors(batch), _UNIT))
            high = np.floor(np.ldexp(units, -32))
            halves = (part.astype(np.int64).sum(axis=0).tolist() for part in (high, units - np.ldexp(high, 32)))
            total = [t + (h << 32) + rest for t, h, rest in zip(total, *halves)]
        yield pa.RecordBatch.from_arrays([pa.array([list(map(str, total))], pa.list_(pa.string()))], names=["total"])
    rows = [list(map(int, r["total"])) for r in df.mapInArrow(run, "total array<string>").collect()]      # one a task
    return np.array([sum(column) / 2**_UNIT for column in zip(*rows)]) if rows else np.zeros(width)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)


def _pull(good: np.ndarray, bad: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Number, slope and curve of the loss of all pairs of a good and a bad document."""
    lost = 1 / (1 + np.exp(np.clip((good @ weights)[:, None] - bad @ weights, -30, 30)))
    bend = lost * (1 - lost)
    cross = good.T @ bend @ bad
    curve = (good.T * bend.sum(axis=1)) @ good + (bad.T * bend.sum(axis=0)) @ bad - cross - cross.T
    return np.concatenate([[lost.size], lost.sum(axis=1) @ good - lost.sum(axis=0) @ bad, curve.ravel()])


def _groups(marked: DataFrame, good: int, bad: int) -> DataFrame:
    """``better, worse``: features of the documents of each group, by doc_id. Either label has as many parts as its
    documents ask for; the parts of the rarer one go round, so that every document meets some of the other label."""
    parts = {label: -(-n // GROUP) for label, n in ((True, good), (False, bad))}
    own = F.when(F.col("good"), parts[True]).otherwise(parts[False])
    dealt = marked.select("*", F.explode(F.sequence(
        F.pmod(F.xxhash64("doc_id", F.lit(11)), own), F.lit(max(parts.values()) - 1).cast("bigint"), own.cast("bigint"))).alias("group"))

    def side(which) -> F.Column:
        rows = F.sort_array(F.collect_list(F.when(which, F.struct("doc_id", "x"))))
        return F.flatten(F.transform(rows, lambda r: r["x"]))
    return dealt.groupBy("group").agg(side(F.col("good")).alias("better"), side(~F.col("good")).alias("worse")).drop("group")


def fit(marked: DataFrame, ridge: float = RIDGE) -> Ranking:
    """Newton steps on the logistic loss of the pairs of all groups of ``marked`` (doc_id, x, good; stored rows: they
    are read many times). Without documents of both kinds there is nothing to prefer: every score is then 0.5."""
    facts = marked.agg(F.count_if("good"), F.count_if(~F.col("good"))).first()
    good, bad = facts[0], facts[1]
    if not good or not bad:
        return Ranking(np.zeros(N_FEATURES), np.zeros(N_FEATURES), np.ones(N_FEATURES))

    def powers(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch.column(0))
        return np.concatenate([x, x * x], axis=1)
    means = _summed(marked.select("x"), 2 * N_FEATURES, powers) / (good + bad)
    centre, spread = means[:N_FEATURES], np.maximum(means[N_FEATURES:] - means[:N_FEATURES] ** 2, 0)
    model = Ranking(np.zeros(N_FEATURES), centre, np.sqrt(spread) + 1e-9)
    groups = stored(_groups(marked, good, bad), "quality-groups")
    for _ in range(STEPS):
        now = replace(model)

        def pulls(batch: pa.RecordBatch) -> np.ndarray:
            sides = zip(*[[(np.array(row.as_py()).reshape(-1, N_FEATURES) - now.centre) / now.scale for row in c] for c in batch.columns])
            return np.array([_pull(better, worse, now.weights) for better, worse in sides]).reshape(batch.num_rows, -1)
        sums = _summed(groups, 1 + N_FEATURES + N_FEATURES**2, pulls)
        slope = sums[1:1 + N_FEATURES] / sums[0] - ridge * model.weights
        curve = sums[1 + N_FEATURES:].reshape(N_FEATURES, N_FEATURES) / sums[0] + ridge * np.eye(N_FEATURES)
        step = np.linalg.solve(curve, slope)
        model.weights = model.weights + step
        if np.abs(step).max() < 1e-6:
            break

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.strength(_matrix(batch.column(0))))], names=["strength"])
    ranked = stored(marked.select("x").mapInArrow(strengths, "strength double"), "quality-strengths")
    model.threshold = exact_quantiles(ranked, ["strength"], (bad / (good + bad),)).first()["quantile"]
    return model


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(_FOLDS)) == _HELD, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Ranking:
    """Fit on all labelled documents outside the held-out third. A document's label is the mean of its
    label rows (none, if that is a draw); of repeated document rows one is taken."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("q")).where("q <> 0.5").select(
        "doc_id", (F.col("q") > 0.5).alias("good"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])
    # Features meet the labels, so that no text is shuffled.
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(
        F.col("doc_id").isNotNull() & ~held_out("doc_id")).mapInArrow(run, "doc_id long, x array<double>")
    return fit(stored(found.join(known, "doc_id").groupBy("doc_id", "good").agg(F.min("x").alias("x")), "quality-marked"))


def _scores(model: Ranking, texts: pa.Array) -> np.ndarray:
    x = np.fromiter(chain.from_iterable(features(t.as_py()) for t in texts.cast(pa.binary())), dtype=float,
                    count=len(texts) * N_FEATURES)
    return model.score(x.reshape(len(texts), N_FEATURES))


def scored(docs: DataFrame, model: Ranking) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of docs. Null and empty texts
    are scored by their features; null doc_ids stay null and count as not held out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(model, batch.column(1)))], names=["doc_id", "score"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def kept(docs: DataFrame, model: Ranking) -> DataFrame:
    """The rows of docs, all columns, that are scored 0.5 or more."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, batch.column(at)) >= 0.5))
    return docs.mapInArrow(run, docs.schema)
