"""Exact largest integer inner products through a pivot-distance index.

A coordinate sqrt(M - |x|^2), with M the largest squared norm, turns the largest inner product into
the smallest distance: |q' - x'|^2 = |q|^2 + M - 2 q.x. Every vector is keyed by its nearest pivot
and its distance to it; per pivot, sorted distances are cut into annuli. By the triangle inequality
no vector of an annulus [a, b] around p is nearer to q than max(a - d(q,p), d(q,p) - b). A query
opens its annuli in order of this bound, first a few, then all that its k-th best score so far has
not excluded; inside them scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .neighbours import merged, vectors
from .tables import stored

PIVOTS = 16
RINGS = 16
#: Vectors (in expectation; drawn by hash) that pivots and annuli are fitted on; all are indexed.
SAMPLE = 4096
BLOCK = 1024           # vectors of a block of an annulus
QUERIES = 512          # queries of a tile
FIRST = 4              # annuli a query opens at first


@dataclass
class Space:
    """Pivots and annuli of the vectors of one dimension."""
    centres: np.ndarray                     # (pivots, dim + 1)
    edges: np.ndarray                       # (pivots, rings - 1): inner borders of the annuli
    most: float                             # M
    ids: np.ndarray                         # the sample
    x: np.ndarray
    annuli: list[tuple[int, int, float, float]] = field(default_factory=list)   # (pivot, ring, nearest, farthest)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(self.most - np.square(x).sum(axis=1), 0))[:, None]], axis=1)

    def distances(self, points: np.ndarray) -> np.ndarray:
        return np.stack([np.sqrt(np.square(points - c).sum(axis=1)) for c in self.centres], axis=1)

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = self.distances(self.lifted(x))
        pivot = d.argmin(axis=1)
        near = d[np.arange(len(x)), pivot]
        return pivot, (self.edges[pivot] <= near[:, None]).sum(axis=1), near


def fit(ids: np.ndarray, x: np.ndarray, most: float, pivots: int = PIVOTS, rings: int = RINGS) -> Space:
    """A few k-means steps on the sample, from evenly spread rows; annuli of equal counts."""
    space = Space(np.empty((0, x.shape[1] + 1)), np.empty((0, rings - 1)), most, ids, x)
    points = space.lifted(x)
    space.centres = np.unique(points, axis=0)
    space.centres = space.centres[np.linspace(0, len(space.centres) - 1, min(pivots, len(space.centres))).astype(int)]
    for _ in range(8):
        of = space.distances(points).argmin(axis=1)
        space.centres = np.stack([points[of == i].mean(axis=0) if (of == i).any() else c for i, c in enumerate(space.centres)])
    d = space.distances(points)
    of = d.argmin(axis=1)
    parts = np.arange(1, rings) / rings
    space.edges = np.stack([np.quantile(d[of == i, i], parts) if (of == i).any() else np.zeros(rings - 1) for i in range(len(space.centres))])
    return space


def scores(queries: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products as longs: by doubles where they are exact, by longs beyond."""
    reach = float(np.abs(queries).max(initial=0)) * float(np.abs(x).max(initial=0)) * queries.shape[1]
    if reach < 2.0**53:
        return (queries @ x.T).astype(np.int64)
    return queries.astype(np.int64) @ x.astype(np.int64).T


def _rows(batch: pa.RecordBatch, column: int, dim: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _by_dimension(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column(column).to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, batch.filter(pa.array(dims == dim))


def _index(rows: DataFrame, pivots: int, rings: int, sample: int) -> dict[int, Space]:
    norm = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("most")).collect()
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(v) for r in sizes for v in (r["dim"], min(1.0, sample / r["n"]))])
    drawn = rows.where(F.xxhash64("id", "x").cast("double") / 2.0**64 + 0.5 <= share[F.col("dim")]).groupBy("dim", "x").agg(
        F.min("id").alias("id")).orderBy("id").collect()
    out = {}
    for r in sizes:
        mine = [d for d in drawn if d["dim"] == r["dim"]]
        if mine:
            out[r["dim"]] = fit(np.array([d["id"] for d in mine]), np.array([d["x"] for d in mine], dtype=float), r["most"], pivots, rings)
    return out


def _keyed(rows: DataFrame, spaces: dict[int, Space]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_dimension(batch, 2):
                pivot, ring, near = spaces[dim].keys(_rows(part, 1, dim))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pivot, pa.int32()), pa.array(ring, pa.int32()), pa.array(near)],
                                                 names=["id", "x", "dim", "pivot", "ring", "near"])
    return rows.mapInArrow(run, "id long, x array<double>, dim int, pivot int, ring int, near double")


def _visits(queries: DataFrame, spaces: dict[int, Space], k: int, first: int | None, after: int) -> DataFrame:
    """queries (id, x, dim, best) -> one row for each query and annulus it opens: those not excluded
    by its k-th best score, in order of their bound, from number ``after`` to ``first``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_dimension(batch, 2):
                space, x, ids = spaces[dim], _rows(part, 1, dim), part.column(0).to_numpy()
                known = scores(x, space.x)
                known[ids[:, None] == space.ids[None, :]] = np.iinfo(np.int64).min
                best = np.partition(known, -k, axis=1)[:, -k] if known.shape[1] >= k else np.full(len(ids), np.iinfo(np.int64).min)
                best = np.maximum(best, part.column(3).fill_null(np.iinfo(np.int64).min).to_numpy())
                length = np.square(x).sum(axis=1)
                bounded = best > np.iinfo(np.int64).min
                far = np.where(bounded, np.sqrt(np.maximum(length + space.most - 2.0 * np.where(bounded, best, 0), 0)), np.inf)
                points = np.concatenate([x, np.zeros((len(x), 1))], axis=1)
                to_pivot = space.distances(points)
                pivot, ring, low, high = (np.array(c) for c in zip(*space.annuli))
                least = np.maximum(low[None, :] - to_pivot[:, pivot], to_pivot[:, pivot] - high[None, :])
                slack = 1e-6 + 1e-9 * (np.sqrt(length) + np.sqrt(space.most))
                order = np.argsort(least, axis=1, kind="stable")
                open_ = np.take_along_axis(least <= (far + slack)[:, None], order, axis=1)
                open_[:, :after] = False
                if first is not None:
                    open_[:, first:] = False
                row, at = np.nonzero(open_)
                annulus = order[row, at]
                yield pa.RecordBatch.from_arrays(
                    [part.column(2).take(pa.array(row)), pa.array(pivot[annulus], pa.int32()), pa.array(ring[annulus], pa.int32()),
                     part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(best[row])],
                    names=["dim", "pivot", "ring", "id", "x", "best"])
    return queries.select("id", "x", "dim", "best").mapInArrow(run, "dim int, pivot int, ring int, id long, x array<double>, best long")


def _searched(visits: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """Tiles of the queries and the blocks of an annulus -> candidates (query_id, query_row, vec_id, score)."""
    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        return pd.DataFrame({"dim": [part["dim"].iloc[0]], "pivot": [part["pivot"].iloc[0]], "ring": [part["ring"].iloc[0]],
                             "query_ids": [part["id"].to_numpy("<i8").tobytes()], "bests": [part["best"].to_numpy("<i8").tobytes()],
                             "query_xs": [np.stack(part["x"].to_numpy()).astype("<f8").tobytes()]})
    sizes = visits.groupBy("dim", "pivot", "ring").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("of"))
    dealt = visits.join(sizes, ["dim", "pivot", "ring"]).withColumn("slice", F.pmod(F.xxhash64("id"), F.col("of"))).drop("of")
    asked = dealt.groupBy("dim", "pivot", "ring", "slice").applyInPandas(
        pack, "dim int, pivot int, ring int, query_ids binary, bests binary, query_xs binary")
    tiles = asked.join(held, ["dim", "pivot", "ring"]).select("dim", "query_ids", "bests", "query_xs", "ids", "xs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, *parts in zip(*batch.columns):
                n = dim.as_py()
                query_ids, best, q, ids, x = (np.frombuffer(p.as_buffer(), t) for p, t in zip(parts, ("<i8", "<i8", "<f8", "<i8", "<f8")))
                found = scores(q.reshape(-1, n), x.reshape(-1, n))
                good = (found >= best[:, None]) & (query_ids[:, None] != ids[None, :])
                row, column = np.nonzero(good)
                score = found[row, column]
                order = np.lexsort((ids[column], -score, row))
                row, column, score = row[order], column[order], score[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                keep = rank < k
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[row[keep]]), pa.array(ids[column[keep]]), pa.array(score[keep])],
                                                 names=["query_id", "vec_id", "score"])
    return tiles.mapInArrow(run, "query_id long, vec_id long, score long").withColumn("query_row", F.lit(0).cast("long"))


def nearest(table: DataFrame, k: int = 10, every: int = 100, pivots: int = PIVOTS, rings: int = RINGS, sample: int = SAMPLE) -> DataFrame:
    """table (vec_id, embedding, ...) -> (query_id, rank, vec_id, score): for each vector whose id is
    divisible by ``every`` the k largest inner products of floor(1024 * x) with all others, ties to
    the smaller id. Vectors null, empty or with null or non-finite components take no part; vectors
    of other dimensions than the query's are no candidates. Of rows that repeat an id each is a
    candidate; a query is asked once for its id, with the smallest of its vectors."""
    spark = table.sparkSession
    whole = vectors(table, zero=True).select("id", F.transform("x", lambda v: F.floor(v * 1024).cast("double")).alias("x"))
    rows = stored(whole.withColumn("dim", F.size("x")), "integers")
    spaces = _index(rows, pivots, rings, sample)
    if not spaces:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    keyed = stored(_keyed(rows, spaces), "keyed")
    annuli = keyed.groupBy("dim", "pivot", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("low"), F.max("near").alias("high"))
    for r in annuli.orderBy("dim", "pivot", "ring").collect():          # at most pivots x rings for a dimension
        spaces[r["dim"]].annuli.append((r["pivot"], r["ring"], r["low"], r["high"]))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        return pd.DataFrame({"dim": [part["dim"].iloc[0]], "pivot": [part["pivot"].iloc[0]], "ring": [part["ring"].iloc[0]],
                             "ids": [part["id"].to_numpy("<i8").tobytes()], "xs": [np.stack(part["x"].to_numpy()).astype("<f8").tobytes()]})
    cut = keyed.join(annuli.select("dim", "pivot", "ring", F.ceil(F.col("n") / BLOCK).alias("of")), ["dim", "pivot", "ring"])
    held = stored(cut.withColumn("part", F.pmod(F.xxhash64("id", "x"), F.col("of"))).select("dim", "pivot", "ring", "part", "id", "x").groupBy(
        "dim", "pivot", "ring", "part").applyInPandas(pack, "dim int, pivot int, ring int, ids binary, xs binary"), "annuli")
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).groupBy("id", "dim").agg(F.min("x").alias("x"))
    asked = stored(asked.select("id", "dim", "x", F.lit(None).cast("long").alias("best")), "asked")
    near = stored(_searched(_visits(asked, spaces, k, FIRST, 0), held, k), "first-annuli")
    bests = merged(near, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("best"))
    again = asked.drop("best").join(bests, "id", "left")
    return merged(near.unionByName(_searched(_visits(again, spaces, k, None, FIRST), held, k)), k)
