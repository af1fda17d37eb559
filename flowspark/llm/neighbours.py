"""Largest-inner-product neighbours by a block matrix join with quantisation bounds.

Vectors are packed into blocks of rows; a tile is a block of queries against a block of candidates.
Each vector x is held as int8 values with a scale, so that x = scale * values + rest with a known
norm of the rest. A tile's integer products give every inner product within a bound (Cauchy-Schwarz
on the rests); pairs whose upper bound misses the k-th largest lower bound of their query can't be
among its k nearest. The surviving pairs are recomputed in double precision from the original
vectors, and the k best of each tile are merged by a heap per query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .tables import stored

#: Vectors in a block of candidates and of queries; a tile's products take their product x 4 bytes.
CANDIDATES = 8192
QUERIES = 256


def usable(vector: Column, zero: bool = False) -> Column:
    """Neither null nor empty, no null or non-finite component, and (unless zero) not all zeros."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.lit(True) if zero else F.exists(vector, lambda x: x != 0)
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & sound & some, F.lit(False))


def vectors(table: DataFrame, zero: bool = False) -> DataFrame:
    """(id, x) of the vectors that take part; rows without vec_id take none."""
    x = F.col("embedding").cast("array<double>")
    return table.select(F.col("vec_id").cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & usable(F.col("x"), zero))


def blocks(rows: DataFrame, size: int, salt: int) -> DataFrame:
    """rows (id, x) -> (block, dim, n, ids, xs): rows dealt to blocks of about ``size`` by hash,
    each dimension apart, as little-endian longs and doubles."""
    counts = rows.groupBy(F.size("x").alias("dim")).agg(F.ceil(F.count(F.lit(1)) / size).alias("of"))
    dealt = rows.withColumn("dim", F.size("x")).join(counts, "dim").select(
        "dim", F.pmod(F.xxhash64("id", "x", F.lit(salt)), F.col("of")).alias("block"), "id", "x")

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        return pd.DataFrame({"block": [part["block"].iloc[0]], "dim": [part["dim"].iloc[0]], "n": [len(part)],
                             "ids": [part["id"].to_numpy("<i8").tobytes()], "xs": [np.stack(part["x"].to_numpy()).astype("<f8").tobytes()]})
    return dealt.groupBy("dim", "block").applyInPandas(pack, "block long, dim int, n int, ids binary, xs binary")


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values (as float32, for the matrix product), scale, norm of the rest, norm of the vector."""
    scale = np.maximum(np.abs(x).max(axis=1), np.finfo(float).tiny) / 127
    q = np.rint(x / scale[:, None])
    rest = np.linalg.norm(x - q * scale[:, None], axis=1)
    return q.astype(np.float32), scale, rest, np.linalg.norm(x, axis=1)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, each by the same sequence of double operations."""
    return np.sum(a * b, axis=1)


def tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: (its position, ids, exact products) of its k best candidates in the tile."""
    (qa, sa, ra, na), (qb, sb, rb, nb) = quantised(queries), quantised(x)
    about = (qa @ qb.T).astype(np.float64) * sa[:, None] * sb[None, :]
    # q.x - about = q.rest(x) + rest(q).(x - rest(x)); float32 sums of the products are exact for up
    # to 1,000 dimensions and lose at most the last term beyond.
    bound = na[:, None] * rb[None, :] + ra[:, None] * (nb + rb)[None, :] + queries.shape[1] * 2.0**-22 * na[:, None] * nb[None, :]
    own = query_ids[:, None] == ids[None, :]
    low = np.where(own, -np.inf, about - bound)
    cut = np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(query_ids), -np.inf)
    row, column = np.nonzero(~(about + bound < cut[:, None]) & ~own)
    score = np.empty(len(row))
    for at in range(0, len(row), 1 << 16):
        score[at:at + (1 << 16)] = exact(queries[row[at:at + (1 << 16)]], x[column[at:at + (1 << 16)]])
    order = np.lexsort((ids[column], -score, row))
    row, column, score = row[order], column[order], score[order]
    starts = np.searchsorted(row, np.arange(len(query_ids) + 1))
    for i, (a, b) in enumerate(zip(starts, starts[1:])):
        b = min(b, a + k)
        yield i, ids[column[a:b]], score[a:b]


def nearest(table: DataFrame, k: int = 20, every: int = 20, queries: int = QUERIES, candidates: int = CANDIDATES) -> DataFrame:
    """table (vec_id, embedding, ...) -> (query_id, rank, vec_id, score): the k largest inner
    products of each vector whose id is divisible by ``every`` with all others, ties to the
    smaller id. Vectors null, empty, zero or with null or non-finite components take no part, as
    neither do rows without id; vectors of another dimension than the query's are no candidates.
    Rows that repeat an id are candidates (and queries) each."""
    rows = stored(vectors(table), "vectors")
    held = stored(blocks(rows, candidates, 1), "candidates")
    asked = stored(blocks(rows.where(F.pmod("id", F.lit(every)) == 0), queries, 2), "queries")
    # Every query block visits every candidate block of its dimension: an equality join on the block.
    of = held.groupBy("dim").agg(F.max("block").alias("last"))
    visits = asked.join(of, "dim").select(
        "dim", F.col("block").alias("query_block"), F.col("ids").alias("query_ids"), F.col("xs").alias("query_xs"),
        F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("block"))
    tiles = visits.join(held, ["dim", "block"]).select("dim", "query_block", "query_ids", "query_xs", "ids", "xs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, block, *parts in zip(*batch.columns):
                query_ids, xs, ids, x = (np.frombuffer(p.as_buffer(), t) for p, t in zip(parts, ("<i8", "<f8", "<i8", "<f8")))
                n = dim.as_py()
                made = list(tile(query_ids, xs.reshape(-1, n), ids, x.reshape(-1, n), k))
                sizes = [len(i) for _, i, _ in made]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(query_ids, sizes)), pa.array(np.repeat(np.arange(len(made)), sizes) + (block.as_py() << 20) + (n << 48)),
                     pa.array(np.concatenate([i for _, i, _ in made])), pa.array(np.concatenate([s for *_, s in made]))],
                    names=["query_id", "query_row", "vec_id", "score"])
    found = tiles.mapInArrow(run, "query_id long, query_row long, vec_id long, score double")
    return merged(found, k)


def merged(found: DataFrame, k: int) -> DataFrame:
    """(query_id, query_row, vec_id, score) -> the k best rows of each query row with their rank.
    Rows arrive sorted by query; a heap of k holds the best so far, whatever their number."""
    kind = found.schema["score"].dataType.simpleString()
    rows = found.select("query_id", "query_row", "vec_id", "score").repartition("query_id", "query_row").sortWithinPartitions("query_id", "query_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heap = None, []

        def close(out: list) -> None:
            for rank, (score, minus) in enumerate(sorted(heap, reverse=True), 1):
                out.append((now[0], rank, -minus, score))
        for batch in batches:
            out: list[tuple] = []
            for query, row, vec, score in zip(*[c.to_pylist() for c in batch.columns]):
                if (query, row) != now:
                    if now is not None:
                        close(out)
                    now, heap = (query, row), []
                if len(heap) < k:
                    heapq.heappush(heap, (score, -vec))
                else:
                    heapq.heappushpop(heap, (score, -vec))
            yield _ranked(out, kind)
        if now is not None:
            out = []
            close(out)
            yield _ranked(out, kind)
    return rows.mapInArrow(run, f"query_id long, rank int, vec_id long, score {kind}")


def _ranked(rows: list[tuple], kind: str) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64() if kind == "double" else pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)],
                                      names=["query_id", "rank", "vec_id", "score"])
