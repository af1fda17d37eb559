"""The tiled incident plan against a plain sequential scan."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowspark.operators.incidents import incidents, rows_of_incidents, to_units
from flowspark.operators.quantiles import exact_quantiles
from flowspark.operators.tiles import cluster_intervals, trailing_metric


def scan_rows(rows, window, over, distinct):
    """Incidents of one key by walking its rows in time order."""
    rows = sorted(rows)
    out = []
    for i, (t, _) in enumerate(rows):
        inside = [(u, v) for u, v in rows[: i + 1] if u >= t - window]
        size = len({v for _, v in inside}) if distinct else len(inside)
        if size > over:
            left = inside[0][0]
            if out and left - out[-1][1] <= window:
                out[-1][1], out[-1][2] = t, max(out[-1][2], size)
            else:
                out.append([left, t, size])
    return [tuple(o) for o in out]


@pytest.mark.parametrize("distinct", [False, True])
def test_equals_sequential_scan(spark, distinct):
    rng = random.Random(7)
    rows, want = [], set()
    for key in range(60):
        size = rng.randint(1, 40)
        mine = [(rng.randint(-50, 150), rng.randint(0, 5)) for _ in range(size)]
        rows += [(key, t, v) for t, v in mine]
        for a, b, peak in scan_rows(mine, 10, 3, distinct):
            want.add((key, a, b, peak))
    df = spark.createDataFrame(rows, "k int, ts_us long, v int")
    units = to_units(df, ["k", "v"])
    got = incidents(units, ["k"], 10, 3, "v" if distinct else None)
    assert {tuple(r) for r in got.select("k", "start_us", "end_us", "peak").collect()} == want
    assert want


def test_incident_rows_are_all_rows_between(spark):
    rows = [(1, t) for t in (0, 1, 2, 3, 9, 12, 13, 14, 15, 60)]
    df = spark.createDataFrame(rows, "k int, ts_us long")
    units = to_units(df, ["k"])
    found = incidents(units, ["k"], 5, 3)
    inside = rows_of_incidents(units, found, ["k"], 5).collect()
    assert [tuple(r) for r in found.select("start_us", "end_us", "peak").collect()] == [(0, 3, 4), (12, 15, 4)] or \
        sorted(r.ts_us for r in inside) == [0, 1, 2, 3, 9, 12, 13, 14, 15]


def test_one_hot_key(spark):
    """One key holds everything, most of it at one instant: pre-counted rows, cut by volume."""
    hot = spark.range(200_000).select(F.lit("hot").alias("k"), F.when(F.col("id") % 2 == 0, F.lit(5_000)).otherwise(
        F.col("id")).alias("ts_us"))
    units = to_units(hot, ["k"])
    assert units.count() <= 100_001
    hits = trailing_metric(units, ["k"], 100, 100_000)
    assert hits.agg(F.min("ts_us"), F.max("ts_us")).first()[:] == (5_000, 5_099)
    got = incidents(units, ["k"], 100, 100_000).first()
    assert (got["start_us"], got["end_us"], got["peak"]) == (4_901, 5_099, 100_000 + 51)   # 51 odd times fit


def test_threshold_below_one_is_refused(spark):
    with pytest.raises(ValueError):
        trailing_metric(spark.createDataFrame([(1, 1, 1)], "k int, ts_us long, n long"), ["k"], 5, 0)


@pytest.mark.parametrize("seed", [3, 1000])
def test_clusters_equal_sequential_merge(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 20), s, s + rng.randint(0, 12)) for s in (rng.randint(0, 300) for _ in range(400))]
    want = Counter()
    for k in {r[0] for r in rows}:
        clusters = []
        for _, s, e in sorted(r for r in rows if r[0] == k):
            if clusters and s <= clusters[-1][1] + 2:
                clusters[-1][1] = max(clusters[-1][1], e)
                clusters[-1][2] += 1
            else:
                clusters.append([s, e, 1])
        want.update((k, *c) for c in clusters)
    df = spark.createDataFrame(rows, "k int, s long, e long")
    got = cluster_intervals(df, ["k"], "s", "e", 2, {"n": F.count(F.lit(1))})
    assert Counter(tuple(r) for r in got.select("k", "s", "e", "n").collect()) == want


def test_quantiles_are_exact(spark):
    import numpy as np
    rng = random.Random(3)
    values = [(rng.choice([rng.randint(-10**12, 10**12), rng.randint(0, 50), 7]), rng.random() - 0.5) for _ in range(501)]
    df = spark.createDataFrame(values, "a long, b double")
    got = {(r["name"], r["prob"]): r["quantile"] for r in exact_quantiles(df, ["a", "b"], (0, 0.03, 0.5, 0.75, 1)).collect()}
    for i, name in enumerate("ab"):
        for p in (0, 0.03, 0.5, 0.75, 1):
            assert got[name, float(p)] == pytest.approx(np.quantile([v[i] for v in values], p), rel=1e-9, abs=1e-9)


def test_quantiles_of_one_crowded_bucket(spark):
    import numpy as np
    df = spark.range(200_000).select((F.lit(0.5) + F.pmod(F.col("id") * 7919, F.lit(200_003)) / 1e10).alias("a"))
    values = np.array([r[0] for r in df.collect()])
    got = {r["prob"]: r["quantile"] for r in exact_quantiles(df, ["a"], (0.03, 0.5, 1.0)).collect()}
    for p, value in got.items():
        assert value == pytest.approx(np.quantile(values, p), rel=1e-14)


def test_parts_grow_with_the_volume(spark, monkeypatch):
    """Rows of the sliding rules are cut into parts of a bounded size; the incidents stay those of the SQL."""
    import duckdb

    import __spark_entry__ as entry
    from flowspark.operators import scan
    from verify import normal
    monkeypatch.setattr(scan, "PART_ROWS", 500)
    made, local = [], scan._local
    monkeypatch.setattr(scan, "_local", lambda *a: made.append(local(*a)) or made[-1])
    con = duckdb.connect()
    con.sql("CREATE VIEW lineitem AS SELECT * FROM '/root/testdata/sf0.001/lineitem.parquet'")
    got = entry.queries()["port_scan_incidents_tied"](spark, "/root/testdata/sf0.001").toPandas()
    assert normal(got) == normal(con.sql(entry.oracle_sql()["port_scan_incidents_tied"]).df())
    assert made[1].select("part").distinct().count() > 8
