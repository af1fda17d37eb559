"""Running values over range parts against a sequential pass."""
from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from flowspark.operators import scan
from flowspark.operators.scan import running

FOLDS = {"s": ("sum", "v"), "hi": ("max", "v"), "lo": ("min", "v"), "top": ("max_before", "v"), "was": ("lag", "v"), "will": ("next", "v"),
         "name": ("last", "w")}


def sequential(rows):
    """rows (key, other, at, v, w) sorted by key and time -> the folds of each."""
    out, by = [], {}
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        by.setdefault(row[:2], []).append(row)
    for group in by.values():
        for i, row in enumerate(group):
            seen = [r[3] for r in group[:i + 1] if r[3] is not None]
            past = [r[3] for r in group[:i] if r[3] is not None]
            out.append((*row, sum(seen), max(seen, default=None), min(seen, default=None), max(past, default=None),
                        group[i - 1][3] if i else None, group[i + 1][3] if i + 1 < len(group) else None,
                        next((r[4] for r in group[i::-1] if r[4] is not None), None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("records", [3, 10_000])
@pytest.mark.parametrize("hot", [0.0, 0.5, 1.0])
def test_folds_as_in_one_pass(spark, hot, records):
    """A key of many parts, keys inside a part, null keys and values, batches of three rows."""
    draw = random.Random(7)
    rows = [("hot" if draw.random() < hot else draw.choice(["a", "b", None, "zz", f"k{draw.randrange(40)}"]), draw.randrange(2) if hot < 1 else 0,
             at, draw.choice([None, draw.randrange(-50, 50)]), draw.choice([None, None, None, f"w{at}"])) for at in draw.sample(range(10_000), 400)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        df = spark.createDataFrame(rows, "key string, other int, at long, v long, w string").repartition(5)
        got = running(df, ["key", "other"], ["at"], FOLDS)
        assert got.columns == [*df.columns, *FOLDS]
        assert sorted(map(tuple, got.collect()), key=repr) == sequential(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_hot_tile_is_cut_by_volume(spark):
    """A million rows of one source within ten seconds: no part is twice the mean."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = spark.range(1_000_000).select(F.lit("10.0.0.1").alias("src_ip"), (F.pow(F.col("id") / 1e6, 3) * 1e7).cast("long").alias("ts_us"), F.lit(1).alias("n"))
        local = scan._local(rows, ["src_ip"], ["ts_us"], {"s": ("sum", "n")})
        sizes = [r["count"] for r in local.groupBy("part").count().collect()]
        assert len(sizes) == 16 and sum(sizes) == 1_000_000 and max(sizes) < 2 * sum(sizes) / len(sizes)
        assert running(rows.limit(1000), ["src_ip"], ["ts_us"], {"s": ("sum", "n")}).agg(F.max("s")).first()[0] == 1000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty_and_unknown(spark):
    df = spark.createDataFrame([], "key string, at long, v long")
    assert running(df, ["key"], ["at"], {"s": ("sum", "v")}).count() == 0
    with pytest.raises(ValueError, match="fold"):
        running(df, ["key"], ["at"], {"s": ("median", "v")})


@pytest.mark.parametrize("hot", [0.3, 1.0])
def test_clusters_over_many_parts(spark, hot):
    """Long intervals that reach over several parts, chains, ties and nested ones."""
    draw, rows = random.Random(11), []
    for _ in range(500):
        start = draw.randrange(0, 3000)
        rows.append(("hot" if draw.random() < hot else f"k{draw.randrange(9)}", start, start + draw.choice([0, 1, 2, 5, draw.randrange(1, 400) if draw.random() < .1 else 3])))
    want = []
    for key in {r[0] for r in rows}:
        mine, opened, reach = sorted(r for r in rows if r[0] == key), None, None
        for _, start, end in mine:
            if reach is None or start > reach + 2:
                opened = start
            reach = end if reach is None else max(reach, end)
            want.append((key, start, end, opened))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        df = spark.createDataFrame(rows, "k string, s long, e long").withColumn("g", F.lit(2))
        got = scan.clusters(df, ["k"], "s", "e", "g").select("k", "s", "e", "cluster").collect()
        assert sorted(map(tuple, got)) == sorted(want) and len({w[3] for w in want}) > 30
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
