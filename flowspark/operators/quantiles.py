"""Exact quantiles of large columns without gathering the column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


#: Parts of a bucket: 10^12 rows of the unit interval leave a few thousand in a part.
PARTS = 1 << 16


def _scaled(v: Column) -> Column:
    """Grows with ``v``; its whole part is a bucket number: some hundred thousand buckets cover every
    BIGINT, a few thousand cover the unit interval."""
    v = v.cast("double")
    return F.signum(v) * F.log2(F.abs(v) + 1.0) * 4096


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``name, prob, quantile`` with linear interpolation between neighbouring ranks.

    A first pass counts rows per coarse bucket, which combines before the shuffle to a few
    thousand rows, and finds the buckets holding the wanted ranks; a second pass does the same for
    the parts of those buckets, a third ranks the distinct values of the parts found.  ``df`` is
    read three times: hand in stored rows.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value"))
                                for c in columns]))
    values = (df.select(pairs.alias("p")).select("p.*").where(F.col("value").isNotNull())
              .withColumn("_f", _scaled(F.col("value"))).withColumn("bucket", F.floor("_f").cast("bigint"))
              .withColumn("part", F.floor((F.col("_f") - F.floor("_f")) * PARTS).cast("bigint")).drop("_f"))

    by_name = Window.partitionBy("name")
    through = by_name.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    buckets = (values.groupBy("name", "bucket").agg(F.count(F.lit(1)).alias("n"))
               .withColumn("through", F.sum("n").over(through))
               .withColumn("total", F.sum("n").over(by_name)))
    wanted = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("prob"),
                                          (F.lit(float(q)) * (F.col("total") - 1)).alias("at"))
                                 for q in probs]))
    sides = F.explode(F.array(
        F.struct(F.floor("at").alias("rank"), (1 - (F.col("at") - F.floor("at"))).alias("share")),
        F.struct((F.floor("at") + 1).alias("rank"), (F.col("at") - F.floor("at")).alias("share"))))
    # At most two ranks per (column, prob) match, whatever the data.
    targets = (buckets.select("name", "bucket", (F.col("through") - F.col("n")).alias("base"), "through",
                              wanted.alias("w"))
               .select("name", "bucket", "base", "through", "w.prob", "w.at")
               .select("name", "bucket", "base", "through", "prob", sides.alias("s"))
               .select("name", "bucket", "base", "through", "prob", "s.rank", "s.share")
               .where((F.col("share") > 0) & (F.col("rank") >= F.col("base")) & (F.col("rank") < F.col("through"))))

    parts = (values.join(F.broadcast(targets.select("name", "bucket").distinct()), ["name", "bucket"], "left_semi")
             .groupBy("name", "bucket", "part").agg(F.count(F.lit(1)).alias("n")))
    below = Window.partitionBy("name", "bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    found = (parts.withColumn("upto", F.sum("n").over(below))
             .join(F.broadcast(targets.drop("through")), ["name", "bucket"])
             .where((F.col("rank") - F.col("base") < F.col("upto")) & (F.col("rank") - F.col("base") >= F.col("upto") - F.col("n")))
             .select("name", "bucket", "part", "prob", "share", (F.col("rank") - F.col("base") - F.col("upto") + F.col("n")).alias("place")))

    inside = (values.join(F.broadcast(found.select("name", "bucket", "part").distinct()), ["name", "bucket", "part"], "left_semi")
              .groupBy("name", "bucket", "part", "value").agg(F.count(F.lit(1)).alias("n")))
    run = Window.partitionBy("name", "bucket", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return (inside.withColumn("upto", F.sum("n").over(run)).join(F.broadcast(found), ["name", "bucket", "part"])
            .where((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n")))
            .groupBy("name", "prob").agg((F.sum(F.col("value") * F.col("share"))).alias("quantile")))
