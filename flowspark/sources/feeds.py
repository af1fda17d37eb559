"""Plain-text blocklists, one address or network per line."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.ip import with_network
from ..schema import literal_map


def parse_feed_lines(lines: DataFrame) -> DataFrame:
    """``value`` plus any columns -> the same columns with ``entry`` (canonical network text).

    Blank lines and ``#``/``;`` comments are skipped, only the first token counts, host bits are
    cleared, invalid tokens and default routes are dropped.
    """
    keep = [c for c in lines.columns if c != "value"]
    line = F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))
    tokens = (lines.withColumn("_line", line).where((F.col("_line") != "") & ~F.col("_line").rlike("^[#;]"))
              .withColumn("_token", F.regexp_extract("_line", r"^[,\s]*([^,\s]+)", 1)))
    return with_network(tokens.select(*keep, "_token"), "_token").where(F.col("prefix") > 0).select(*keep, "entry")


def read_feeds(spark: SparkSession, feeds: Sequence[str] | Sequence[tuple[str, str]]) -> DataFrame:
    """``entry, source, feed_ord, ord`` from feed files, in precedence order.

    ``feeds`` lists paths (named by file stem) or (name, path) pairs; all are read in one scan.
    """
    pairs = [(PurePosixPath(f).stem, f) if isinstance(f, str) else f for f in feeds]
    file_name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    by_file = {PurePosixPath(path).name: i for i, (_, path) in enumerate(pairs)}
    names = {i: name for i, (name, _) in enumerate(pairs)}
    if len(by_file) < len(pairs):
        raise ValueError("feed files need distinct names")
    lines = spark.read.text([path for _, path in pairs]).select(
        "value", F.try_element_at(literal_map(by_file), file_name).alias("feed_ord"),
        F.monotonically_increasing_id().alias("ord"))
    return (parse_feed_lines(lines)
            .withColumn("source", F.try_element_at(literal_map(names), F.col("feed_ord")))
            .select("entry", "source", "feed_ord", "ord"))


def feed_status(feeds: DataFrame) -> DataFrame:
    """Valid entries per feed."""
    return feeds.groupBy("source").agg(F.count(F.lit(1)).alias("entries"))
