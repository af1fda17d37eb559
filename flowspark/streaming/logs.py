"""Log files arriving in a folder, parsed and analysed as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import REJECT
from ..sources.logs import ParsedLog, parse_lines, stream_lines
from ..sources.profiles import Layout
from .detector import StreamDetector
from .state import StateTable


#: Bits of a row number: batch, split of the batch, row of the split (67 million lines).
BATCH_BITS, SPLIT_BITS, ROW_BITS = 21, 16, 26
#: Lines and accepted and rejected rows of each batch.
COUNTS = "total bigint, valid bigint, invalid bigint"


def parse_batch(lines: DataFrame, batch: int, layout: Layout) -> ParsedLog:
    """A micro-batch of lines; ``seq`` keeps growing from batch to batch, for two million batches."""
    if batch >> BATCH_BITS:
        raise ValueError(f"batch {batch} is beyond the row numbers of one stream: start a new one on a new folder")
    # Spark's number: 33 bits for the row below the split.
    own = F.monotonically_increasing_id()
    row = F.when(own.bitwiseAND((1 << 33) - 1) < (1 << ROW_BITS), own.bitwiseAND((1 << ROW_BITS) - 1)).otherwise(
        F.raise_error("a split has more lines than row numbers: use smaller splits").cast("bigint"))
    seq = F.lit(batch << (SPLIT_BITS + ROW_BITS)).cast("bigint") + F.shiftleft(F.shiftright(own, 33), ROW_BITS) + row
    return parse_lines(lines.coalesce(1 << SPLIT_BITS).withColumn("seq", seq), layout)


def log_counts(spark: SparkSession, folder: str) -> StateTable:
    """Totals of a log stream: one row for each batch."""
    return StateTable(spark, folder, "log_counts", COUNTS)


def detect_logs(spark: SparkSession, folder: str, layout: Layout, detector: StreamDetector,
                files_per_batch: int = 1, once: bool = True) -> StreamingQuery:
    """Stream the files of ``folder`` through ``detector``; rejects are kept beside its state."""
    rejects, counts = StateTable(spark, detector.folder, "rejects", REJECT), log_counts(spark, detector.folder)

    def step(lines: DataFrame, batch: int) -> None:
        parsed = parse_batch(lines, batch, layout).persist()      # converted once, read by both sinks
        refused = rejects.write(parsed.rejects, batch).count()
        accepted = parsed.flows.count()
        counts.write(spark.createDataFrame([(accepted + refused, accepted, refused)], COUNTS), batch)
        detector.process(parsed.flows, batch)
        parsed.unpersist()

    writer = stream_lines(spark, folder, files_per_batch).writeStream.foreachBatch(step).option(
        "checkpointLocation", f"{detector.folder}/query")
    return (writer.trigger(availableNow=True) if once else writer).start()
