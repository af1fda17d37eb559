"""Delimited flow logs, from files, streams, or any column of text lines."""

from __future__ import annotations

import csv
import ipaddress
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators import validate
from ..operators.once import once
from ..schema import FLOW_FIELDS
from ..session import stored
from .profiles import PROFILES, Layout, LogFormatError, Profile, clean, resolve_layout, resolve_profile

#: Stands for a comma inside double quotes while a line is split.
HELD_COMMA = "\x00"
#: One row for each file: its first written line and the layout that this line asks for, or why there is none.
MANIFEST = ("source string, seq bigint, splits int, first string, profile int, headerless boolean, names array<string>, "
            "positions array<int>, why string")


def _is_address(text: str) -> bool:
    try:
        ipaddress.ip_address(text.strip())
        return True
    except ValueError:
        return False


def split_fields(line: Column) -> Column:
    """Array of fields as written.  Lines without a quote take the plain split; in others every
    second stretch between quotes is quoted, so its commas are held back.  Linear in the line."""
    parts = F.transform(F.split(line, '"'), lambda part, i: F.when(i % 2 == 1, F.replace(part, F.lit(","), F.lit(HELD_COMMA))).otherwise(part))
    fields = F.transform(F.split(F.array_join(parts, '"'), ","), lambda f: F.replace(f, F.lit(HELD_COMMA), F.lit(",")))
    return F.when(F.contains(line, F.lit('"')), fields).otherwise(F.split(line, ","))


def unquoted(field: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(field, r'^\s*"(.*)"\s*$', "$1"), '""', '"')
    return F.when(F.contains(field, F.lit('"')), bare).otherwise(field)


def clean_line(value: Column) -> Column:
    """Valid UTF-8 without a byte-order mark or a trailing carriage return."""
    return F.regexp_replace(F.make_valid_utf8(value), "^\ufeff|\r$", "")


def text_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``source, seq, value``: every line of every file; ``seq`` grows along each file."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("source"), F.monotonically_increasing_id().alias("seq"),
        clean_line(F.col("value")).alias("value"))


@dataclass
class ParsedLog:
    """Valid flows and the quarantine, as two views of one projection."""

    converted: DataFrame       # every row but headers, typed, with its reason
    structural: DataFrame      # repeated headers: seq, reason, raw
    layout: Layout

    @property
    def flows(self) -> DataFrame:
        return validate.valid_rows(self.converted)

    @property
    def rejects(self) -> DataFrame:
        return validate.rejected_rows(self.converted).unionByName(self.structural)

    @property
    def quality(self) -> DataFrame:
        return validate.quality(self.converted, self.structural)

    def persist(self) -> "ParsedLog":
        """Keep the converted rows while both views are written, so they are converted once."""
        self.converted.persist()
        return self

    def unpersist(self) -> None:
        self.converted.unpersist()

    def save(self, path: str) -> None:
        """Write both views in one job: flows under ``valid=true``, rejects under ``valid=false``.  The
        text is read twice, once for its rows and once for repeated headers."""
        both = self.converted.unionByName(self.structural, allowMissingColumns=True)
        both.withColumn("valid", F.col("reason").isNull()).write.mode("overwrite").partitionBy("valid").parquet(path)

    def records(self):
        """Valid rows one by one, a partition at a time."""
        return self.flows.toLocalIterator()


@dataclass(frozen=True)
class Shape:
    """What parsing asks of a layout: constants, or columns that come with every line."""

    width: Column
    headerless: Column
    names: Column                    # cleaned header names
    positions: Column                # of the flow fields, in their order
    profiles: tuple[Profile, ...]
    carried: tuple[str, ...] = ()

    @classmethod
    def of(cls, layout: Layout) -> Shape:
        names = F.array(*[F.lit(clean(h)) for h in layout.header])
        return cls(F.lit(len(layout.header)), F.lit(layout.headerless), names,
                   F.array(*[F.lit(layout.positions[c]) for c in FLOW_FIELDS]), (layout.profile,))


#: The columns of a manifest that its lines carry while they are parsed.
CARRIED = ("profile", "headerless", "names", "positions")


def _parse(lines: DataFrame, shape: Shape) -> tuple[DataFrame, DataFrame]:
    """Converted rows and repeated headers."""
    keep = [*shape.carried, "source", "seq", "value"]
    rows = once(lines.where(F.col("value").rlike(r'[^,\s"]')), keep, [split_fields(F.col("value")).alias("f")])
    # The first field decides cheaply for almost every line.
    is_header = ~shape.headerless & (F.lower(F.trim(unquoted(F.get("f", F.lit(0))))) == F.get(shape.names, F.lit(0))) & (
        F.regexp_replace(F.lower(F.trim("value")), r'"|\s*(,)\s*', "$1") == F.array_join(shape.names, ","))
    kind = F.when(F.size("f") != shape.width, "shape").when(is_header, "header").otherwise("row")
    rows = once(rows, [*keep, "f"], [kind.alias("kind")])

    misshapen = F.when(F.col("kind") == "shape", F.format_string("wrong field count (expected %d, got %d)", shape.width, F.size("f")))
    own = ["profile"] if len(shape.profiles) > 1 else []
    data = rows.where(F.col("kind") != "header").select(
        "seq", *own, F.col("value").alias("line"), misshapen.alias("fault"),
        *[unquoted(F.get("f", F.get(shape.positions, F.lit(i)))).alias(c) for i, c in enumerate(FLOW_FIELDS)])
    # The header that opens each source is expected; only later copies (few rows) are rejects.
    opening = F.min("seq").over(Window.partitionBy("source"))
    repeated = rows.where(F.col("kind") == "header").select("seq", "value", opening.alias("opening")).where("seq > opening").select(
        "seq", F.lit("repeated header row").alias("reason"), F.col("value").alias("raw"))
    return validate.convert(data, *shape.profiles), repeated


def parse_lines(lines: DataFrame, layout: Layout) -> ParsedLog:
    """Parse ``source, seq, value`` lines of a known layout.

    Blank and all-empty lines are skipped.  A line with another number of fields, or a header
    repeated inside a source, is rejected.
    """
    return ParsedLog(*_parse(lines, Shape.of(layout)), layout)


def _layout(first: str, chosen: Profile | None) -> Layout:
    """Layout by the first line of a source."""
    fields = next(csv.reader([first], skipinitialspace=True), [])
    return resolve_layout(fields or [""], chosen, _is_address)


def layout_of(lines: DataFrame, profile: "str | Profile | Mapping[str, str] | None" = "auto",
              columns: Mapping[str, str] | None = None) -> Layout:
    """Layout decided by the first line: one row of metadata, read from the first split only."""
    first = lines.head(1)
    if not first:
        raise LogFormatError("the log is empty")
    return _layout(first[0]["value"], resolve_profile(profile, columns))


def _candidates(chosen: Profile | None) -> tuple[Profile, ...]:
    return tuple(PROFILES.values()) if chosen is None else (chosen,)


def manifest(spark: SparkSession, paths: str | Sequence[str], chosen: Profile | None) -> DataFrame:
    """MANIFEST of the files, one scan of their text; files without a written line have no row.

    A file's first line is found as a partial aggregate of each split, by hash (the set of a file's
    splits makes Spark aggregate objects, so text is not sorted).  Each distinct first line of an
    Arrow batch is resolved once.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    text = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("source"), F.monotonically_increasing_id().alias("seq"),
        F.col("_metadata.file_block_start").alias("block"), "value")
    opening = text.where(F.col("value").rlike(r"[^\s\ufeff]")).groupBy("source").agg(
        F.min("seq").alias("seq"), F.size(F.collect_set("block")).alias("splits"), F.min_by("value", "seq").alias("first"))
    numbers = {p.name: i for i, p in enumerate(_candidates(chosen))}

    def resolved(first: str) -> tuple:
        try:
            found = _layout(first, chosen)
        except LogFormatError as why:
            return None, None, None, None, str(why)
        return (numbers[found.profile.name], found.headerless, [clean(h) for h in found.header],
                [found.positions[c] for c in FLOW_FIELDS], None)

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known = {first: resolved(first) for first in batch["first"].unique()}
            facts = pd.DataFrame([known[f] for f in batch["first"]], columns=[*CARRIED, "why"], dtype=object)
            yield pd.concat([batch.reset_index(drop=True), facts], axis=1)

    return opening.withColumn("first", clean_line(F.col("first"))).mapInPandas(resolve, MANIFEST)


def read_logs(spark: SparkSession, paths: str | Sequence[str],
              profile: "str | Profile | Mapping[str, str] | None" = None,
              columns: Mapping[str, str] | None = None) -> ParsedLog:
    """Files -> flows and rejects, each file by the layout of its own first line.

    The layouts are data: a stored table with a row for each file, which the lines meet by their
    path, so one plan reads any number of layouts and of files without one.  Such a file is one
    reject (its first line, with the reason); if no file has a layout, that is an error.  One row
    of totals reaches the driver.  ``layout`` of the result is that of the first usable file.
    """
    chosen = resolve_profile(profile, columns)
    files = stored(manifest(spark, paths, chosen), "log-manifest")
    usable = F.col("why").isNull()
    own = F.when(usable, F.struct(*CARRIED))
    total = files.agg(
        F.count(F.lit(1)).alias("files"), F.count_if(usable).alias("usable"), F.min_by("why", "seq").alias("why"),
        (F.min(own) == F.max(own)).alias("uniform"),
        F.min_by(F.when(usable, F.col("first")), F.when(usable, F.col("seq"))).alias("first")).first()
    if not total["files"]:
        raise LogFormatError("the log is empty")
    if not total["usable"]:
        raise LogFormatError(total["why"])
    layout, lines = _layout(total["first"], chosen), text_lines(spark, paths)
    if total["files"] == total["usable"] and total["uniform"]:
        return parse_lines(lines, layout)
    shape = Shape(F.size("names"), F.col("headerless"), F.col("names"), F.col("positions"), _candidates(chosen), CARRIED)
    converted, repeated = _parse(lines.join(files.where(usable).select("source", *CARRIED), "source"), shape)
    skipped = files.where(~usable).select("seq", F.concat(F.lit("file skipped: "), "why").alias("reason"), F.col("first").alias("raw"))
    return ParsedLog(converted, repeated.unionByName(skipped), layout)


def stream_lines(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """The same lines as a stream of the files arriving in ``folder``."""
    return (spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
            .select(F.col("_metadata.file_path").alias("source"), clean_line(F.col("value")).alias("value")))
