"""Field conversion and the split into valid rows and a quarantine table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fields
from ..functions.ip import is_ip
from .once import once
from ..schema import FLOW_FIELDS
from ..sources.profiles import Profile


#: What is stripped from both ends of a field.
WHITE_SPACE = " \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def convert(raw: DataFrame, *profiles: Profile) -> DataFrame:
    """Typed columns plus ``reason`` (null when the row is valid).

    Of several ``profiles``, column ``profile`` of ``raw`` tells the number of the row's own.

    ``raw`` holds ``seq``, the seven flow fields as text and, where there is one, the ``line`` they
    come from, which a rejected row keeps whole, and its ``fault``, a reason known beforehand.  All broken fields of a row are
    named, in schema order.  Every field is converted once, in the JVM.
    """
    bare = {c: F.btrim(F.coalesce(F.col(c), F.lit("")), F.lit(WHITE_SPACE)) for c in FLOW_FIELDS}
    line = F.col("line") if "line" in raw.columns else F.concat_ws(",", *bare.values())
    fault = F.col("fault") if "fault" in raw.columns else F.lit(None).cast("string")
    own = ["profile"] if len(profiles) > 1 else []

    def rule(values: list, kind: str) -> Column:
        """The value of the row's own profile."""
        last = F.lit(values[-1]).cast(kind) if not isinstance(values[-1], Column) else values[-1]
        for i, value in reversed(list(enumerate(values[:-1]))):
            last = F.when(F.col("profile") == i, value).otherwise(last)
        return last

    text = raw.select("seq", *own, line.alias("raw"), fault.alias("fault"), *[value.alias(c) for c, value in bare.items()])
    # Two projections, each column once: numbers first, then the values made of them.
    numbers = text.select("*", *[fields.number(F.col(c)).alias(f"{c}_n")
                                 for c in ("timestamp", "src_port", "dst_port", "packet_length")])

    def port(c: str) -> Column:
        return fields.port(F.col(c), rule([p.missing_port_as_zero for p in profiles], "boolean"), F.col(f"{c}_n"))

    values = numbers.select(
        "seq", *own, "src_ip", "dst_ip",
        fields.timestamp(F.col("timestamp"), rule([p.dayfirst for p in profiles], "boolean"), F.col("timestamp_n")).alias("t"),
        is_ip(F.col("src_ip")).alias("src_ok"), is_ip(F.col("dst_ip")).alias("dst_ok"),
        port("src_port").alias("sp"), port("dst_port").alias("dp"), fields.protocol(F.col("protocol")).alias("proto"),
        fields.whole(F.col("packet_length_n"), rule([p.length_min for p in profiles], "bigint"),
                     rule([p.length_max for p in profiles], "bigint")).alias("len"),
        "raw", "fault")
    made = [c for c in values.columns if c != "seq"]
    typed = once(values, ["seq"], [F.col(c) for c in made])
    known = rule([F.col("proto").isin(*p.protocols) if p.protocols else F.col("proto").rlike(r"^[A-Z0-9][A-Z0-9_.\-]*$")
                  for p in profiles], "boolean")

    def bad(condition: Column, name: str) -> Column:
        return F.when(condition, f"invalid {name}")

    reason = F.concat_ws(
        "; ", bad(F.col("t").isNull(), "timestamp"), bad(~F.col("src_ok"), "src_ip"), bad(~F.col("dst_ok"), "dst_ip"),
        bad(F.col("sp").isNull(), "src_port"), bad(F.col("dp").isNull(), "dst_port"), bad(~known, "protocol"),
        bad(F.col("len").isNull(), "packet_length"))
    return typed.select(
        "seq", F.col("t").alias("timestamp"), F.unix_micros("t").alias("ts_us"), "src_ip", "dst_ip",
        F.col("sp").alias("src_port"), F.col("dp").alias("dst_port"), F.col("proto").alias("protocol"),
        F.col("len").alias("packet_length"), "raw",
        F.coalesce("fault", F.nullif(reason, F.lit(""))).alias("reason"))


def valid_rows(converted: DataFrame) -> DataFrame:
    return converted.where(F.col("reason").isNull()).drop("reason", "raw")


def rejected_rows(converted: DataFrame) -> DataFrame:
    return converted.where(F.col("reason").isNotNull()).select("seq", "reason", "raw")


def quality(converted: DataFrame, structural: DataFrame | None = None) -> DataFrame:
    """One row: total, valid and invalid row counts."""
    marks = converted.select(F.col("reason").isNull().alias("ok"))
    if structural is not None:
        marks = marks.unionByName(structural.select(F.lit(False).alias("ok")))
    return marks.agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("valid"),
                     F.count_if(~F.col("ok")).alias("invalid"))


def reason_counts(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def reject_sample(rejects: DataFrame, n: int = 1000) -> DataFrame:
    """The first n rejects for display; counts always come from the whole table."""
    return rejects.orderBy("seq").limit(n)
