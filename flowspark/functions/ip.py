"""IP addresses and networks as columns.

An address is ``(family, hi, lo)``: two BIGINT halves of 128 bits, with ``hi`` 0 for IPv4.
That makes "is this address inside that network" an equality of masked halves.  Validity and everything about IPv4
are JVM expressions.
"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.once import once

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"{OCTET}(?:\.{OCTET}){{3}}"


def _ipv6_pattern() -> str:
    """Every legal split of at most eight groups around one ``::``; the last two groups may be
    written as an IPv4 address."""
    g = "[0-9a-f]{1,4}"

    def groups(n: int) -> list[str]:
        if n == 0:
            return [""]
        plain = g + (f"(?::{g}){{{n - 1}}}" if n > 1 else "")
        out = [plain]
        if n >= 2:
            head = f"{g}:" if n > 2 else ""
            out.append((f"(?:{head}){{{n - 2}}}" if n > 2 else "") + IPV4)
        return out

    forms = groups(8)
    for left in range(0, 8):
        lead = groups(left)[0]
        for right in range(0, 8 - left):
            for tail in groups(right):
                forms.append(f"{lead}::{tail}")
    return "(?:" + "|".join(forms) + ")"


IPV6 = _ipv6_pattern()
IPV4_RE = f"^{IPV4}$"
IPV6_RE = f"^{IPV6}(?:%[^%/]+)?$"


def is_ipv4(text: Column) -> Column:
    return text.rlike(IPV4_RE)


def is_ip(text: Column) -> Column:
    """Valid IPv4 (no leading zeros) or IPv6 text."""
    return F.when(F.contains(text, F.lit(":")), F.lower(text).rlike(IPV6_RE)).otherwise(is_ipv4(text))


def _octet(parts: Column, i: int) -> Column:
    return F.get(parts, F.lit(i)).try_cast("bigint")


def ipv4_number(text: Column) -> Column:
    parts = F.split(text, r"\.")
    return (F.shiftleft(_octet(parts, 0), 24).bitwiseOR(F.shiftleft(_octet(parts, 1), 16))
            .bitwiseOR(F.shiftleft(_octet(parts, 2), 8)).bitwiseOR(_octet(parts, 3)))


def with_address(df: DataFrame, text: str) -> DataFrame:
    """Add ``family, hi, lo``; all null when the text is no address.

    A chain of projections, so that no step repeats the expressions before it; all of it runs in
    the JVM.
    """
    keep = df.columns
    step = df.select(
        *keep,
        F.when(is_ipv4(F.col(text)), 4).when(F.lower(text).rlike(IPV6_RE), 6).alias("family"),
        F.when(F.contains(F.col(text), F.lit(":")), F.lower(F.regexp_replace(text, "%.*$", ""))).alias("_v6"))
    # An IPv4 tail counts as two groups.
    step = step.withColumn("_tail", ipv4_number(F.regexp_extract("_v6", r"([0-9.]+[.][0-9.]+)$", 1)))
    step = step.withColumn("_v6", F.when(F.col("_tail").isNull(), F.col("_v6")).otherwise(F.concat(
        F.regexp_replace("_v6", r"[0-9.]+[.][0-9.]+$", ""),
        F.lower(F.hex(F.shiftright("_tail", 16))), F.lit(":"),
        F.lower(F.hex(F.col("_tail").bitwiseAND(F.lit(0xFFFF)))))))
    step = step.withColumn("_sides", F.split("_v6", "::"))

    def groups(side: int) -> Column:
        part = F.get("_sides", F.lit(side))
        return F.when(part.isNull() | (part == ""), F.array().cast("array<string>")).otherwise(F.split(part, ":"))

    step = step.withColumns({"_left": groups(0), "_right": groups(1)})
    fill = F.greatest(F.lit(0), F.lit(8) - F.size("_left") - F.size("_right"))
    step = step.withColumn("_groups", F.concat("_left", F.array_repeat(F.lit("0"), fill), "_right"))

    def half(first: int) -> Column:
        value = F.lit(0).cast("bigint")
        for i in range(4):
            word = F.conv(F.get("_groups", F.lit(first + i)), 16, 10).try_cast("bigint")
            value = value.bitwiseOR(F.shiftleft(word, 48 - 16 * i))
        return value

    v4, v6 = F.col("family") == 4, F.col("family") == 6
    return once(step, [*keep, "family"], [
        F.when(v4, F.lit(0).cast("bigint")).when(v6, half(0)).alias("hi"),
        F.when(v4, ipv4_number(F.col(text))).when(v6, half(4)).alias("lo")])


def _ones(bits_cleared: Column) -> Column:
    """All ones with the lowest ``bits_cleared`` (0..64) bits cleared."""
    return F.when(bits_cleared >= 64, F.lit(0).cast("bigint")).otherwise(
        F.call_function("shiftleft", F.lit(-1).cast("bigint"), bits_cleared))


def masked(family: Column, hi: Column, lo: Column, prefix: Column) -> tuple[Column, Column]:
    """Both halves with everything after the prefix cleared."""
    width = F.when(family == 6, 128).otherwise(32)
    hi_clear = F.greatest(F.lit(0), F.lit(64) - prefix)
    lo_clear = F.least(F.lit(64), width - prefix)
    return (F.when(family == 6, hi.bitwiseAND(_ones(hi_clear))).otherwise(F.lit(0).cast("bigint")),
            lo.bitwiseAND(_ones(lo_clear)))


def parse_network(text: str | None) -> tuple | None:
    """``(family, prefix, hi, lo, canonical text)`` of an address or CIDR (prefix digits, netmask
    or host mask), host bits cleared; None when it is neither."""
    try:
        net = ipaddress.ip_network((text or "").strip(), strict=False)
    except ValueError:
        return None
    n = int(net.network_address)
    halves = [w - (1 << 64) if w >> 63 else w for w in (n >> 64, n & (1 << 64) - 1)]      # signed
    return net.version, net.prefixlen, *halves, str(net)


def with_network(df: DataFrame, text: str) -> DataFrame:
    """Add ``family, prefix, hi, lo`` and the canonical ``entry`` text of blocklist entries (in
    Arrow batches: their spellings are many, their rows few); all null for other text."""
    def parse(texts: pd.Series) -> pd.DataFrame:
        rows = [parse_network(t) or (None,) * 5 for t in texts]
        out = pd.DataFrame(rows, columns=["family", "prefix", "hi", "lo", "entry"], dtype=object)
        return out.astype({"family": "Int32", "prefix": "Int32", "hi": "Int64", "lo": "Int64"})

    keep = [c for c in df.columns if c != "entry"]
    parsed = F.pandas_udf(parse, "family int, prefix int, hi long, lo long, entry string")
    return df.withColumn("_net", parsed(F.col(text))).select(
        *keep, "_net.family", "_net.prefix", "_net.hi", "_net.lo", "_net.entry")
