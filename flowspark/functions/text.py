"""Display text: times, sizes, spans, log lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def seen_text(us: Column) -> Column:
    """Event time as text; six decimals only when the time has any."""
    ts = F.timestamp_micros(us)
    return F.when(F.pmod(us, F.lit(1_000_000).cast("bigint")) == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
                  ).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def seconds_between(start_us: Column, end_us: Column) -> Column:
    return (end_us - start_us) / F.lit(1e6)


def plain(number: float) -> str:
    """A threshold as short text: 5.0 -> 5."""
    return f"{number:g}"


def human_bytes(n: Column, binary: bool = False) -> Column:
    """1536 -> '1.5 KB' (or '1.5 KiB')."""
    units = ("B", "KiB", "MiB", "GiB", "TiB") if binary else ("B", "KB", "MB", "GB", "TB")
    n = n.cast("double")
    text = F.concat(F.format_number(n, 0), F.lit(f" {units[0]}"))
    for power, unit in enumerate(units[1:], start=1):
        text = F.when(F.abs(n) >= 1024.0 ** power,
                      F.concat(F.format_number(n / 1024.0 ** power, 1), F.lit(f" {unit}"))).otherwise(text)
    return text


def human_span(seconds: Column) -> Column:
    """Minutes below two hours, hours from there."""
    return F.when(seconds < 7200, F.concat(F.format_number(seconds / 60, 1), F.lit(" min"))
                  ).otherwise(F.concat(F.format_number(seconds / 3600, 1), F.lit(" h")))


def clock_span(seconds: Column) -> Column:
    """Whole seconds as HH:MM:SS (hours may exceed 24)."""
    s = F.floor(seconds).cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def peer_label(count: Column, first: Column) -> Column:
    """The single peer, or "N hosts"."""
    return F.when(count == 1, first).otherwise(F.concat(count.cast("string"), F.lit(" hosts")))


def port_list(ports: Column) -> Column:
    """'[22, 80]' for descriptions."""
    return F.concat(F.lit("["), F.array_join(ports.cast("array<string>"), ", "), F.lit("]"))
