"""Text fields of flow logs -> typed values, as column expressions.

Each parser returns null for text it does not accept; ``validate`` turns nulls into reasons.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import literal_map

NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
EPOCH_MILLIS_FROM = 1e11       # a larger epoch number counts milliseconds

# Placeholders for "no port" and IP protocol numbers.
PORT_PLACEHOLDERS = ("", "-", "nan", "none", "null")
PROTOCOL_NAMES = {
    0: "HOPOPT", 1: "ICMP", 2: "IGMP", 3: "GGP", 4: "IPV4", 6: "TCP", 8: "EGP", 9: "IGP",
    17: "UDP", 27: "RDP-PROTO", 41: "IPV6", 43: "IPV6-ROUTE", 44: "IPV6-FRAG", 46: "RSVP",
    47: "GRE", 50: "ESP", 51: "AH", 58: "IPV6-ICMP", 59: "IPV6-NONXT", 60: "IPV6-OPTS",
    88: "EIGRP", 89: "OSPF", 103: "PIM", 112: "VRRP", 115: "L2TP", 132: "SCTP",
    136: "UDPLITE", 137: "MPLS-IN-IP",
}

# Spellings with month names or AM/PM, in the order they are tried.
NAMED = ("d MMM yyyy[ H:m[:s]]", "d-MMM-yyyy[ H:m[:s]]", "d/MMM/yyyy[ H:m[:s]]", "MMM d yyyy[ H:m[:s]]",
         "MMM d, yyyy[ H:m[:s]]")


def number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def whole(x: Column, low: int | Column, high: int | Column | None) -> Column:
    """A parsed number as BIGINT, if it is whole and inside the bounds; a null bound is none."""
    ok = (x % 1 == 0) & (x >= low)
    if isinstance(high, Column):
        ok = ok & F.coalesce(x <= high, F.lit(True))
    elif high is not None:
        ok = ok & (x <= high)
    return F.when(ok, x.try_cast("bigint"))


def timestamp(text: Column, dayfirst: bool | Column = False, epoch: Column | None = None) -> Column:
    """Epoch seconds or milliseconds, ISO text (with or without offset), and common date texts.

    Text with an offset becomes UTC; text without one is kept as written (the session zone is
    UTC).  ``dayfirst`` decides d/M against M/d; an impossible reading falls back to the other.
    Dates written in digits are rewritten to ISO and cast, so a row costs one parse.  ``epoch``
    is ``number(text)`` when the caller has it already.
    """
    epoch = number(text) if epoch is None else epoch
    seconds = F.when(epoch < EPOCH_MILLIS_FROM, epoch).otherwise(epoch / 1000.0)
    from_epoch = F.timestamp_micros(F.round(seconds * 1e6).try_cast("bigint"))

    # 2017/07/03 10:00, 2017-07-03T10:00:00 +0200
    iso = F.regexp_replace(text, r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})", "$1-$2-$3")
    iso = F.regexp_replace(iso, r"\s*([+-][0-9]{2}):?([0-9]{2})$", "$1:$2")

    parts = r"^([0-9]{1,2})[-./]([0-9]{1,2})[-./]([0-9]{4})[ T]*(.*)$"
    day_month = F.rtrim(F.regexp_replace(text, parts, "$3-$2-$1 $4")).try_cast("timestamp")
    month_day = F.rtrim(F.regexp_replace(text, parts, "$3-$1-$2 $4")).try_cast("timestamp")

    def ordered(day: list[Column], month: list[Column], rest: list[Column]) -> Column:
        """The readings in the order of ``dayfirst``, which may differ from row to row."""
        return F.when(F.lit(dayfirst), F.coalesce(*day, *month, *rest)).otherwise(F.coalesce(*month, *day, *rest))

    digits = ordered([day_month], [month_day], [])

    clock = " h:m[:s] a"
    halves = ordered(*[[F.try_to_timestamp(F.upper(text), F.lit(d + clock))] for d in ("d/M/yyyy", "M/d/yyyy", "yyyy-M-d")])
    named = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in NAMED])
    return (F.when(epoch.isNotNull(), F.when(epoch > 0, from_epoch))
            .when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9:.]+$"), text.try_cast("timestamp"))
            .when(text.rlike("(?i)[0-9] ?[AP]M$"), halves)
            .when(text.rlike("^[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}(?:[ T].*)?$"), iso.try_cast("timestamp"))
            .when(text.rlike(parts), digits)
            .when(text.rlike("[A-Za-z]{3}"), named))


def port(text: Column, missing_as_zero: bool | Column = False, decimal: Column | None = None) -> Column:
    """Decimal or 0x-hexadecimal port 0..65535; ``decimal`` is ``number(text)`` if at hand."""
    decimal = number(text) if decimal is None else decimal
    low = F.lower(text)
    hexadecimal = F.when(low.rlike("^0x[0-9a-f]+$"),
                         F.conv(F.substring(low, 3, 64), 16, 10).try_cast("bigint"))
    value = F.when(decimal.isNotNull(), whole(decimal, 0, 65535)).when(
        hexadecimal.between(0, 65535), hexadecimal)
    zero = F.lit(missing_as_zero) & low.isin(*PORT_PLACEHOLDERS)
    return F.when(zero, F.lit(0).cast("bigint")).otherwise(value).cast("int")


def protocol(text: Column) -> Column:
    """Upper-case protocol name; protocol numbers become names."""
    up = F.upper(text)
    n = F.regexp_extract(up, "^([0-9]+)(?:[.]0+)?$", 1).try_cast("bigint")
    named = F.try_element_at(literal_map(PROTOCOL_NAMES), n.try_cast("int"))
    numbered = F.coalesce(named, F.concat(F.lit("PROTO-"), n.cast("string")), up)
    return F.when(up.rlike("^[0-9]"), numbered).otherwise(up)      # names skip the lookup
