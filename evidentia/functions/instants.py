"""RFC 3339 instants with up to nine fractional digits, ordered as nanoseconds (a TIMESTAMP has microseconds only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHAPE = r"^(\d{4}-\d{2}-\d{2})[Tt](\d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?([Zz]|[+-]\d{2}:\d{2})$"


def epoch_ns(text: Column) -> Column:
    """Nanoseconds since 1970 UTC, or null for anything but a valid instant with a zone (-00:00 is none)."""
    part = lambda i: F.regexp_extract(text, _SHAPE, i)
    zone = F.upper(part(4))
    sound = text.rlike(_SHAPE) & (zone != "-00:00") & ((zone == "Z") | ((F.substring(zone, 2, 2).cast("int") <= 23) & (F.substring(zone, 5, 2).cast("int") <= 59)))
    shift = F.when(zone == "Z", F.lit(0)).otherwise(
        F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1) * (F.substring(zone, 2, 2).cast("long") * 60 + F.substring(zone, 5, 2).cast("long")))
    whole = F.unix_micros(F.try_to_timestamp(F.concat_ws(" ", part(1), part(2)), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp"))
    return F.when(sound, (whole - shift * 60_000_000) * 1000 + F.rpad(part(3), 9, "0").cast("long"))


def canonical(ns: Column) -> Column:
    """UTC text: no fraction for whole seconds, six digits if that is exact, else nine without trailing zeros."""
    seconds, fraction = F.floor(ns / 1_000_000_000), F.pmod(ns, F.lit(1_000_000_000))
    clock = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss")
    nine = F.lpad(fraction.cast("string"), 9, "0")
    tail = F.when(fraction == 0, "").when(fraction % 1000 == 0, F.concat(F.lit("."), F.substring(nine, 1, 6))).otherwise(F.concat(F.lit("."), F.rtrim(nine, F.lit("0"))))
    return F.when(ns.isNotNull(), F.concat(clock, tail, F.lit("Z")))


def quality(text: Column) -> Column:
    return F.when(text.isNull(), "missing").when(epoch_ns(text).isNull(), "invalid").otherwise("valid")


def from_units(value: Column, unit: str) -> Column:
    """Nanoseconds from a count of s, ms, us or ns; null where it would overflow."""
    factor = {"s": 10**9, "ms": 10**6, "us": 10**3, "ns": 1}[unit]
    return F.when(F.abs(value) <= (2**63 - 1) // factor, value * factor)
