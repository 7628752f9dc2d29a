"""RFC 3339 text and half-open intervals in epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed format: date, T, time with optional fraction, Z or an offset; the second may be 60.
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt]([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)$"


def parse_rfc3339(text: Column) -> Column:
    """Epoch milliseconds (fractions cut, a second 60 is the next minute's start), or NULL."""
    t = F.upper(text)
    leap = F.substring(t, 18, 2) == "60"
    body = F.concat(F.substring(t, 1, 17), F.when(leap, F.lit("59")).otherwise(F.substring(t, 18, 2)))
    fraction = F.regexp_extract(t, r"\.(\d+)", 1)
    zone = F.regexp_extract(t, r"(Z|[+-]\d{2}:\d{2})$", 1)
    whole = F.unix_seconds(F.try_to_timestamp(F.concat(body, zone)))
    ms = F.rpad(F.substring(fraction, 1, 3), 3, "0").cast("int")
    return F.when(text.rlike(RFC3339), (whole + F.when(leap, 1).otherwise(0)) * 1000 + ms)


def epoch_ms(t: Column) -> Column:
    """Epoch milliseconds of a timestamp; one without a zone counts as the session's (UTC by convention)."""
    return F.unix_millis(t.cast("timestamp"))


def format_rfc3339(ms: Column) -> Column:
    """UTC text; milliseconds only where they aren't 0."""
    whole = F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss")
    part = F.pmod(ms, F.lit(1000))
    return F.concat(whole, F.when(part != 0, F.concat(F.lit("."), F.lpad(part.cast("string"), 3, "0"))).otherwise(""), F.lit("Z"))


def parse_interval(text: Column) -> Column:
    """struct(start_ms, end_ms) of "start/end", or NULL where a side is malformed or the end comes first."""
    sides = F.split(text, "/")
    start, end = parse_rfc3339(F.get(sides, 0)), parse_rfc3339(F.get(sides, 1))
    return F.when((F.size(sides) == 2) & (start <= end), F.struct(start.alias("start_ms"), end.alias("end_ms")))
