"""Time expressions. Inputs that don't fit give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FRACTION = "[.SSSSSSSSS][.SSSSSSSS][.SSSSSSS][.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]"
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})\z"


def parsed(c: Column, *formats: str) -> Column:
    """The first format that the whole text fits."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def rfc3339(c: Column) -> Column:
    """Date, T, time, optional fraction, and Z or an offset with a colon; nothing shorter."""
    whole = F.regexp_replace(c, r"(\.\d{6})\d+", "$1")
    return F.when(c.rlike(RFC3339), F.try_to_timestamp(whole, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]XXX")))


def fraction_cut(c: Column) -> Column:
    """Six digits of a second's fraction at most, which is what a timestamp holds."""
    return F.regexp_replace(c, r"(\.\d{6})\d+", "$1")


def spaced(c: Column) -> Column:
    """Runs of white space as one blank."""
    return F.regexp_replace(c, r"\s+", " ")


def offset_minutes(c: Column) -> Column:
    """Minutes east of UTC from a trailing Z, +hh:mm, +hhmm or +hh; null without one."""
    sign = F.regexp_extract(c, r"([+-])(\d{2}):?(\d{2})?\z", 1)
    hours, minutes = F.regexp_extract(c, r"([+-])(\d{2}):?(\d{2})?\z", 2), F.regexp_extract(c, r"([+-])(\d{2}):?(\d{2})?\z", 3)
    value = hours.try_cast("int") * 60 + F.coalesce(minutes.try_cast("int"), F.lit(0))
    return F.when(c.endswith("Z"), 0).when(sign == "-", -value).when(sign == "+", value)


def webkit_time(v: Column) -> Column:
    """Microseconds since 1601, to the second."""
    return F.timestamp_seconds(F.call_function("div", v.cast("bigint"), F.lit(1_000_000)) - F.lit(11_644_473_600))


def unix_micros(v: Column) -> Column:
    """Microseconds since 1970."""
    return F.timestamp_micros(v.cast("bigint"))


def mac_absolute(v: Column) -> Column:
    """Seconds since 2001, with a fraction."""
    whole = F.floor(v).cast("bigint")
    return F.timestamp_micros((whole + F.lit(978_307_200)) * 1_000_000 + F.floor((v - whole) * 1_000_000).cast("bigint"))


def filetime(v: Column) -> Column:
    """Tenths of microseconds since 1601."""
    return F.timestamp_micros(F.floor((v - F.lit(116_444_736_000_000_000)) / 10).cast("bigint"))


def epoch_by_magnitude(v: Column) -> Column:
    """Seconds, milliseconds, microseconds or hundreds of nanoseconds since 1601, by size; null below 10**9."""
    return (
        F.when(v > 10**17, filetime(v))
        .when(v > 10**15, F.timestamp_micros(v))
        .when(v > 10**12, F.timestamp_millis(v))
        .when(v > 10**9, F.timestamp_seconds(v))
    )


def epoch_text(c: Column) -> Column:
    """Seconds since 1970 as decimal text, to the microsecond without a detour over floating point."""
    whole = F.regexp_extract(c, r"^(\d+)(?:\.(\d*))?\z", 1)
    part = F.substring(F.rpad(F.regexp_extract(c, r"^(\d+)(?:\.(\d*))?\z", 2), 6, "0"), 1, 6)
    return F.timestamp_micros(whole.try_cast("bigint") * 1_000_000 + F.coalesce(part.try_cast("bigint"), F.lit(0)))


def elapsed(seconds: Column) -> Column:
    """A duration as 1h2m3s."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    return F.concat(F.when(h > 0, F.concat(h, F.lit("h"))).otherwise(""), F.when(seconds >= 60, F.concat(m, F.lit("m"))).otherwise(""), F.concat(s, F.lit("s")))
