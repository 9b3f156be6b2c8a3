"""Times as seconds in doubles. All are Column expressions; rounding is half up, towards positive infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, places: int = 3) -> Column:
    """``x`` to so many places, halves up; null and infinite values as they are."""
    k = float(10**places)
    return F.when(F.abs(x) < F.lit(1e15), F.floor(x * k + 0.5) / k).otherwise(x)


def metric(x: Column) -> Column:
    """A metric to six places; null where it is no finite number."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(1e12)), F.floor(x * 1e6 + 0.5) / 1e6)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Six places; null for a zero or missing denominator."""
    return F.when(denominator != 0, metric(numerator / denominator))


def milliseconds(x: Column) -> Column:
    return F.floor(x * 1000 + 0.5).cast("bigint")


def clamp(x: Column, duration: Column | None = None) -> Column:
    """Rounded, at least 0 and, where it is known, at most the duration."""
    low = F.greatest(F.lit(0.0), rounded(x))
    return low if duration is None else F.least(low, F.coalesce(F.greatest(F.lit(0.0), duration), F.lit(float("inf"))))


def parse_timestamp(text: Column) -> Column:
    """Seconds of [H]H:MM:SS[.mmm], MM:SS[.mmm] or plain seconds, dot or comma; null for anything else, negative or over 59."""
    t = F.trim(F.regexp_replace(text, "^([^,]*),", "$1."))
    parts = F.split(t, ":")
    n = F.size(parts)
    second = F.element_at(parts, -1)
    number = lambda c: c.try_cast("double")
    minute, hour = F.element_at(parts, -2), F.element_at(parts, -3)
    plain = (n == 1) & t.rlike("^[0-9]+(\\.[0-9]+)?$")
    clock = (n >= 2) & (n <= 3) & t.rlike("^([0-9]+:)?[0-9]{1,2}:[0-9]{1,2}(\\.[0-9]{1,3})?$")
    in_range = (number(minute) < 60) & (number(second) < 60)
    return (
        F.when(plain, rounded(number(t)))
        .when(clock & (n == 2) & in_range, rounded(number(minute) * 60 + number(second)))
        .when(clock & (n == 3) & in_range, rounded(number(hour) * 3600 + number(minute) * 60 + number(second)))
    )


def format_timestamp(x: Column, separator: str = ".", always_hours: bool = True) -> Column:
    """HH:MM:SS and milliseconds after ``separator``; negative, missing and not-a-number times are zero."""
    ms = F.when(x.isNull() | F.isnan(x) | (x < 0), F.lit(0).cast("bigint")).otherwise(milliseconds(x))
    s = F.floor(ms / 1000)
    hours, rest = F.floor(s / 3600), F.format_string(f"%02d:%02d{separator}%03d", F.floor(s / 60) % 60, s % 60, ms % 1000)
    with_hours = F.concat(F.when(hours < 10, F.lpad(hours.cast("string"), 2, "0")).otherwise(hours.cast("string")), F.lit(":"), rest)
    return with_hours if always_hours else F.when(hours > 0, with_hours).otherwise(rest)


def srt_timestamp(x: Column) -> Column:
    return format_timestamp(x, ",")


def vtt_timestamp(x: Column) -> Column:
    return format_timestamp(x, ".")


def format_duration(x: Column) -> Column:
    """MM:SS, hours from one hour on, milliseconds unless they are zero."""
    return F.when(F.isnan(x) | x.isNull(), "00:00").otherwise(F.regexp_replace(format_timestamp(x, ".", always_hours=False), "\\.000$", ""))
