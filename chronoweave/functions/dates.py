"""Durations, publication dates, years and span midpoints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import strip

# Accepted date layouts once the weekday is removed.
PUB_DATE_LAYOUTS = (
    "d MMM yyyy HH:mm:ss Z",
    "d MMM yyyy HH:mm:ss z",
    "d MMM yyyy HH:mm Z",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
)


def duration_seconds(c: Column) -> Column:
    """``H:M:S``, ``M:S`` or plain seconds; NULL otherwise."""
    t = strip(c)
    parts = F.transform(F.split(t, ":"), lambda p: strip(p).try_cast("bigint"))
    a, b, d = (F.get(parts, i) for i in range(3))
    return (
        F.when(t.rlike(r"^\d+$"), t.try_cast("bigint"))
        .when(F.size(parts) == 3, a * 3600 + b * 60 + d)
        .when(F.size(parts) == 2, a * 60 + b)
    )


def pub_timestamp(c: Column) -> Column:
    """Feed date as an instant; NULL when no layout fits."""
    t = F.regexp_replace(strip(c), r"^[A-Za-z]+,\s*", "")
    t = F.regexp_replace(t, r"\s+(UT|UTC|GMT|Z)$", " +0000")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(layout)) for layout in PUB_DATE_LAYOUTS])


def pub_timestamp_or_epoch(c: Column) -> Column:
    """As :func:`pub_timestamp`, with the first instant of year 1 for missing or bad dates."""
    return F.coalesce(pub_timestamp(c), F.to_timestamp(F.lit("0001-01-01 00:00:00")))


def year_of_iso(c: Column) -> Column:
    """Leading four characters as a year, NULL when they are not a number."""
    return F.when(F.length(c) >= 4, F.substring(c, 1, 4).try_cast("int"))


def mid_year(start: Column, end: Column) -> Column:
    """Middle day of a date span as ``year + day_of_year / 366``."""
    mid = F.date_add(start, F.floor(F.datediff(end, start) / 2).cast("int"))
    return F.year(mid) + F.dayofyear(mid) / F.lit(366.0)


def mid_year_by_month(start: Column, end: Column) -> Column:
    """Middle instant of a span as ``year + zero-based month / 12``."""
    total = F.unix_micros(start.cast("timestamp")) + F.unix_micros(end.cast("timestamp"))
    mid = F.timestamp_micros(F.shiftright(total, 1))
    return F.year(mid) + (F.month(mid) - 1) / F.lit(12.0)


def make_day(year: Column, month: Column, day: Column) -> Column:
    """Date of the parts, NULL for impossible ones or years outside 1..9999."""
    parts_ok = year.between(1, 9999) & month.between(1, 12) & (day >= 1)
    last = F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))
    return F.when(parts_ok, F.when(day <= last, F.make_date(year, month, day)))


def year_start(year: Column) -> Column:
    return F.when(year.between(1, 9999), F.make_date(year, F.lit(1), F.lit(1)))


def year_end(year: Column) -> Column:
    return F.when(year.between(1, 9999), F.make_date(year, F.lit(12), F.lit(31)))


def ordered_pair(a: Column, b: Column) -> tuple[Column, Column]:
    """(low, high) of two endpoints; NULL when either is missing."""
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, F.least(a, b)), F.when(both, F.greatest(a, b))


def clamp_year_range(
    low: Column, high: Column, want_low: Column | None, want_high: Column | None
) -> tuple[Column, Column]:
    """Requested range pulled into the available one, at least one year wide."""
    want_low = low if want_low is None else F.coalesce(want_low, low)
    want_high = high if want_high is None else F.coalesce(want_high, high)
    lo = F.greatest(low, F.least(want_low, high - 1))
    return lo, F.least(high, F.greatest(want_high, lo + 1))
