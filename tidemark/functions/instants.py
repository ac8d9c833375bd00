"""Instants as text and as nanoseconds, working days, quarters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = r"^(\d{4}-\d\d-\d\d)[T ](\d\d):(\d\d)(?::(\d\d)(?:\.(\d{1,9}))?)?(Z|[+-]\d\d:?\d\d)$"


def parse_nanos(text: Column) -> Column:
    """Nanoseconds since the epoch of ISO text with a zone and at most nine decimals; anything else is null."""
    clean = F.trim(text)
    part = lambda i: F.regexp_extract(clean, _ISO, i)
    whole = F.concat(part(1), F.lit("T"), part(2), F.lit(":"), part(3), F.lit(":"), F.when(part(4) == "", "00").otherwise(part(4)), part(6))
    fraction = F.rpad(part(5), 9, "0")
    seconds = F.unix_seconds(F.try_to_timestamp(whole))
    return F.when(clean.rlike(_ISO), seconds * 10**9 + F.when(part(5) == "", 0).otherwise(fraction.cast("long")))


def nanos_text(nanos: Column) -> Column:
    """Canonical UTC text: no decimals, six, or nine, whichever holds the value."""
    seconds, rest = F.call_function("div", nanos - F.pmod(nanos, F.lit(10**9)), F.lit(10**9)), F.pmod(nanos, F.lit(10**9))
    whole = F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), "UTC"), "yyyy-MM-dd'T'HH:mm:ss")
    decimals = F.when(rest == 0, "").when(rest % 1000 == 0, F.format_string(".%06d", F.call_function("div", rest, F.lit(1000)))).otherwise(F.format_string(".%09d", rest))
    return F.concat(whole, decimals, F.lit("Z"))


def next_weekday(day: Column) -> Column:
    """The Monday-to-Friday day after."""
    return F.date_add(day, F.when(F.dayofweek(day) == 6, 3).when(F.dayofweek(day) == 7, 2).otherwise(1))


def quarter_ends(start: Column, end: Column) -> Column:
    """array<date> of quarter ends from start to end, both included."""
    first = F.trunc(start, "quarter")
    firsts = F.sequence(first, F.greatest(first, F.trunc(end, "quarter")), F.expr("interval 3 months"))
    return F.filter(F.transform(firsts, lambda d: F.date_sub(F.add_months(d, 3).cast("date"), 1)), lambda d: (d >= start) & (d <= end))


def nominal_interval(instant: Column, precision: str, rounding: str = "truncate") -> tuple[Column, Column, bool]:
    """(start, end, end included) of when something printed at minute or date precision may have happened, in UTC.

    Truncated minutes hold the minute that follows; minutes rounded half up hold 30 seconds on either side, the end
    left out; minutes rounded half to even include both ends if the minute is even, else neither (then the ends move
    in by a microsecond). A date holds its day.
    """
    us = F.unix_micros(instant)
    if precision == "date":
        return F.date_trunc("day", instant), F.date_trunc("day", instant) + F.expr("interval 1 day"), False
    if rounding == "truncate":
        return instant, F.timestamp_micros(us + 60_000_000), False
    if rounding == "half_up":
        return F.timestamp_micros(us - 30_000_000), F.timestamp_micros(us + 30_000_000), False
    inward = F.when(F.minute(instant) % 2 == 0, 0).otherwise(1)
    return F.timestamp_micros(us - 30_000_000 + inward), F.timestamp_micros(us + 30_000_000 - inward), True


def admits(cutoff: Column, boundary: Column, inclusive: Column) -> Column:
    """Whether evidence with this boundary may be used at cutoff."""
    return F.when(inclusive, cutoff >= boundary).otherwise(cutoff > boundary)


def local_to_utc(local: Column, zone: str) -> Column:
    """struct<at, status>: 'exact', 'ambiguous' (shown twice; the earlier instant) or 'nonexistent' (skipped; null) local times.

    All by the zone's rules in Spark: a local time exists if going to UTC and back gives it again, and is ambiguous if
    an hour-scale shift of the instant shows the same local time.
    """
    at = F.to_utc_timestamp(local, zone)
    back = lambda t: F.from_utc_timestamp(t, zone) == local
    earlier, later = [F.timestamp_micros(F.unix_micros(at) + d * 60_000_000) for d in (-60, 60)]
    found = F.array_sort(F.filter(F.array(earlier, at, later, *[F.timestamp_micros(F.unix_micros(at) + d * 60_000_000) for d in (-30, 30)]), back))
    status = F.when(F.size(found) == 0, "nonexistent").when(F.size(found) > 1, "ambiguous").otherwise("exact")
    return F.struct(F.get(found, 0).alias("at"), status.alias("status"))
