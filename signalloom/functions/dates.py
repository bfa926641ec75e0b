"""Date functions as Column expressions.  The session time zone is UTC."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3600.0
DAY = 86400.0


def moment(as_of: datetime | Column | str) -> Column:
    """The explicit "now" of a computation."""
    if isinstance(as_of, Column):
        return as_of
    return F.to_timestamp(F.lit(str(as_of)))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1_000_000.0)


def hours_between(a: Column, b: Column) -> Column:
    return F.abs(F.unix_micros(a) - F.unix_micros(b)) / F.lit(3_600_000_000.0)


def iso_duration_seconds(text: Column) -> Column:
    """``PT#H#M#S`` as seconds; null when it does not parse."""
    shape = r"^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?$"

    def part(i: int) -> Column:
        return F.coalesce(F.regexp_extract(text, shape, i).try_cast("bigint"), F.lit(0).cast("bigint"))

    return F.when(text.rlike(shape) & text.rlike(r"\d"), part(1) * 3600 + part(2) * 60 + part(3))


def short_date(ts: Column) -> Column:
    return F.upper(F.date_format(ts, "MMM dd yyyy"))


def day_key(ts: Column) -> Column:
    return F.to_date(ts)


def days_ago(days: int, as_of) -> Column:
    return moment(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")


def needed_days(days: int, as_of) -> Column:
    """The day keys covering ``days`` back, newest first, both ends included."""
    end = F.to_date(moment(as_of))
    return F.sequence(end, F.date_sub(end, days), F.expr("INTERVAL -1 DAY"))


def parse_instant(text: Column) -> Column:
    """ISO or RFC-822 text to a timestamp, null when neither parses."""
    rfc = F.regexp_replace(text, r"^[A-Za-z]{3},\s*", "")
    rfc = F.regexp_replace(rfc, r"\b(GMT|UT|UTC|Z)$", "+0000")
    return F.coalesce(
        F.try_to_timestamp(text),
        F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss xx")),
        F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm xx")),
    )


def time_ago(ts: Column, as_of) -> Column:
    def half_up(x: Column) -> Column:
        return F.floor(x + 0.5)

    s = F.greatest(F.lit(0), half_up(seconds_between(moment(as_of), ts)))
    m = half_up(s / 60)
    h = half_up(m / 60)
    d = half_up(h / 24)
    return (
        F.when(ts.isNull(), F.lit(""))
        .when(s < 60, F.lit("just now"))
        .when(m < 60, F.concat(m.cast("string"), F.lit(" min ago")))
        .when(h < 24, F.concat(h.cast("string"), F.lit(" h ago")))
        .otherwise(F.concat(d.cast("string"), F.lit(" d ago")))
    )


def freshness_class(ts: Column, as_of) -> Column:
    age = seconds_between(moment(as_of), ts) / HOUR
    return (
        F.when(ts.isNull(), F.lit("unknown"))
        .when(age < 1, F.lit("fresh"))
        .when(age < 24, F.lit("recent"))
        .otherwise(F.lit("old"))
    )
