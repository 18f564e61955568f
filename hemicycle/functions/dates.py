"""Date helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_an_date(text: Column) -> Column:
    """ISO date, else the long form weekday-dd-MM-month-yyyy; NULL when neither."""
    parts = F.split(text, "-")

    def two(part: Column) -> Column:
        return F.when(F.length(part) < 2, F.lpad(part, 2, "0")).otherwise(part)

    built = F.concat_ws(
        "-",
        F.get(parts, F.size(parts) - 1),
        two(F.get(parts, F.lit(2))),
        two(F.get(parts, F.lit(1))),
    )
    long_form = F.when(F.size(parts) >= 3, F.try_to_date(built, "yyyy-MM-dd"))
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), long_form)


def year_of(date: Column) -> Column:
    return F.year(date)


def month_of(date: Column) -> Column:
    return F.month(date)


def to_date_coerce(text: Column, fmt: str = "yyyy-MM-dd") -> Column:
    return F.try_to_date(text, fmt)


def month_period(date: Column) -> Column:
    return F.date_trunc("month", date).cast("date")


def now_timestamp() -> Column:
    return F.current_timestamp()


def duration_seconds(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)
