"""Local wall-clock expressions. Local times are TIMESTAMP_NTZ, so the session zone never matters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def local_time(instant: Column, timezone: str) -> Column:
    """Wall-clock time of an instant in the given zone."""
    return F.convert_timezone(None, F.lit(timezone), instant)


def hours(n) -> Column:
    count = n if isinstance(n, Column) else F.lit(n)
    return F.make_dt_interval(F.lit(0), count.cast("int"), F.lit(0), F.lit(0))


def window_floor(local: Column, window_hours: int) -> Column:
    """Start of the local window of `window_hours` that holds the time."""
    total = F.unix_date(local.cast("date")) * 24 + F.hour(local)
    return ntz("1970-01-01 00:00:00") + hours(total - F.pmod(total, F.lit(window_hours)))


def is_peak(local: Column) -> Column:
    hour = F.hour(local)
    return ((hour >= 7) & (hour < 11)) | ((hour >= 16) & (hour < 20))


def plan_window_text(start: Column) -> Column:
    return F.concat(
        F.date_format(start, "dd MMM, hh:mm a"),
        F.lit("–"),
        F.date_format(start + hours(2), "hh:mm a"),
    )
