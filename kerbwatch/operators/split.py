"""Temporal splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbwatch.config import TemporalSettings
from kerbwatch.functions import clock


def temporal_split(features: DataFrame, temporal: TemporalSettings) -> tuple[DataFrame, DataFrame]:
    """Rows whose target lies before the test period, and rows whose target lies in it."""
    target = F.col("target_window_start")
    start, end = clock.ntz(temporal.test_start), clock.ntz(temporal.test_end)
    return features.filter(target < start), features.filter((target >= start) & (target < end))


def require_both(train: DataFrame, test: DataFrame) -> None:
    if train.isEmpty() or test.isEmpty():
        raise ValueError("empty train or test side; adjust test_start and test_end")


def validation_split(train: DataFrame, windows: int) -> tuple[DataFrame, DataFrame]:
    """Hold out the last `windows` target windows; no hold-out when there are too few."""
    nothing = train.filter(F.lit(False))
    if windows < 1:
        return train, nothing
    latest = train.select("target_window_start").distinct().orderBy(F.desc("target_window_start"))
    # One window more than asked for shows whether anything is left to fit on.
    newest = [r[0] for r in latest.limit(windows + 1).collect()]
    if len(newest) <= windows:
        return train, nothing
    # As local wall-clock text: a Python time would become an instant of the driver's own zone.
    cutoff = clock.ntz(str(newest[windows - 1]))
    target = F.col("target_window_start")
    return train.filter(target < cutoff), train.filter(target >= cutoff)
