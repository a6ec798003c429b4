"""Leakage-safe features of the dense panel.

All windows share one partitioning and order (zone, time), so they run behind one exchange and one
sort. A zone has one row per window of the covered period, whatever the record volume. Rolling
sums come from running sums (value now minus value `w` rows ago), which costs the same for any `w`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from kerbwatch.config import TemporalSettings
from kerbwatch.functions import clock
from kerbwatch.functions.scoring import clip, flag, from_steps, in_steps, snapped

SHARES = {
    "junction_share_84": "junction_count",
    "junction_offence_share_84": "junction_offence_count",
    "main_road_share_84": "main_road_count",
    "heavy_vehicle_share_84": "heavy_vehicle_count",
    "high_severity_share_84": "high_severity_count",
}
# Summed in whole steps, so that history of any length loses no digit of a small window.
STEPPED = ("impact_units",)
CONTEXT_MEANS = {
    "repeat_vehicle_rate_84": "repeat_vehicle_rate_window",
    "active_devices_mean_84": "active_devices",
    "active_officers_mean_84": "active_officers",
    "record_confidence_mean_84": "mean_record_confidence",
}
# What running sums are kept of.
RUNNING = ["violation_count", "impact_units", *SHARES.values(), *CONTEXT_MEANS.values()]


def _by_zone() -> WindowSpec:
    return W.partitionBy("zone_id").orderBy("window_start")


def _with_running(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Running sums `_run_<column>` and the row number `_row`, unless already there."""
    by_zone = _by_zone()
    so_far = by_zone.rowsBetween(W.unboundedPreceding, W.currentRow)
    new = {
        f"_run_{c}": F.sum(in_steps(F.col(c)) if c in STEPPED else F.col(c)).over(so_far)
        for c in columns
        if f"_run_{c}" not in panel.columns
    }
    if "_row" not in panel.columns:
        new["_row"] = F.row_number().over(by_zone)
    return panel.withColumns(new) if new else panel


def with_history(panel: DataFrame, carried: DataFrame, rows_before: int) -> DataFrame:
    """Running sums of a panel that starts in the middle, going on from what came before it.

    `carried` has one row per zone with sums of the `RUNNING` columns over the time before (stepped
    ones in whole steps; zones without a row had nothing), `rows_before` is the number of windows.
    """
    before = carried.select("zone_id", *[F.col(c).alias(f"_old_{c}") for c in RUNNING])
    df = _with_running(repeat_vehicle_rate(panel), RUNNING).join(before, "zone_id", "left")
    added = {f"_run_{c}": F.col(f"_run_{c}") + F.coalesce(f"_old_{c}", F.lit(0)) for c in RUNNING}
    df = df.withColumns(added | {"_row": F.col("_row") + rows_before})
    return df.drop(*[f"_old_{c}" for c in RUNNING])


def _rolling_sum(column: str, width: int, by_zone: WindowSpec, scale: float = 1e8) -> Column:
    run = f"_run_{column}"
    past = F.coalesce(F.lag(run, width).over(by_zone), F.lit(0))
    within = F.col(run) - past
    return F.greatest(from_steps(within) if column in STEPPED else snapped(within, scale), F.lit(0.0))


def _rolling_mean(column: str, width: int, by_zone: WindowSpec, scale: float = 1e8) -> Column:
    return _rolling_sum(column, width, by_zone, scale) / F.least(F.col("_row"), F.lit(width))


def drop_helpers(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_run_") or c == "_row"])


def repeat_vehicle_rate(panel: DataFrame) -> DataFrame:
    repeats = 1.0 - F.try_divide("unique_vehicles", "violation_count")
    return panel.withColumn(
        "repeat_vehicle_rate_window", clip(F.coalesce(repeats, F.lit(0.0)), 0.0, 1.0)
    )


def lag_features(panel: DataFrame, temporal: TemporalSettings) -> DataFrame:
    """Lag 1 is the row's own window: the last one completed before the target window."""
    by_zone, lagged = _by_zone(), {}
    for name, column in (("count", "violation_count"), ("impact", "impact_units")):
        for n in temporal.lags:
            lagged[f"{name}_lag_{n}"] = F.lag(column, max(n - 1, 0)).over(by_zone)
    return panel.withColumns(lagged)


def rolling_means(panel: DataFrame, temporal: TemporalSettings) -> DataFrame:
    df = _with_running(panel, ["violation_count", "impact_units"])
    by_zone, means = _by_zone(), {}
    for name, column in (("count", "violation_count"), ("impact", "impact_units")):
        for w in temporal.rolls:
            means[f"{name}_roll_mean_{w}"] = _rolling_mean(column, w, by_zone)
    return df.withColumns(means)


def rolling_shares(panel: DataFrame, temporal: TemporalSettings) -> DataFrame:
    df = _with_running(panel, ["violation_count", *SHARES.values()])
    width = temporal.context_roll
    by_zone = _by_zone()
    total = _rolling_sum("violation_count", width, by_zone)
    shares = {
        out: clip(
            F.coalesce(F.try_divide(_rolling_sum(source, width, by_zone), total), F.lit(0.0)),
            0.0,
            1.0,
        )
        for out, source in SHARES.items()
    }
    return df.withColumns(shares)


def rolling_context_means(panel: DataFrame, temporal: TemporalSettings) -> DataFrame:
    df = _with_running(panel, list(CONTEXT_MEANS.values()))
    width, by_zone = temporal.context_roll, _by_zone()
    return df.withColumns(
        # Rates are fractions of any length, so only the noise of the running sums is dropped.
        {out: _rolling_mean(c, width, by_zone, 1e11) for out, c in CONTEXT_MEANS.items()}
    )


def trend_ratios(panel: DataFrame, temporal: TemporalSettings) -> DataFrame:
    def ratio(name: str) -> Column:
        short = F.col(f"{name}_roll_mean_{temporal.short_roll}")
        return (short + 0.10) / (F.col(f"{name}_roll_mean_{temporal.long_roll}") + 0.10)

    return panel.withColumns({"trend_ratio": ratio("count"), "impact_trend_ratio": ratio("impact")})


def expanding_history(panel: DataFrame) -> DataFrame:
    df = _with_running(panel, ["violation_count", "impact_units"])
    return df.withColumns(
        {
            "history_observations": F.col("_run_violation_count"),
            "zone_expanding_mean_count": F.col("_run_violation_count") / F.col("_row"),
            "zone_expanding_mean_impact": from_steps(F.col("_run_impact_units")) / F.col("_row"),
        }
    )


def forecast_targets(panel: DataFrame, temporal: TemporalSettings) -> DataFrame:
    return panel.withColumns(
        {
            "target_window_start": F.col("window_start") + clock.hours(temporal.window_hours),
            "target_violation_count": F.lead("violation_count").over(_by_zone()),
            "target_impact_units": F.lead("impact_units").over(_by_zone()),
        }
    )


def calendar_features(panel: DataFrame) -> DataFrame:
    target = F.col("target_window_start")
    hour_angle = F.lit(2 * math.pi) * F.hour(target) / 24
    day_angle = F.lit(2 * math.pi) * F.weekday(target) / 7
    return panel.withColumns(
        {
            "target_hour_sin": F.sin(hour_angle),
            "target_hour_cos": F.cos(hour_angle),
            "target_weekday_sin": F.sin(day_angle),
            "target_weekday_cos": F.cos(day_angle),
            "target_is_weekend": flag(F.weekday(target) >= 5),
            "target_is_peak": flag(clock.is_peak(target)),
        }
    )


def warmup_filter(panel: DataFrame, temporal: TemporalSettings) -> DataFrame:
    longest = F.col(f"count_lag_{temporal.lags[-1]}")
    return panel.filter(longest.isNotNull() & F.col("target_violation_count").isNotNull())


def build_features(panel: DataFrame, temporal: TemporalSettings) -> DataFrame:
    df = repeat_vehicle_rate(panel)
    df = lag_features(_with_running(df, RUNNING), temporal)
    df = rolling_means(df, temporal)
    df = rolling_shares(df, temporal)
    df = rolling_context_means(df, temporal)
    df = expanding_history(df)
    df = forecast_targets(df, temporal)
    df = calendar_features(trend_ratios(df, temporal))
    return drop_helpers(warmup_filter(df, temporal))


def feature_columns(temporal: TemporalSettings) -> list[str]:
    """Names of the model features, in model order."""
    return [
        "cell_x",
        "cell_y",
        "centroid_latitude",
        "centroid_longitude",
        "target_hour_sin",
        "target_hour_cos",
        "target_weekday_sin",
        "target_weekday_cos",
        "target_is_weekend",
        "target_is_peak",
        *[f"{kind}_lag_{n}" for kind in ("count", "impact") for n in temporal.lags],
        *[f"{kind}_roll_mean_{w}" for kind in ("count", "impact") for w in temporal.rolls],
        "trend_ratio",
        "impact_trend_ratio",
        *SHARES,
        *CONTEXT_MEANS,
        "history_observations",
        "zone_expanding_mean_count",
        "zone_expanding_mean_impact",
    ]
