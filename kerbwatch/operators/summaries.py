"""Summary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from kerbwatch.config import Settings
from kerbwatch.functions import clock
from kerbwatch.functions.scoring import OFFENCE_WEIGHTS, snapped
from kerbwatch.operators.panel import densify


def with_row_count(df: DataFrame) -> tuple[DataFrame, Observation]:
    """The same rows, and how many went by as `rows` once something has read them."""
    seen = Observation()
    return df.observe(seen, F.count("*").alias("rows")), seen


def cleaning_summary(clean: DataFrame, source_rows: int, settings: Settings) -> DataFrame:
    """One row about the cleaning; the source rows are counted by the pass that cleans them."""
    named = F.when(F.col("is_named_junction") == 1, F.col("junction_name"))
    summary = clean.agg(
        F.count("*").alias("clean_rows"),
        F.min("created_at").alias("date_min"),
        F.max("created_at").alias("date_max"),
        F.count_distinct("zone_id").alias("zones_before_threshold"),
        F.count_distinct("police_station").alias("police_stations"),
        F.count_distinct(named).alias("named_junctions"),
    )
    source = F.lit(source_rows).cast("bigint")
    return summary.withColumns(
        {
            "source_rows": source,
            "removed_rows": source - F.col("clean_rows"),
            "parking_offence_categories": F.lit(len(OFFENCE_WEIGHTS)),
            "validation_policy": F.lit(settings.data.validation_policy),
        }
    )


def station_summary(clean: DataFrame) -> DataFrame:
    return (
        clean.groupBy("police_station")
        .agg(
            F.count("*").alias("violation_records"),
            F.count_distinct("zone_id").alias("unique_zones"),
            F.avg("obstruction_units").alias("mean_obstruction_units"),
            F.avg("is_high_severity").alias("high_severity_share"),
        )
        .orderBy(F.desc("violation_records"), "police_station")
    )


def default_window(predictions: DataFrame) -> DataFrame:
    """Peak window with the most predicted impact (any window when none is peak), earliest on ties."""
    totals = predictions.groupBy("target_window_start").agg(
        F.max("target_is_peak").alias("_peak"),
        snapped(F.sum("predicted_impact_units")).alias("_impact"),
    )
    best = F.struct(-F.col("_peak"), -F.col("_impact"), F.col("target_window_start"))
    return totals.agg(F.min_by("target_window_start", best).alias("default_window"))


def window_kpis(scored: DataFrame, plan: DataFrame) -> DataFrame:
    """Per window: expected volume and obstruction, critical zones, share covered by the plan."""
    expected = scored.groupBy("target_window_start").agg(
        F.sum("predicted_violation_count").alias("expected_violations"),
        F.sum("predicted_impact_units").alias("expected_obstruction"),
        F.count(F.when(F.col("risk_level") == "Critical", 1)).alias("critical_zones"),
    )
    covered = plan.groupBy("target_window_start").agg(
        F.sum("predicted_impact_units").alias("_covered")
    )
    share = F.when(
        F.col("expected_obstruction") > 0, F.col("_covered") / F.col("expected_obstruction")
    ).otherwise(F.lit(0.0))
    joined = expected.join(covered, "target_window_start", "left")
    return joined.withColumn("plan_coverage", F.coalesce(share, F.lit(0.0))).drop("_covered")


def zone_daily_trend(history: DataFrame) -> DataFrame:
    """Daily volume and obstruction per zone; days without rows are zero."""
    daily = history.groupBy(
        "zone_id", F.col("window_start").cast("date").cast("timestamp_ntz").alias("day")
    ).agg(
        F.sum("violation_count").alias("violations"),
        snapped(F.sum("impact_units")).alias("obstruction_units"),
    )
    dense = densify(daily, "zone_id", "day", clock.hours(24), ["violations", "obstruction_units"])
    return dense.withColumn("day", F.col("day").cast("date"))


def run_summary(
    features: DataFrame, train: Column, test: Column, default: Column, fit_rows: Column, s: Settings
) -> DataFrame:
    """One row about a run; `train` and `test` are conditions on the feature rows."""
    return features.agg(
        F.count_distinct("zone_id").alias("active_model_zones"),
        F.count(F.when(train, 1)).alias("training_rows"),
        F.count(F.when(test, 1)).alias("test_rows"),
        F.count_distinct(F.when(test, F.col("target_window_start"))).alias("test_windows"),
    ).withColumns(
        {
            "model_fit_rows": fit_rows,
            "default_demo_window": default,
            "grid_size_meters": F.lit(s.grid.cell_metres),
            "window_hours": F.lit(s.temporal.window_hours),
        }
    )


def nearest_window(windows: DataFrame, wanted: str) -> DataFrame:
    """Available window closest in time to the wanted one; the earlier wins a tie."""
    target = clock.ntz(wanted)
    distance = F.abs(F.timestamp_diff("SECOND", target, F.col("target_window_start")))
    closest = F.struct(distance, F.col("target_window_start"))
    return windows.agg(F.min_by("target_window_start", closest).alias("nearest_window"))


def distinct_windows(predictions: DataFrame) -> DataFrame:
    return predictions.select("target_window_start").distinct().orderBy("target_window_start")


def distinct_stations(predictions: DataFrame) -> DataFrame:
    stations = predictions.select("police_station").filter(F.col("police_station").isNotNull())
    return stations.distinct().orderBy("police_station")
