"""The stages of a run, each built from the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbwatch.config import Settings
from kerbwatch.functions import clock
from kerbwatch.operators import features as feats
from kerbwatch.operators import panel, prioritise, zones
from kerbwatch.operators.split import temporal_split
from kerbwatch.session import staged


# What the zone-window and zone tables read of a cleaned record.
RECORD_COLUMNS = [
    "zone_id", "window_start", "cell_x", "cell_y", "obstruction_units", "is_high_severity",
    "is_named_junction", "has_junction_offence", "has_main_road_offence", "is_heavy_vehicle",
    "canonical_vehicle_number", "device_id", "created_by_id", "record_confidence",
    "police_station", "junction_name", "location",
]


def active_windows(clean: DataFrame, settings: Settings) -> DataFrame:
    """Zone-window table of the active zones, written once: several branches start from it.

    A zone is active by the records it had before the test period, which its windows add up to.
    """
    early = F.col("window_start") < clock.ntz(settings.temporal.test_start)
    seen = F.sum(F.when(early, F.col("violation_count"))).over(W.partitionBy("zone_id"))
    table = zones.zone_window_agg(clean).withColumn("_seen", seen)
    active = table.filter(F.col("_seen") >= settings.grid.min_zone_observations).drop("_seen")
    return staged(active, "zone-windows")


def active_reference(clean: DataFrame, windows: DataFrame, settings: Settings) -> DataFrame:
    kept = zones.in_active_zones(clean, windows.select("zone_id").distinct(), settings)
    return staged(zones.zone_reference(kept, settings), "zone-reference")


def described_panel(clean: DataFrame, settings: Settings) -> DataFrame:
    clean = staged(clean.select(*RECORD_COLUMNS), "records")
    windows = active_windows(clean, settings)
    reference = active_reference(clean, windows, settings)
    return panel.panel_zone_join(panel.dense_panel(windows, settings), reference, settings)


def features_from(windows: DataFrame, reference: DataFrame, settings: Settings) -> DataFrame:
    """Feature table; the zone columns join last, so the windows sort narrow rows."""
    features = feats.build_features(panel.dense_panel(windows, settings), settings.temporal)
    return panel.panel_zone_join(features, reference, settings)


def feature_table(clean: DataFrame, settings: Settings) -> DataFrame:
    """Features of every kept row; the records are cleaned once and read twice."""
    clean = staged(clean.select(*RECORD_COLUMNS), "records")
    windows = active_windows(clean, settings)
    return features_from(windows, active_reference(clean, windows, settings), settings)


def bare_features(clean: DataFrame, settings: Settings) -> DataFrame:
    """Features without the descriptive zone columns; the records are read once."""
    dense = panel.dense_panel(active_windows(clean, settings), settings)
    return feats.build_features(dense, settings.temporal)


def with_baseline_forecast(features: DataFrame) -> DataFrame:
    """Seven-day averages as the forecast: a forecast that needs no fitting."""
    return features.withColumns(
        {
            "predicted_violation_count": F.col("count_roll_mean_84"),
            "predicted_impact_units": F.col("impact_roll_mean_84"),
        }
    )


def baseline_predictions(features: DataFrame, settings: Settings) -> DataFrame:
    return with_baseline_forecast(temporal_split(features, settings.temporal)[1])


def scored_baseline(clean: DataFrame, settings: Settings) -> DataFrame:
    predictions = baseline_predictions(feature_table(clean, settings), settings)
    return prioritise.add_operational_scores(predictions)
