"""Dense zone-by-window panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbwatch.config import Settings
from kerbwatch.functions import clock
from kerbwatch.operators.zones import require_unique
from kerbwatch.session import small_side

# Names and order of the columns.
MEASURES = [
    "violation_count",
    "impact_units",
    "high_severity_count",
    "junction_count",
    "junction_offence_count",
    "main_road_count",
    "heavy_vehicle_count",
    "unique_vehicles",
    "active_devices",
    "active_officers",
    "mean_record_confidence",
]

# Names and order of the columns.
ZONE_COLUMNS = [
    "zone_id",
    "cell_x",
    "cell_y",
    "centroid_latitude",
    "centroid_longitude",
    "police_station",
    "zone_name",
    "primary_junction",
]


def densify(
    df: DataFrame,
    key: str,
    time: str,
    step: Column,
    measures: list[str],
    first: Column | None = None,
    last: Column | None = None,
) -> DataFrame:
    """Fill the time gaps of every key with zero rows.

    Each row is stretched up to the next row of its key, so one shuffle by key is enough: no grid
    is built and joined, and what follows by key and time stays in place. `first` and `last`
    extend every key to common bounds; without them a key spans its own rows.
    """
    by_time = W.partitionBy(key).orderBy(time)
    start = F.col(time)
    if first is not None:
        start = F.when(F.lag(time).over(by_time).isNull(), first).otherwise(start)
    until = F.lead(time).over(by_time) - step
    until = F.coalesce(until, F.col(time) if last is None else last)
    stretched = df.select(
        key, F.col(time).alias("_own"), start.alias("_start"), until.alias("_until"), *measures
    )
    slots = stretched.select(
        key, "_own", F.explode(F.sequence("_start", "_until", step)).alias(time), *measures
    )
    own = F.col(time) == F.col("_own")
    return slots.select(
        key,
        time,
        *[F.when(own, F.col(m).cast("double")).otherwise(F.lit(0.0)).alias(m) for m in measures],
    )


def dense_panel(zone_windows: DataFrame, settings: Settings) -> DataFrame:
    """Every given zone at every window from the first to the last one seen in any of them."""
    first = zone_windows.agg(F.min("window_start")).scalar()
    last = zone_windows.agg(F.max("window_start")).scalar()
    step = clock.hours(settings.temporal.window_hours)
    return densify(zone_windows, "zone_id", "window_start", step, MEASURES, first, last)


def panel_zone_join(panel: DataFrame, zones: DataFrame, settings: Settings) -> DataFrame:
    """Attach the descriptive zone columns; the zone table must have one row per zone."""
    side = require_unique(zones.select(*ZONE_COLUMNS), "zone_id")
    return panel.join(small_side(side, settings.max_zones()), "zone_id", "left")
