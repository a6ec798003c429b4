"""Zone-level operators: activity, names, reference table, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbwatch.config import Settings
from kerbwatch.functions import clock, geo, text
from kerbwatch.functions.scoring import from_steps, in_steps
from kerbwatch.operators.cleaning import grid_centroid
from kerbwatch.session import small_side


def zone_window_agg(records: DataFrame) -> DataFrame:
    """Per zone and window: volume, units, flag counts, distinct actors, mean confidence.

    Units and confidences are summed in whole steps of 1e-8, so a sum does not depend on the order of
    its rows, however large it is. The three exact distinct counts make Spark aggregate first by (zone, window, actor), so a zone
    with a large share of the records is spread over tasks before it is brought together.
    """
    return records.groupBy("zone_id", "window_start").agg(
        F.count("*").alias("violation_count"),
        from_steps(F.sum(in_steps(F.col("obstruction_units")))).alias("impact_units"),
        F.sum("is_high_severity").alias("high_severity_count"),
        F.sum("is_named_junction").alias("junction_count"),
        F.sum("has_junction_offence").alias("junction_offence_count"),
        F.sum("has_main_road_offence").alias("main_road_count"),
        F.sum("is_heavy_vehicle").alias("heavy_vehicle_count"),
        F.count_distinct("canonical_vehicle_number").alias("unique_vehicles"),
        F.count_distinct("device_id").alias("active_devices"),
        F.count_distinct("created_by_id").alias("active_officers"),
        (from_steps(F.sum(in_steps(F.col("record_confidence")))) / F.count("*")).alias(
            "mean_record_confidence"
        ),
    )


def active_zones(zone_windows: DataFrame, settings: Settings) -> DataFrame:
    """Zones with enough records before the test period, from the zone-window table.

    Summing the window counts gives the same zones as counting records, on far fewer rows.
    """
    before_test = F.col("window_start") < clock.ntz(settings.temporal.test_start)
    return (
        zone_windows.filter(before_test)
        .groupBy("zone_id")
        .agg(F.sum("violation_count").alias("training_records"))
        .filter(F.col("training_records") >= settings.grid.min_zone_observations)
    )


def require_zones(zones: DataFrame) -> DataFrame:
    if zones.isEmpty():
        raise ValueError("no zone reaches min_zone_observations; lower the threshold")
    return zones


def in_active_zones(df: DataFrame, zones: DataFrame, settings: Settings) -> DataFrame:
    return df.join(small_side(zones.select("zone_id"), settings.max_zones()), "zone_id", "left_semi")


def _ballots(records: DataFrame, keys: list[str], kinds: dict[str, Column]) -> DataFrame:
    """How often each value occurs per key and kind.

    Records are counted by the combination of their values first, so only the combinations, not the
    records, are multiplied by the number of kinds.
    """
    combined = records.groupBy(*keys, *[c.alias(f"_{k}") for k, c in kinds.items()]).agg(
        F.count("*").alias("_n")
    )
    votes = [F.struct(F.lit(k).alias("kind"), F.col(f"_{k}").alias("value")) for k in kinds]
    return (
        combined.select(*keys, "_n", F.inline(F.array(*votes)))
        .groupBy(*keys, "kind", "value")
        .agg(F.sum("_n").alias("n"))
    )


def _winner(kind: str) -> Column:
    """Most frequent non-null value of a kind; the smallest text wins a tie."""
    counted = (F.col("kind") == kind) & F.col("value").isNotNull()
    return F.min(F.when(counted, F.struct(-F.col("n"), F.col("value").alias("value"))))["value"]


def clean_mode(records: DataFrame, key: str, column: str, default: str) -> DataFrame:
    """Most frequent usable text per key, or the default when there is none."""
    counted = _ballots(records, [key], {"v": text.present(F.col(column))})
    return counted.groupBy(key).agg(F.coalesce(_winner("v"), F.lit(default)).alias("modal_value"))


def _display_name(named: Column, place: Column) -> Column:
    first_part = F.substring(text.strip(F.substring_index(place, ",", 1)), 1, 70)
    road = F.when(first_part != "", first_part)
    return F.coalesce(named, road, F.lit("Mapped road segment"))


def zone_reference(records: DataFrame, settings: Settings) -> DataFrame:
    """One row per zone: cell, station, junction, volume, display name, centroid."""
    junction = text.present(F.col("junction_name"))
    counted = _ballots(
        records,
        ["zone_id", "cell_x", "cell_y"],
        {
            "record": F.lit(None).cast("string"),
            "station": text.present(F.col("police_station")),
            "junction": junction,
            "named": F.when(F.col("is_named_junction") == 1, junction),
            "place": text.present(F.col("location")),
        },
    )
    zones = counted.groupBy("zone_id", "cell_x", "cell_y").agg(
        F.coalesce(_winner("station"), F.lit("Unknown")).alias("police_station"),
        F.coalesce(_winner("junction"), F.lit("No Junction")).alias("primary_junction"),
        F.sum(F.when(F.col("kind") == "record", F.col("n"))).alias("total_records"),
        _display_name(_winner("named"), _winner("place")).alias("zone_name"),
    )
    return grid_centroid(zones, settings.grid)


def zone_display_name(records: DataFrame) -> DataFrame:
    junction = text.present(F.col("junction_name"))
    kinds = {
        "named": F.when(F.col("is_named_junction") == 1, junction),
        "place": text.present(F.col("location")),
    }
    counted = _ballots(records, ["zone_id"], kinds)
    return counted.groupBy("zone_id").agg(
        _display_name(_winner("named"), _winner("place")).alias("zone_name")
    )


def require_unique(df: DataFrame, key: str) -> DataFrame:
    if not df.groupBy(key).count().filter("count > 1").isEmpty():
        raise ValueError(f"{key} is not unique")
    return df


def zone_neighbours(zones: DataFrame, metres: float, settings: Settings) -> DataFrame:
    """Pairs of zones closer than `metres`.

    Each zone looks only at the cells within reach, by an equi-join on cell numbers; the number of
    such cells depends on the distance alone.
    """
    offsets = [
        F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy"))
        for i, j in geo.cell_reach(settings, metres)
    ]
    left = zones.select(
        F.col("zone_id").alias("zone_a"),
        F.col("centroid_latitude").alias("lat_a"),
        F.col("centroid_longitude").alias("lon_a"),
        "cell_x",
        "cell_y",
        F.inline(F.array(*offsets)),
    ).withColumns({"cell_x": F.col("cell_x") + F.col("dx"), "cell_y": F.col("cell_y") + F.col("dy")})
    right = zones.select(
        "cell_x",
        "cell_y",
        F.col("zone_id").alias("zone_b"),
        F.col("centroid_latitude").alias("lat_b"),
        F.col("centroid_longitude").alias("lon_b"),
    )
    distance = geo.haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return (
        left.join(small_side(right, settings.max_zones()), ["cell_x", "cell_y"])
        .filter("zone_a < zone_b")
        .withColumn("metres", distance)
        .filter(F.col("metres") < metres)
        .select("zone_a", "zone_b", "metres")
    )
