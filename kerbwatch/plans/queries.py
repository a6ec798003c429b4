"""One registered query per operator, each over the whole `events` table.

Doubles are rounded to six places at the very end, so that results compare across engines. Many
values are short decimals that sit exactly on a rounding edge, where summation noise would decide;
the edge is therefore moved by 0.0003 units of the last place.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import replace

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbwatch.functions import clock, geo, scoring
from kerbwatch.operators import (
    blending,
    cleaning,
    evaluation,
    forecasting,
    panel,
    patrol,
    prioritise,
    ranking,
    sampling,
    split,
    summaries,
    zones,
)
from kerbwatch.operators import features as feats
from kerbwatch.plans import refresh as store
from kerbwatch.plans import stages
from kerbwatch.session import scratch_path, staged, tune
from kerbwatch.sources import exports, panel_store, records
from kerbwatch.sources import model_store as saved
from kerbwatch.sources.events_fixture import event_records, fixture_settings
from kerbwatch.streaming import zone_windows as stream

S = fixture_settings()
T = S.temporal
TEAMS = S.deployment.teams
# Cells are 500 m, so a spacing only matters above that.
SPACING = 600.0
WIDE_SPACING = 2500.0

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    scale = 10.0**places
    return df.select(
        *[
            (F.floor(F.col(c) * scale + 0.5003) / scale).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(fn(tune(spark), sf_dir))

    REGISTRY[fn.__name__] = run
    return fn


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_records(spark, sf_dir)


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_records(raw(spark, sf_dir), S)


def cleaned_once(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Cleaned records with the columns of the zone tables, written for all that read them."""
    return staged(clean(spark, sf_dir).select(*more, *stages.RECORD_COLUMNS), "records")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.active_windows(clean(spark, sf_dir), S)


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.dense_panel(windows(spark, sf_dir), S)


def bare_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.bare_features(clean(spark, sf_dir), S)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline forecast of the test period, without descriptive columns."""
    return stages.baseline_predictions(bare_features(spark, sf_dir), S)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.scored_baseline(clean(spark, sf_dir), S)


def bare_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prioritise.add_operational_scores(predictions(spark, sf_dir))


ROW = ["id", "ingest_seq"]
SLOT = ["zone_id", "window_start"]
TARGET = ["zone_id", "target_window_start"]


# Scans, sources, sinks


@query
def scan_violations(spark, sf_dir):
    path = scratch_path(spark, "records-csv")
    exports.write_table(raw(spark, sf_dir).drop("ingest_seq"), path)
    scanned = records.scan_csv(spark, path)
    return (
        cleaning.with_coordinates(scanned)
        .withColumn("created_datetime", F.col("created_datetime").cast("timestamp_ntz"))
        .select(*records.REQUIRED_COLUMNS)
    )


@query
def write_intermediate(spark, sf_dir):
    path = exports.write_intermediate(clean(spark, sf_dir), scratch_path(spark, "clean"))
    return (
        spark.read.parquet(path)
        .groupBy("window_date")
        .agg(F.count("*").alias("records"), F.sum("obstruction_units").alias("units"))
    )


@query
def export_predictions(spark, sf_dir):
    table = exports.prediction_table(scored(spark, sf_dir))
    path = scratch_path(spark, "predictions")
    exports.write_table(exports.with_offset_text(table, "target_window_start", S.data.timezone), path, "gzip")
    schema = exports.text_times(table, ("target_window_start",))
    return exports.read_table(spark, path, schema, S.data.timezone, ("target_window_start",))


@query
def export_zone_history(spark, sf_dir):
    features = stages.feature_table(clean(spark, sf_dir), S)
    table = exports.zone_history(features, S)
    path = scratch_path(spark, "history")
    exports.write_table(exports.with_offset_text(table, "window_start", S.data.timezone), path, "gzip")
    schema = exports.text_times(table, ("window_start",))
    return exports.read_table(spark, path, schema, S.data.timezone, ("window_start",))


@query
def export_tables(spark, sf_dir):
    """The names and whole numbers of every row of the exported tables, as read back from the files."""
    records_ = cleaned_once(spark, sf_dir)
    seen = stages.active_windows(records_, S)
    reference = stages.active_reference(records_, seen, S)
    features = stages.features_from(seen, reference, S)
    results = staged(
        prioritise.add_operational_scores(stages.baseline_predictions(features, S)), "scored"
    )
    tables = {
        "zone_reference": (reference, ["zone_id", "cell_x", "cell_y", "police_station", "primary_junction", "total_records", "zone_name"]),
        "patrol_plan": (
            patrol.patrol_plan(results, TEAMS, SPACING, S),
            ["zone_id", "team", "rank", "zone_name", "police_station", "recommended_window", "impact_score", "risk_level", "top_reason", "recommended_action"],
        ),
        "station_summary": (summaries.station_summary(records_), ["police_station", "violation_records", "unique_zones"]),
    }
    told = None
    for name, (table, columns) in tables.items():
        path = exports.write_table(table, scratch_path(spark, name))
        back = spark.read.option("header", True).option("escape", '"').csv(path)
        rows = back.select(F.lit(name).alias("artifact"), F.concat_ws("|", *columns).alias("content"))
        told = rows if told is None else told.unionByName(rows)
    return told


@query
def export_json(spark, sf_dir):
    frame = staged(predictions(spark, sf_dir), "predictions")
    metrics = evaluation.evaluate_systems(frame, list(S.deployment.top_k))
    path = exports.write_json(metrics, scratch_path(spark, "metrics"))
    return exports.read_json(spark, path, metrics.schema)


@query
def read_artifacts(spark, sf_dir):
    df = cleaned_once(spark, sf_dir)
    reference = rounded(stages.active_reference(df, stages.active_windows(df, S), S), 9)
    path = exports.write_table(reference, scratch_path(spark, "zone-reference"))
    return exports.read_table(spark, path, reference.schema, S.data.timezone)


# Record level


@query
def dedupe_last(spark, sf_dir):
    kept = cleaning.dedupe_last(raw(spark, sf_dir))
    return kept.select(*ROW, "police_station", "validation_status")


@query
def coord_filter(spark, sf_dir):
    return cleaning.coord_filter(raw(spark, sf_dir), S.data).select(*ROW, "latitude", "longitude")


@query
def validation_filter(spark, sf_dir):
    kept = cleaning.validation_filter(raw(spark, sf_dir), S.data.validation_policy)
    return kept.select(*ROW, "validation_status")


@query
def parse_created_at(spark, sf_dir):
    """The same instants written in five ways, one of them unreadable."""
    utc = F.col("created_datetime").cast("timestamp_ntz")
    spelled = (
        F.when(F.col("_way") == 0, F.col("created_datetime"))
        .when(F.col("_way") == 1, F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(
            F.col("_way") == 2,
            F.date_format(clock.local_time(utc, S.data.timezone), "yyyy-MM-dd HH:mm:ss'+05:30'"),
        )
        .when(F.col("_way") == 3, F.date_format(utc, "dd-MM-yyyy HH:mm:ss"))
        .otherwise(F.lit("not a time"))
    )
    texts = raw(spark, sf_dir).withColumn("_way", F.col("id").cast("bigint") % 5)
    parsed = cleaning.parse_created_at(
        texts.withColumn("created_datetime", spelled), S.data.timezone
    )
    return parsed.select(*ROW, "created_at")


@query
def canonical_text(spark, sf_dir):
    return cleaning.canonical_text(raw(spark, sf_dir)).select(
        *ROW, "canonical_vehicle_type", "canonical_vehicle_number"
    )


@query
def offence_flags(spark, sf_dir):
    names = [scoring.offence_name(o) for o in scoring.OFFENCE_WEIGHTS]
    return cleaning.offence_flags(raw(spark, sf_dir)).select(*ROW, *names)


@query
def parking_filter(spark, sf_dir):
    return cleaning.parking_filter(raw(spark, sf_dir)).select(*ROW, "violation_type")


@query
def offence_severity(spark, sf_dir):
    flagged = cleaning.parking_filter(raw(spark, sf_dir))
    return cleaning.offence_severity(flagged, S.scoring).select(*ROW, "offence_severity")


@query
def vehicle_factor(spark, sf_dir):
    df = cleaning.vehicle_factor(cleaning.canonical_text(raw(spark, sf_dir)))
    return df.select(*ROW, "canonical_vehicle_type", "vehicle_factor")


@query
def road_context(spark, sf_dir):
    return cleaning.road_context(raw(spark, sf_dir)).select(
        *ROW, "is_named_junction", "is_main_road", "is_sensitive_place"
    )


@query
def location_factor(spark, sf_dir):
    df = cleaning.location_factor(cleaning.road_context(raw(spark, sf_dir)), S.scoring)
    return df.select(*ROW, "location_factor")


@query
def peak_factor(spark, sf_dir):
    df = cleaning.parse_created_at(raw(spark, sf_dir), S.data.timezone)
    return cleaning.peak_factor(df, S.scoring).select(*ROW, "is_peak_hour", "peak_factor")


@query
def obstruction_units(spark, sf_dir):
    return clean(spark, sf_dir).select(*ROW, "obstruction_units")


@query
def severity_flags(spark, sf_dir):
    flagged = cleaning.parking_filter(cleaning.canonical_text(raw(spark, sf_dir)))
    df = cleaning.vehicle_factor(cleaning.offence_severity(flagged, S.scoring))
    return cleaning.severity_flags(df).select(
        *ROW, "is_high_severity", "is_heavy_vehicle", "has_main_road_offence", "has_junction_offence"
    )


@query
def record_confidence(spark, sf_dir):
    df = cleaning.record_confidence(cleaning.with_status(raw(spark, sf_dir)))
    return df.select(*ROW, "validation_status", "record_confidence")


@query
def assign_grid(spark, sf_dir):
    df = cleaning.assign_grid(cleaning.coord_filter(raw(spark, sf_dir), S.data), S.grid)
    return df.select(*ROW, "cell_x", "cell_y", "zone_id")


@query
def grid_centroid(spark, sf_dir):
    df = cleaning.assign_grid(cleaning.coord_filter(raw(spark, sf_dir), S.data), S.grid)
    return cleaning.grid_centroid(df, S.grid).select(
        *ROW, "zone_id", "centroid_latitude", "centroid_longitude"
    )


@query
def window_floor(spark, sf_dir):
    df = cleaning.parse_created_at(raw(spark, sf_dir), S.data.timezone)
    return cleaning.window_floor(df, T.window_hours).select(*ROW, "created_at", "window_start")


@query
def fill_defaults(spark, sf_dir):
    return cleaning.fill_defaults(raw(spark, sf_dir)).select(
        *ROW, "police_station", "junction_name", "location", "device_id", "created_by_id"
    )


@query
def offence_explode(spark, sf_dir):
    return cleaning.offence_explode(raw(spark, sf_dir))


@query
def offence_list_severity(spark, sf_dir):
    df = cleaning.offence_list_severity(raw(spark, sf_dir), S.scoring)
    return df.select(*ROW, F.concat_ws("|", "offences").alias("offences"), "list_severity")


@query
def offence_frequency(spark, sf_dir):
    return cleaning.offence_frequency(raw(spark, sf_dir))


@query
def haversine(spark, sf_dir):
    """Distance of every record from the centre of its zone and from the grid origin."""
    df = cleaning.assign_grid(cleaning.coord_filter(raw(spark, sf_dir), S.data), S.grid)
    df = cleaning.grid_centroid(df, S.grid)
    here = (F.col("latitude"), F.col("longitude"))
    origin = (F.lit(S.grid.origin_latitude), F.lit(S.grid.origin_longitude))
    centre = (F.col("centroid_latitude"), F.col("centroid_longitude"))
    return df.select(
        *ROW,
        geo.haversine(*here, *centre).alias("metres_to_centre"),
        geo.haversine(*here, *origin).alias("metres_to_origin"),
    )


@query
def clean_records(spark, sf_dir):
    return clean(spark, sf_dir).select(
        *ROW,
        "created_at",
        "zone_id",
        "window_start",
        "validation_status",
        "canonical_vehicle_type",
        "police_station",
        "offence_severity",
        "obstruction_units",
        "record_confidence",
    )


# Aggregations and zone tables


@query
def cleaning_summary(spark, sf_dir):
    """The cleaned columns it reads are written by the one pass that counts the source rows."""
    source, seen = summaries.with_row_count(raw(spark, sf_dir))
    needed = ["created_at", "zone_id", "police_station", "is_named_junction", "junction_name"]
    kept = staged(cleaning.clean_records(source, S).select(*needed), "summary")
    return summaries.cleaning_summary(kept, seen.get["rows"], S)


@query
def zone_window_agg(spark, sf_dir):
    return zones.zone_window_agg(clean(spark, sf_dir))


@query
def active_zones(spark, sf_dir):
    return zones.active_zones(zones.zone_window_agg(clean(spark, sf_dir)), S)


@query
def active_zone_semijoin(spark, sf_dir):
    df = cleaned_once(spark, sf_dir, "id")
    active = zones.active_zones(zones.zone_window_agg(df), S)
    return zones.in_active_zones(df, active, S).select("id", "zone_id", "window_start")


@query
def zone_reference(spark, sf_dir):
    df = cleaned_once(spark, sf_dir)
    active = zones.active_zones(zones.zone_window_agg(df), S)
    return zones.zone_reference(zones.in_active_zones(df, active, S), S)


@query
def zone_name_join(spark, sf_dir):
    reference = zones.zone_reference(clean(spark, sf_dir), S)
    return reference.select("zone_id", "police_station", "primary_junction", "zone_name")


@query
def clean_mode(spark, sf_dir):
    return zones.clean_mode(clean(spark, sf_dir), "zone_id", "police_station", "Unknown")


@query
def zone_display_name(spark, sf_dir):
    return zones.zone_display_name(clean(spark, sf_dir))


@query
def station_summary(spark, sf_dir):
    return summaries.station_summary(clean(spark, sf_dir))


@query
def zone_neighbours(spark, sf_dir):
    reference = zones.zone_reference(clean(spark, sf_dir), S)
    return zones.zone_neighbours(reference, WIDE_SPACING, S)


# Panel and features


@query
def dense_panel(spark, sf_dir):
    return dense(spark, sf_dir)


@query
def panel_zone_join(spark, sf_dir):
    df = stages.described_panel(clean(spark, sf_dir), S)
    return df.select(*SLOT, "violation_count", *panel.ZONE_COLUMNS[1:])


@query
def repeat_vehicle_rate(spark, sf_dir):
    df = feats.repeat_vehicle_rate(dense(spark, sf_dir))
    return df.select(*SLOT, "repeat_vehicle_rate_window")


@query
def lag_features(spark, sf_dir):
    df = feats.lag_features(dense(spark, sf_dir), T)
    return df.select(*SLOT, *[f"{k}_lag_{n}" for k in ("count", "impact") for n in T.lags])


@query
def rolling_means(spark, sf_dir):
    df = feats.rolling_means(dense(spark, sf_dir), T)
    return df.select(*SLOT, *[f"{k}_roll_mean_{w}" for k in ("count", "impact") for w in T.rolls])


@query
def stored_panel_rolling(spark, sf_dir):
    """Rolling means over the panel stored by zone, which needs no exchange any more."""
    name = panel_store.store_panel(dense(spark, sf_dir), scratch_path(spark, "panel"))
    df = feats.rolling_means(spark.table(name), T)
    return df.select(*SLOT, *[f"{k}_roll_mean_{w}" for k in ("count", "impact") for w in T.rolls])


@query
def rolling_shares(spark, sf_dir):
    return feats.rolling_shares(dense(spark, sf_dir), T).select(*SLOT, *feats.SHARES)


@query
def rolling_context_means(spark, sf_dir):
    df = feats.repeat_vehicle_rate(dense(spark, sf_dir))
    return feats.rolling_context_means(df, T).select(*SLOT, *feats.CONTEXT_MEANS)


@query
def trend_ratios(spark, sf_dir):
    df = feats.trend_ratios(feats.rolling_means(dense(spark, sf_dir), T), T)
    return df.select(*SLOT, "trend_ratio", "impact_trend_ratio")


@query
def expanding_history(spark, sf_dir):
    df = feats.expanding_history(dense(spark, sf_dir))
    return df.select(
        *SLOT, "history_observations", "zone_expanding_mean_count", "zone_expanding_mean_impact"
    )


@query
def forecast_targets(spark, sf_dir):
    df = feats.forecast_targets(dense(spark, sf_dir), T)
    return df.select(*SLOT, "target_window_start", "target_violation_count", "target_impact_units")


@query
def calendar_features(spark, sf_dir):
    df = feats.calendar_features(feats.forecast_targets(dense(spark, sf_dir), T))
    return df.select(
        *SLOT,
        "target_hour_sin",
        "target_hour_cos",
        "target_weekday_sin",
        "target_weekday_cos",
        "target_is_weekend",
        "target_is_peak",
    )


@query
def warmup_filter(spark, sf_dir):
    df = feats.forecast_targets(feats.lag_features(dense(spark, sf_dir), T), T)
    return feats.warmup_filter(df, T).select(*SLOT, "count_lag_84", "target_violation_count")


@query
def build_features(spark, sf_dir):
    """Every feature of every kept row."""
    df = stages.feature_table(clean(spark, sf_dir), S)
    return df.select("zone_id", "target_window_start", *feats.feature_columns(T))


# Splits and samples


@query
def temporal_split(spark, sf_dir):
    train, test = split.temporal_split(bare_features(spark, sf_dir), T)
    sides = train.withColumn("side", F.lit("train")).unionByName(
        test.withColumn("side", F.lit("test"))
    )
    return sides.groupBy("side", "zone_id").agg(
        F.count("*").alias("rows"),
        F.min("target_window_start").alias("first_target"),
        F.max("target_window_start").alias("last_target"),
    )


@query
def validation_split(spark, sf_dir):
    train = staged(split.temporal_split(bare_features(spark, sf_dir), T)[0], "train")
    fit, held = split.validation_split(train, S.model.calibration_windows)
    sides = fit.withColumn("side", F.lit("fit")).unionByName(
        held.withColumn("side", F.lit("validation"))
    )
    return sides.groupBy("side", "zone_id").agg(
        F.count("*").alias("rows"),
        F.min("target_window_start").alias("first_target"),
        F.max("target_window_start").alias("last_target"),
    )


def _train_sample(spark, sf_dir, target="target_violation_count", ratio=3.0):
    train = staged(split.temporal_split(bare_features(spark, sf_dir), T)[0], "train")
    return sampling.negative_sample(train, target, ratio, S.model.random_seed)


@query
def negative_sample(spark, sf_dir):
    sample, _ = _train_sample(spark, sf_dir)
    return sample.select(*SLOT, "target_violation_count", "sample_weight")


@query
def union_samples(spark, sf_dir):
    sample, _ = _train_sample(spark, sf_dir, "target_impact_units", 1.0)
    positive = F.col("target_impact_units") > 0
    return sample.groupBy(positive.alias("positive")).agg(
        F.count("*").alias("rows"), F.sum("sample_weight").alias("total_weight")
    )


@query
def impact_cap(spark, sf_dir):
    sample, _ = _train_sample(spark, sf_dir, "target_impact_units", 2.0)
    top = ranking.quantile(sample, "target_impact_units", 0.999)
    return top.select(F.greatest(F.col("quantile") * 1.5, F.lit(1.0)).alias("impact_cap"))


# Blending; the running mean of a zone stands in for a fitted model


@query
def blend(spark, sf_dir):
    df = split.temporal_split(bare_features(spark, sf_dir), T)[1]
    weights = {"model": 0.5, "count_lag_84": 0.3, "count_roll_mean_84": 0.2}
    value = blending.blend(df, F.col("zone_expanding_mean_count"), "count", weights)
    return df.select(*TARGET, value.alias("blended"))


@query
def blend_candidates(spark, sf_dir):
    """The weight grid, and how many validation rows each entry is tried on."""
    df = staged(split.temporal_split(bare_features(spark, sf_dir), T)[0], "train")
    held = split.validation_split(df, S.model.calibration_windows)[1]
    grid = blending.blend_candidates(spark, S.model.calibration_grid_step, 0.0)
    return grid.withColumn("validation_rows", held.agg(F.count("*").alias("n")).scalar())


@query
def weighted_capture(spark, sf_dir):
    df = staged(predictions(spark, sf_dir), "predictions")
    return evaluation.weighted_capture(
        df, 10, "target_impact_units", "predicted_impact_units"
    )


@query
def blend_objectives(spark, sf_dir):
    train = staged(split.temporal_split(bare_features(spark, sf_dir), T)[0], "train")
    held = split.validation_split(train, S.model.calibration_windows)[1]
    return blending.blend_objectives(
        held, "zone_expanding_mean_count", "target_violation_count", "count", S.model, 10
    )


@query
def calibrate_blend(spark, sf_dir):
    return blending.best_blend(blend_objectives(spark, sf_dir))


# Evaluation


def _rows(spark, sf_dir, systems=None):
    return evaluation.long_form(staged(predictions(spark, sf_dir), "predictions"), systems)


@query
def regression_metrics(spark, sf_dir):
    return evaluation.regression_metrics(_rows(spark, sf_dir))


@query
def spearman_ranks(spark, sf_dir):
    """Average rank of every test row's predicted impact among all test rows."""
    df = staged(predictions(spark, sf_dir), "predictions")
    ranks = ranking.average_ranks(df, [], "predicted_impact_units")
    return ranks.select("predicted_impact_units", "n", "average_rank")


@query
def topk_per_window(spark, sf_dir):
    df = ranking.topk_per_window(
        predictions(spark, sf_dir), 10, "predicted_impact_units", ["target_window_start"]
    )
    return df.select(*TARGET, "rank", "predicted_impact_units")


@query
def topk_intersection(spark, sf_dir):
    return evaluation.topk_intersection(_rows(spark, sf_dir), 10)


@query
def ranking_metrics(spark, sf_dir):
    return evaluation.ranking_metrics(_rows(spark, sf_dir), list(S.deployment.top_k))


@query
def evaluate_systems(spark, sf_dir):
    frame = staged(predictions(spark, sf_dir), "predictions")
    return evaluation.evaluate_systems(frame, list(S.deployment.top_k))


@query
def evaluation_coverage(spark, sf_dir):
    return evaluation.evaluation_coverage(predictions(spark, sf_dir))


@query
def baseline_lift(spark, sf_dir):
    frame = staged(predictions(spark, sf_dir), "predictions")
    metrics = staged(evaluation.evaluate_systems(frame, list(S.deployment.top_k)), "metrics")
    return evaluation.baseline_lift(metrics)


# Prioritisation


@query
def impact_percentile(spark, sf_dir):
    df = prioritise.impact_percentile(predictions(spark, sf_dir))
    return df.select(*TARGET, "impact_percentile", "impact_score")


@query
def window_caps(spark, sf_dir):
    df = prioritise.window_caps(predictions(spark, sf_dir))
    return df.select(*TARGET, "history_cap", "recent_cap")


@query
def model_confidence(spark, sf_dir):
    df = prioritise.model_confidence(prioritise.window_caps(predictions(spark, sf_dir)))
    return df.select(*TARGET, "model_confidence")


@query
def priority_score(spark, sf_dir):
    return bare_scored(spark, sf_dir).select(*TARGET, "impact_score", "priority_score")


@query
def risk_level(spark, sf_dir):
    return bare_scored(spark, sf_dir).select(*TARGET, "impact_score", "risk_level")


@query
def top_reason(spark, sf_dir):
    return prioritise.top_reason(predictions(spark, sf_dir)).select(*TARGET, "top_reason")


@query
def action_for_reason(spark, sf_dir):
    df = prioritise.action_for_reason(prioritise.top_reason(predictions(spark, sf_dir)))
    return df.select(*TARGET, "recommended_action")


@query
def rank_candidates(spark, sf_dir):
    df = prioritise.rank_candidates(bare_scored(spark, sf_dir))
    return df.select(*TARGET, "candidate_rank", "priority_score")


@query
def patrol_plan(spark, sf_dir):
    return patrol.patrol_plan(scored(spark, sf_dir), TEAMS, SPACING, S)


@query
def patrol_plan_wide(spark, sf_dir):
    """Teams 2.5 km apart."""
    return patrol.patrol_plan(scored(spark, sf_dir), TEAMS, WIDE_SPACING, S)


@query
def patrol_plan_station(spark, sf_dir):
    """One station's own plan."""
    return patrol.patrol_plan(scored(spark, sf_dir), TEAMS, SPACING, S, station="Station 1")


# Dashboard tables


@query
def select_window_station(spark, sf_dir):
    df = prioritise.select_window_station(
        scored(spark, sf_dir), "2024-01-25 08:00:00", "Station 1"
    )
    return df.select(*TARGET, "police_station", "impact_score", "priority_score")


@query
def risk_level_filter(spark, sf_dir):
    df = prioritise.risk_level_filter(bare_scored(spark, sf_dir), ["Critical", "High"])
    return df.select(*TARGET, "risk_level")


@query
def top_risk_zones(spark, sf_dir):
    df = prioritise.top_risk_zones(bare_scored(spark, sf_dir), ["Critical", "High"], 50)
    return df.select(*TARGET, "rank", "priority_score", "risk_level")


@query
def map_style(spark, sf_dir):
    df = prioritise.map_style(bare_scored(spark, sf_dir))
    return df.select(*TARGET, F.concat_ws(",", "color").alias("color"), "radius")


@query
def nearest_window(spark, sf_dir):
    df = summaries.distinct_windows(predictions(spark, sf_dir))
    return summaries.nearest_window(df, "2024-01-26 09:00:00")


@query
def distinct_windows(spark, sf_dir):
    return summaries.distinct_windows(predictions(spark, sf_dir))


@query
def distinct_stations(spark, sf_dir):
    return summaries.distinct_stations(zones.zone_reference(clean(spark, sf_dir), S))


@query
def default_window(spark, sf_dir):
    return summaries.default_window(predictions(spark, sf_dir))


@query
def window_kpis(spark, sf_dir):
    df = staged(scored(spark, sf_dir), "scored")
    return summaries.window_kpis(df, patrol.patrol_plan(df, TEAMS, SPACING, S))


@query
def zone_daily_trend(spark, sf_dir):
    """Daily totals of every zone seen, active or not, with its quiet days as zero."""
    return summaries.zone_daily_trend(zones.zone_window_agg(clean(spark, sf_dir)))


@query
def run_summary(spark, sf_dir):
    features = staged(bare_features(spark, sf_dir), "features")
    train, test = split.temporal_split(features, T)
    _, info = sampling.negative_sample(
        train, "target_violation_count", S.model.hotspot.zero_to_positive_ratio, S.model.random_seed
    )
    default = summaries.default_window(stages.with_baseline_forecast(test))
    target = F.col("target_window_start")
    start, end = clock.ntz(T.test_start), clock.ntz(T.test_end)
    return summaries.run_summary(
        features,
        target < start,
        (target >= start) & (target < end),
        default.scalar(),
        F.lit(info.model_fit_rows).cast("bigint"),
        S,
    )


# Streams


def replayed_changes(spark, sf_dir):
    """Changes of the whole table streamed in three batches.

    The earlier half of the events comes first, then the later half; a correction comes a batch after
    the row it corrects. Every batch is a run of its own that goes on from the state of the last.
    """
    arrived, log, checkpoint = (scratch_path(spark, n) for n in ("arrived", "changes", "stream"))
    events = event_records(spark, sf_dir)
    created = F.unix_seconds(F.col("created_datetime").cast("timestamp"))
    ends = events.agg(F.min(created), F.max(created)).first()
    turn = F.when(created < (ends[0] + ends[1]) // 2, 0).otherwise(1) + F.col("ingest_seq").cast("int")
    turns = staged(events.withColumn("turn", turn), "turns")
    for k in range(3):
        turns.filter(F.col("turn") == k).drop("turn").write.mode("append").parquet(arrived)
        streamed = spark.readStream.schema(turns.drop("turn").schema).parquet(arrived)
        stream.run_stream(streamed, log, checkpoint, S)
    return stream.read_changes(spark, log)


@query
def stream_zone_window_agg(spark, sf_dir):
    return stream.zone_windows(replayed_changes(spark, sf_dir))


@query
def stream_dedupe_last(spark, sf_dir):
    return stream.live_records(replayed_changes(spark, sf_dir))


# Refreshed tables


_REFRESHED: dict[tuple[str, str], str] = {}


def refreshed_store(spark, sf_dir):
    """A store that took in the table in two batches: then the corrections and one day of late records.

    Once per session and table.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _REFRESHED:
        root = scratch_path(spark, "store")
        arrived = staged(event_records(spark, sf_dir), "arrived")
        store.create_store(spark, root, arrived, S)
        late = (F.col("created_datetime").substr(1, 10) == "2024-01-27") | (F.col("ingest_seq") > 0)
        for batch in (arrived.filter(~late), arrived.filter(late)):
            store.refresh(batch, root, S)
        _REFRESHED[key] = root
    return _REFRESHED[key]


@query
def refresh_intermediate(spark, sf_dir):
    """Records and units per day after a refresh."""
    days = store.read_stored(spark, refreshed_store(spark, sf_dir), "records").groupBy("window_date")
    return days.agg(F.count("*").alias("records"), F.sum("obstruction_units").alias("units"))


@query
def refresh_features(spark, sf_dir):
    """Every feature of every kept row after a refresh, but for the columns of the zone."""
    df = store.read_stored(spark, refreshed_store(spark, sf_dir), "features")
    of_zone = ("cell_x", "cell_y", "centroid_latitude", "centroid_longitude")
    return df.select(*TARGET, *[c for c in feats.feature_columns(T) if c not in of_zone])


# Fitted forecasts


def _full_split(spark, sf_dir):
    features = staged(stages.feature_table(clean(spark, sf_dir), S), "features")
    return split.temporal_split(features, T)


@query
def feature_vector(spark, sf_dir):
    """Length and sum of every row's feature vector; the sum of forty values to three places."""
    df = forecasting.feature_vector(stages.feature_table(clean(spark, sf_dir), S), S)
    values = vector_to_array("features")
    return df.select(
        *TARGET,
        F.size(values).alias("features"),
        F.aggregate(values, F.lit(0.0), lambda a, v: a + v).alias("feature_sum"),
    ).transform(rounded, 3)


_FITTED: dict[tuple[str, str], tuple] = {}


def _fitting(spark, sf_dir) -> tuple[DataFrame, DataFrame, Future]:
    """Training rows, test rows and the models being fitted to them; once per session and table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FITTED or (_FITTED[key][2].done() and _FITTED[key][2].exception()):
        train, test = _full_split(spark, sf_dir)
        pool = ThreadPoolExecutor(1)
        _FITTED[key] = (train, test, pool.submit(forecasting.fit_pair, train, S))
        pool.shutdown(wait=False)
    return _FITTED[key]


def _fitted(spark, sf_dir):
    """Training rows, test rows and the models fitted to them."""
    train, test, pair = _fitting(spark, sf_dir)
    return train, test, pair.result()


def _outside(forecast: str, cap=None):
    """How many forecasts are missing, negative, not finite or above the cap."""
    good = (F.col(forecast) >= 0) & (F.col(forecast) < float("inf"))
    if cap is not None:
        good = good & (F.col(forecast) <= cap)
    return F.count(F.when(~F.coalesce(good, F.lit(False)), 1)).alias("outside")


@query
def hotspot_model(spark, sf_dir):
    """Per test window: rows, their volume, and how many forecasts are no possible volume."""
    _, test, (models, info) = _fitted(spark, sf_dir)
    df = test.withColumn("predicted_violation_count", models.hotspot.predict(forecasting.feature_array(S)))
    return df.groupBy("target_window_start").agg(
        F.count("*").alias("rows"),
        F.sum("target_violation_count").cast("bigint").alias("actual"),
        _outside("predicted_violation_count"),
        F.lit(info.hotspot_sample.model_fit_rows).cast("bigint").alias("fit_rows"),
    )


@query
def impact_model(spark, sf_dir):
    """Per test window: rows, their obstruction, the cap, and forecasts that lie outside of it."""
    train, test = _full_split(spark, sf_dir)
    boost = S.model.impact_members[0]
    single = replace(S, model=replace(S.model, impact_members=(), impact_base=boost))
    members, cap, _ = forecasting.impact_ensemble(train, single)
    made = members[0].model.predict(forecasting.feature_array(S))
    df = test.withColumn("_v", scoring.clip(made, 0.0, cap))
    return df.groupBy("target_window_start").agg(
        F.count("*").alias("rows"),
        scoring.snapped(F.sum("target_impact_units")).alias("actual"),
        _outside("_v", cap),
        F.lit(float(cap)).alias("impact_cap"),
    )


@query
def impact_ensemble(spark, sf_dir):
    """Fitted members: normalised weights, sample sizes and the shared prediction cap."""
    _, _, (models, info) = _fitted(spark, sf_dir)
    rows = [(m.name, m.weight, info.impact_samples[m.name].model_fit_rows, models.impact_cap) for m in models.impact]
    return spark.createDataFrame(
        rows, "member string, weight double, fit_rows bigint, impact_cap double"
    )


@query
def score_models(spark, sf_dir):
    """Per test window: rows, the cap, and forecasts of either kind that are impossible."""
    _, test, (models, _) = _fitted(spark, sf_dir)
    df = forecasting.score_models(models, test, S)
    return df.groupBy("target_window_start").agg(
        F.count("*").alias("rows"),
        _outside("predicted_violation_count").alias("outside_count"),
        _outside("predicted_impact_units", models.impact_cap).alias("outside_impact"),
        F.lit(float(models.impact_cap)).alias("impact_cap"),
    )


@query
def train_models(spark, sf_dir):
    """All systems evaluated on the test period after the blend was chosen on the last training
    windows. What the forecast scores depends on trees, so only that it is finite is told; the
    baselines' scores are told in full."""
    train, test, pair = _fitting(spark, sf_dir)
    models, _ = forecasting.train_models(train, S, pair)
    frame = staged(forecasting.score_models(models, test, S), "predictions")
    metrics = evaluation.evaluate_systems(frame, list(S.deployment.top_k))
    finite = F.when(F.abs("value") < float("inf"), 1.0).otherwise(0.0)
    told = F.when(F.col("system") == "forecast", finite).otherwise(F.col("value"))
    return metrics.select("system", "target", "metric", told.alias("value"))


def _importance(spark, sf_dir):
    _, test, (models, _) = _fitted(spark, sf_dir)
    return forecasting.feature_importance(models, test, S)


@query
def feature_importance(spark, sf_dir):
    """Every model and feature, on how many rows it was scored, and that its loss is finite."""
    table = _importance(spark, sf_dir)
    finite = F.abs("importance") < float("inf")
    return table.select("model", "feature", "rows_scored", finite.alias("finite"), "importance_std")


@query
def importance_topn(spark, sf_dir):
    """How many features the list of one model has, and whether it runs downwards."""
    table = staged(_importance(spark, sf_dir), "importance")
    top = forecasting.importance_topn(table, "impact")
    mine = table.filter("model = 'impact'")
    better = mine.join(top.select("feature"), "feature", "left_anti").agg(F.max("importance")).scalar()
    return top.agg(
        F.count_distinct("feature").alias("features"),
        (F.min("importance") >= better).alias("largest"),
        F.min("model").alias("model"),
    )


@query
def model_store(spark, sf_dir):
    """Per test window: forecasts of saved and loaded models, and how many differ from the originals."""
    _, test, (models, _) = _fitted(spark, sf_dir)
    path = saved.save_models(spark, models, scratch_path(spark, "models"))
    names = ["predicted_violation_count", "predicted_impact_units"]
    before = forecasting.score_models(models, test, S).select(*TARGET, *names)
    loaded = saved.load_models(spark, path)
    after = forecasting.score_models(loaded, test, S).select(*TARGET, *[F.col(n).alias(f"new_{n}") for n in names])
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"new_{n}"))
    return before.join(after, TARGET).groupBy("target_window_start").agg(
        F.count("*").alias("rows"), F.count(F.when(~same, 1)).alias("different")
    )
