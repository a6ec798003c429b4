"""The whole batch run: records in, tables, models and plans out."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbwatch.config import Settings
from kerbwatch.functions import clock
from kerbwatch.operators import evaluation, forecasting, patrol, prioritise, summaries
from kerbwatch.operators.cleaning import clean_records
from kerbwatch.operators.features import feature_columns
from kerbwatch.operators.split import require_both, temporal_split
from kerbwatch.operators.zones import require_zones
from kerbwatch.plans import stages
from kerbwatch.session import tune
from kerbwatch.sources import exports
from kerbwatch.sources.model_store import save_models


@dataclass(frozen=True)
class RunResult:
    metrics: DataFrame
    data_summary: DataFrame
    patrol_plan: DataFrame
    predictions: DataFrame


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _write_document(spark: SparkSession, values: dict, path: str) -> None:
    """One JSON document as it is, on one line."""
    text = spark.createDataFrame([(json.dumps(values, default=str),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(path)


def run_pipeline(spark: SparkSession, raw: DataFrame, output: str, settings: Settings) -> RunResult:
    """Clean, aggregate, fit, score, evaluate, plan and export under `output`.

    `output` must be reachable by all executors. The cleaned records and the feature table are
    written once and read back with column pruning by everything that follows.
    """
    tune(spark)
    temporal = settings.temporal
    source, seen = summaries.with_row_count(raw)
    cleaned_at = exports.write_intermediate(
        clean_records(source, settings), f"{output}/processed/cleaned"
    )
    source_rows = seen.get["rows"]
    clean = spark.read.parquet(cleaned_at).drop("window_date")

    windows = stages.active_windows(clean, settings)
    require_zones(windows)
    reference = stages.active_reference(clean, windows, settings)
    features = _kept(
        stages.features_from(windows, reference, settings), f"{output}/processed/features"
    )
    train, test = temporal_split(features, temporal)
    require_both(train, test)

    models, info = forecasting.train_models(train, settings)
    save_models(spark, models, f"{output}/models")

    predictions = _kept(
        prioritise.add_operational_scores(forecasting.score_models(models, test, settings)),
        f"{output}/processed/predictions",
    )
    metrics = _kept(
        evaluation.evaluate_systems(predictions, list(settings.deployment.top_k)),
        f"{output}/processed/metrics",
    )
    importance = forecasting.feature_importance(models, test, settings)
    # As local wall-clock text: a Python time would become an instant of the driver's own zone.
    default = clock.ntz(str(summaries.default_window(predictions).first()[0]))
    plan = _kept(
        patrol.patrol_plan(
            predictions.filter(F.col("target_window_start") == default),
            settings.deployment.teams,
            settings.deployment.minimum_team_metres,
            settings,
        ),
        f"{output}/processed/patrol_plan",
    )
    if settings.deployment.teams > 0 and plan.isEmpty():
        raise RuntimeError("the plan of the default window is empty")

    artifacts = f"{output}/artifacts"
    zone = settings.data.timezone
    shown = exports.with_offset_text(
        exports.prediction_table(predictions), "target_window_start", zone
    )
    history = exports.with_offset_text(exports.zone_history(features, settings), "window_start", zone)
    exports.write_table(shown, f"{artifacts}/predictions", "gzip")
    exports.write_table(history, f"{artifacts}/zone_history", "gzip")
    exports.write_table(reference, f"{artifacts}/zone_reference")
    exports.write_table(importance.drop("rows_scored"), f"{artifacts}/feature_importance")
    exports.write_table(plan, f"{artifacts}/patrol_plan")
    exports.write_table(summaries.station_summary(clean), f"{artifacts}/station_summary")

    target = F.col("target_window_start")
    start, end = clock.ntz(temporal.test_start), clock.ntz(temporal.test_end)
    about_run = summaries.run_summary(
        features,
        target < start,
        (target >= start) & (target < end),
        default,
        F.lit(info.model_fit_rows).cast("bigint"),
        settings,
    )
    about_data = summaries.cleaning_summary(clean, source_rows, settings)
    summary = _one_row(
        spark,
        _as_text(about_data, ["date_min", "date_max"], zone),
        _as_text(about_run, ["default_demo_window"], zone),
    )
    exports.write_json(summary, f"{artifacts}/data_summary")
    exports.write_json(
        metrics.unionByName(_coverage_rows(predictions)), f"{artifacts}/metrics"
    )
    covered = evaluation.evaluation_coverage(predictions)
    times = [c for c, kind in covered.dtypes if kind == "timestamp_ntz"]
    exports.write_json(_as_text(covered, times, zone), f"{artifacts}/evaluation_coverage")
    metadata = {
        "hotspot_loss": "poisson",
        "impact_loss": "squared_error",
        "impact_target_transform": "log1p/expm1",
        "settings": asdict(settings),
        "feature_columns": feature_columns(temporal),
        "training_sample": info.as_dict(),
        "default_demo_window": summary.first()["default_demo_window"],
    }
    _write_document(spark, metadata, f"{output}/models/metadata")
    manifest = {
        "source_rows": summary.first()["source_rows"],
        "artifacts": [
            "data_summary", "evaluation_coverage", "feature_importance", "metrics", "patrol_plan",
            "predictions", "station_summary", "zone_history", "zone_reference",
        ],
        "models": ["metadata", "numbers", "trees"],
    }
    _write_document(spark, manifest, f"{artifacts}/run_manifest")
    return RunResult(metrics, summary, plan, predictions)


def _as_text(df: DataFrame, times: list[str], zone: str) -> DataFrame:
    for name in times:
        df = exports.with_offset_text(df, name, zone)
    return df


def _one_row(spark: SparkSession, *rows: DataFrame) -> DataFrame:
    """Tables of one row side by side."""
    values: dict = {}
    kinds: list[str] = []
    for row in rows:
        values |= row.first().asDict()
        kinds += [f"{name} {kind}" for name, kind in row.dtypes]
    return spark.createDataFrame([tuple(values.values())], ", ".join(kinds))


def _coverage_rows(predictions: DataFrame) -> DataFrame:
    """Evaluation coverage in the shape of the metrics table."""
    cover = evaluation.evaluation_coverage(predictions)
    entries = [
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"))
        for n in ("rows", "windows", "zones")
    ]
    return cover.select(
        F.lit("all").alias("system"), F.lit("coverage").alias("target"), F.inline(F.array(*entries))
    )
