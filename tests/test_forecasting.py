"""Blend tests, and forecast quality on made-up rates: zone effect times hour-of-day effect."""

import datetime as dt
from concurrent.futures import Future
from dataclasses import replace
from threading import Timer

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbwatch.config import BoostSettings, ModelSettings, Settings, TemporalSettings
from kerbwatch.operators import blending, evaluation, forecasting, panel
from kerbwatch.plans import stages
from kerbwatch.session import staged
from kerbwatch.sources.model_store import load_models, save_models


def test_saved_blend_weights_are_applied(spark):
    rows = [(3.0, 4.0, 1.0, 2.0), (5.0, 8.0, 1.0, 2.0)]
    names = ["count_lag_84", "impact_lag_84", "count_roll_mean_84", "impact_roll_mean_84"]
    df = spark.createDataFrame(rows, names).withColumns(
        {"predicted_violation_count": F.lit(0.0), "predicted_impact_units": F.lit(0.0)}
    )
    models = forecasting.ForecastModels(
        None, [], 7.0, {"model": 0.0, "count_lag_84": 1.0}, {"model": 0.0, "impact_lag_84": 1.0}
    )
    got = forecasting.blend_forecasts(df, models).collect()
    assert [r["predicted_violation_count"] for r in got] == [3.0, 5.0]
    assert [r["predicted_impact_units"] for r in got] == [4.0, 7.0]


def test_calibration_finds_the_recent_history_signal(spark):
    actual = [9.0, 1.0, 0.0, 7.0, 2.0, 0.0]
    rows = [(dt.datetime(2024, 3, 25, 8 + 2 * (i // 3)), f"Z{i % 3}", y, y, 2.0, 0.0) for i, y in enumerate(actual)]
    df = spark.createDataFrame(
        rows,
        "target_window_start timestamp_ntz, zone_id string, target_violation_count double, "
        "count_lag_84 double, count_roll_mean_84 double, raw double",
    )
    model = replace(ModelSettings(), calibration_grid_step=0.5, minimum_model_blend_weight=0.0)
    best = blending.calibrate_blend(df, "raw", "target_violation_count", "count", model, 1)
    assert best.weights["count_lag_84"] == 1.0 and best.mae == 0.0
    assert best.weighted_capture == pytest.approx(16 / 19)
    alone = df.drop("count_lag_84", "count_roll_mean_84")
    assert blending.calibrate_blend(alone, "raw", "target_violation_count", "count", model, 1).weights == {"model": 1.0}


def test_candidates(spark):
    grid = blending.blend_candidates(spark, 0.1, 0.0).orderBy("candidate").collect()
    assert len(grid) == 66
    assert all(abs(r["model_weight"] + r["lag_weight"] + r["roll_weight"] - 1) < 1e-9 for r in grid)
    only = blending.blend_candidates(spark, 0.1, 1.0).collect()
    assert [(r["model_weight"], r["lag_weight"], r["roll_weight"]) for r in only] == [(1.0, 0.0, 0.0)]


def test_ensemble_weights_must_be_positive(spark):
    members = (BoostSettings("a", 0.0),)
    settings = Settings(model=replace(ModelSettings(), impact_members=members))
    with pytest.raises(ValueError):
        forecasting.impact_ensemble(spark.range(1), settings)


@pytest.fixture(scope="module")
def rate_field(spark):
    """Feature table of zones with steady rates that peak in the morning."""
    rng = np.random.default_rng(11)
    start, n_windows = dt.datetime(2024, 1, 1), 12 * 35
    rows = []
    for z in range(24):
        level = rng.lognormal(-0.6, 0.9)
        peak = rng.integers(3, 9)
        for w in range(n_windows):
            n = int(rng.poisson(level * (0.15 + 2.2 * np.exp(-((w % 12 - peak) ** 2) / 3.0))))
            if n or w in (0, n_windows - 1):
                n = max(n, 1)
                units = round(float(sum(rng.choice([0.9, 1.5, 2.7], n))), 4)
                rows.append((f"Z{z}_0", start + dt.timedelta(hours=2 * w), n, units, 0, 0, 0, 0, 0, n, 1, 1, 1.0))
    schema = "zone_id string, window_start timestamp_ntz, violation_count bigint, impact_units double"
    schema += "".join(f", {m} bigint" for m in panel.MEASURES[2:-1]) + ", mean_record_confidence double"
    boost = BoostSettings("hotspot", 1.0, 14, 0.2, 16, 20, 2.0, 3.0)
    settings = Settings(
        temporal=TemporalSettings(test_start="2024-01-29 00:00:00", test_end="2024-02-05 00:00:00"),
        model=replace(
            ModelSettings(),
            hotspot=boost,
            impact_members=(replace(boost, name="a", weight=1.0), replace(boost, name="b", weight=3.0, max_iter=10)),
        ),
    )
    sparse = spark.createDataFrame(rows, schema)
    zone = sparse.select("zone_id").distinct().select(
        "zone_id", F.regexp_extract("zone_id", "Z(.+)_", 1).cast("int").alias("cell_x"), F.lit(0).alias("cell_y"),
        *[F.lit(0.0).alias(c) for c in panel.ZONE_COLUMNS[3:5]], *[F.lit("x").alias(c) for c in panel.ZONE_COLUMNS[5:]],
    )
    features = staged(stages.features_from(sparse, zone, settings), "rate-field")
    train, test = stages.temporal_split(features, settings.temporal)
    models, info = forecasting.fit_pair(train, settings)
    return settings, train, test, models, info


def test_forecast_beats_both_baselines_on_data_with_signal(spark, rate_field):
    settings, _, test, models, info = rate_field
    frame = staged(forecasting.score_models(models, test, settings), "rate-predictions")
    metrics = {(r["system"], r["target"], r["metric"]): r["value"] for r in evaluation.evaluate_systems(frame, [3]).collect()}
    for target in ("count", "impact"):
        for other in ("same_window_last_week", "seven_day_average"):
            for metric, better in (("mae", min), ("poisson_deviance", min), ("weighted_capture_at_3", max)):
                ours, theirs = metrics["forecast", target, metric], metrics[other, target, metric]
                assert better(ours, theirs) == ours, (target, other, metric, ours, theirs)
    assert frame.agg(F.min("predicted_violation_count")).first()[0] >= 0
    assert frame.agg(F.max("predicted_impact_units")).first()[0] <= models.impact_cap
    assert [m.weight for m in models.impact] == [0.25, 0.75]
    assert info.model_fit_rows == info.hotspot_sample.model_fit_rows


def test_stored_models_forecast_the_same(spark, rate_field, tmp_path):
    settings, _, test, models, _ = rate_field
    loaded = load_models(spark, save_models(spark, models, str(tmp_path / "models")))
    columns = ["zone_id", "window_start", "predicted_violation_count", "predicted_impact_units"]
    a = forecasting.score_models(models, test, settings).select(*columns)
    b = forecasting.score_models(loaded, test, settings).select(*columns)
    assert a.exceptAll(b).isEmpty()


def test_importance_finds_the_signal(spark, rate_field):
    settings, _, test, models, _ = rate_field
    table = forecasting.feature_importance(models, test, settings, group_rows=800)
    rows = table.collect()
    assert len(rows) == 80 and {r["model"] for r in rows} == {"hotspot", "impact"}
    top = [r["feature"] for r in forecasting.importance_topn(table, "hotspot", 5).collect()]
    assert any(f.startswith(("count_", "target_hour", "zone_expanding", "history")) for f in top)
    assert {r["importance_std"] for r in rows} == {0.0}


def _flat(start=0.0):
    return forecasting.BoostedTrees(forecasting.POISSON, start, [])


def test_a_fit_that_was_begun_is_waited_for(spark):
    """The fit on all rows may run beside the one that the blend is chosen with."""
    models = forecasting.ForecastModels(_flat(), [], 3.0)
    info = forecasting.TrainingInfo(None, {})
    begun = Future()
    Timer(0.5, begun.set_result, [(models, info)]).start()
    settings = Settings(model=replace(ModelSettings(), calibration_windows=0))
    got, told = forecasting.train_models(spark.range(3), settings, begun)
    assert got == models and told == info


def test_rows_of_one_group_are_scored_by_several_tasks(spark, monkeypatch):
    settings = Settings()
    names = forecasting.feature_columns(settings.temporal)
    rows = spark.range(40).select(
        F.col("id").cast("string").alias("zone_id"), F.col("id").alias("window_start"),
        *[F.lit(1.0).alias(n) for n in names if n not in ("zone_id", "window_start")],
        F.lit(3.0).alias(forecasting.COUNT_TARGET), F.lit(2.0).alias(forecasting.IMPACT_TARGET),
    )
    asked, kind = [], type(rows)
    plain = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, n, *c: asked.append(n) or plain(self, n, *c))
    monkeypatch.setattr(forecasting, "_SCORED_ROWS", 15)
    table = forecasting.feature_importance(forecasting.ForecastModels(_flat(), [], 1.0), rows, settings).collect()
    assert asked == [3] and len(table) == 2 * len(names)
    assert {r.rows_scored for r in table} == {40} and {r.importance for r in table} == {0.0}
