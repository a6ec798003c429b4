import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kerbwatch.config import Settings, TemporalSettings
from kerbwatch.operators import features, panel, split, zones
from kerbwatch.sources.panel_store import store_panel
from kerbwatch.sources.events_fixture import event_records, fixture_settings
from kerbwatch.operators.cleaning import clean_records

S = Settings(temporal=TemporalSettings(test_start="2024-02-01 00:00:00", test_end="2024-02-08 00:00:00"))
START = dt.datetime(2024, 1, 1)


def zone_windows(spark, n_zones=3, n_windows=400, seed=1, scale=1.0):
    """Sparse zone-window table with random activity."""
    rng = np.random.default_rng(seed)
    rows = []
    for z in range(n_zones):
        for w in range(n_windows):
            n = int(rng.poisson(0.4))
            if n or w in (0, n_windows - 1):
                n = max(n, 1)
                units = round(float(rng.uniform(0.5, 4.0)) * scale, 4)
                rows.append(
                    (f"Z{z}_0", START + dt.timedelta(hours=2 * w), n, units, 0, n // 2, 0, n // 3, 0,
                     max(1, n - 1), 1, 1, 0.75)
                )
    schema = "zone_id string, window_start timestamp_ntz, violation_count bigint, impact_units double"
    schema += "".join(f", {m} bigint" for m in panel.MEASURES[2:-1]) + ", mean_record_confidence double"
    return spark.createDataFrame(rows, schema)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_dense_panel_is_complete(spark):
    sparse = zone_windows(spark).filter("NOT (zone_id = 'Z1_0' AND window_start < '2024-01-05')")
    dense = panel.dense_panel(sparse, S)
    assert dense.count() == 3 * 400
    assert dense.groupBy("zone_id").agg(F.min("window_start"), F.max("window_start")).distinct().count() == 3
    total = sparse.agg(F.sum("violation_count")).first()[0]
    assert dense.agg(F.sum("violation_count")).first()[0] == total


def test_features_match_pandas(spark):
    dense = panel.dense_panel(zone_windows(spark), S).persist()
    got = features.build_features(dense, S.temporal).toPandas().set_index(["zone_id", "window_start"]).sort_index()
    pdf = dense.toPandas().sort_values(["zone_id", "window_start"]).reset_index(drop=True)
    by_zone = pdf.groupby("zone_id")
    for lag in (1, 2, 3, 12, 84):
        pdf[f"count_lag_{lag}"] = by_zone["violation_count"].shift(lag - 1)
    for width in (12, 84, 336):
        rolled = by_zone["impact_units"].rolling(width, min_periods=1).mean()
        pdf[f"impact_roll_mean_{width}"] = rolled.reset_index(level=0, drop=True)
    sums = by_zone[["violation_count", "junction_count"]].rolling(84, min_periods=1).sum()
    sums = sums.reset_index(level=0, drop=True)
    pdf["junction_share_84"] = (sums["junction_count"] / sums["violation_count"]).fillna(0)
    pdf["target_violation_count"] = by_zone["violation_count"].shift(-1)
    pdf["history_observations"] = by_zone["violation_count"].cumsum()
    want = pdf.dropna(subset=["count_lag_84", "target_violation_count"]).set_index(["zone_id", "window_start"])
    assert len(got) == len(want) == 3 * (400 - 83 - 1)
    for column in ("count_lag_1", "count_lag_84", "impact_roll_mean_12", "impact_roll_mean_336",
                   "junction_share_84", "target_violation_count", "history_observations"):
        np.testing.assert_allclose(got[column], want.sort_index()[column], atol=1e-9)


def test_no_feature_sees_the_future(spark):
    cut = "2024-01-25 00:00:00"
    sparse = zone_windows(spark)
    changed = sparse.withColumn(
        "violation_count", F.when(F.col("window_start") > cut, F.col("violation_count") + 7).otherwise(F.col("violation_count"))
    ).withColumn("impact_units", F.when(F.col("window_start") > cut, 99.0).otherwise(F.col("impact_units")))
    names = [c for c in features.feature_columns(S.temporal) if not c.startswith(("cell_", "centroid_"))]

    def past(df):
        built = features.build_features(panel.dense_panel(df, S), S.temporal)
        return rows_of(built.filter(F.col("window_start") <= cut).select("zone_id", "window_start", *names))

    assert past(sparse) == past(changed)


def test_features_use_one_exchange_by_zone(spark):
    sparse = zone_windows(spark)
    built = features.build_features(panel.dense_panel(sparse, S), S.temporal)
    plan = built._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery")[0]
    assert plan.count("Exchange hashpartitioning(zone_id") == 1
    assert "SinglePartition" not in main


def test_results_do_not_depend_on_partition_count(spark):
    settings = fixture_settings()

    def result(partitions):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        clean = clean_records(event_records(spark, "/root/testdata/sf0.001"), settings).repartition(partitions)
        windows = zones.zone_window_agg(clean)
        built = features.build_features(panel.dense_panel(windows, settings), settings.temporal)
        return rows_of(built.drop("repeat_vehicle_rate_window"))

    try:
        results = [result(n) for n in (1, 5)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert results[0] == results[1]


def test_feature_list():
    names = features.feature_columns(TemporalSettings(lag_windows=(1, 2, 84)))
    assert {"count_lag_84", "impact_roll_mean_336", "trend_ratio"} <= set(names)
    assert len(features.feature_columns(TemporalSettings())) == 40


def test_zone_table_must_be_unique(spark):
    zone = spark.createDataFrame([("Z0_0", 0, 0, 12.9, 77.5, "S", "N", "J")] * 2, panel.ZONE_COLUMNS)
    with pytest.raises(ValueError):
        panel.panel_zone_join(panel.dense_panel(zone_windows(spark), S), zone, S)


def test_no_active_zone_is_an_error(spark):
    with pytest.raises(ValueError):
        zones.require_zones(zones.active_zones(zone_windows(spark, n_windows=5), S))


def test_mode_prefers_frequent_then_smallest(spark):
    rows = [("a", "y"), ("a", " x"), ("a", "NULL"), ("b", None), ("b", "none"), ("c", "p"), ("c", "q"), ("c", "q")]
    df = spark.createDataFrame(rows, "zone_id string, s string")
    got = dict(zones.clean_mode(df, "zone_id", "s", "Unknown").collect())
    assert got == {"a": "x", "b": "Unknown", "c": "q"}


def test_display_name(spark):
    rows = [
        ("a", 1, "Square", "Road 1, Ward"), ("a", 0, "No Junction", "Road 2"), ("b", 0, "No Junction", " Road 3 , W"),
        ("c", 0, "No Junction", "nan"), ("d", 0, "No Junction", "L" * 90), ("e", 0, "No Junction", ", Ward 1"),
    ]
    df = spark.createDataFrame(rows, "zone_id string, is_named_junction int, junction_name string, location string")
    got = dict(zones.zone_display_name(df).collect())
    assert got == {"a": "Square", "b": "Road 3", "c": "Mapped road segment", "d": "L" * 70, "e": "Mapped road segment"}


def test_neighbours_match_all_pairs(spark):
    from kerbwatch.operators.cleaning import grid_centroid

    cells = [(f"Z{x}_{y}", x, y) for x in range(-6, 7) for y in range(-5, 6) if (x * 7 + y) % 3]
    zone = grid_centroid(spark.createDataFrame(cells, "zone_id string, cell_x int, cell_y int"), S.grid)
    got = {(r[0], r[1]) for r in zones.zone_neighbours(zone, 1700.0, S).collect()}
    pdf = zone.toPandas()
    lat, lon = np.radians(pdf["centroid_latitude"]), np.radians(pdf["centroid_longitude"])
    want = set()
    for i in range(len(pdf)):
        a = np.sin((lat - lat[i]) / 2) ** 2 + np.cos(lat) * np.cos(lat[i]) * np.sin((lon - lon[i]) / 2) ** 2
        metres = 2 * 6_371_000.0 * np.arctan2(np.sqrt(a), np.sqrt(1 - a))
        for j in np.flatnonzero(metres < 1700.0):
            if pdf["zone_id"][i] < pdf["zone_id"][j]:
                want.add((pdf["zone_id"][i], pdf["zone_id"][j]))
    assert got == want and got


def test_validation_split(spark):
    built = features.build_features(panel.dense_panel(zone_windows(spark), S), S.temporal).persist()
    fit, held = split.validation_split(built, 24)
    assert held.select("target_window_start").distinct().count() == 24
    assert fit.count() + held.count() == built.count()
    for windows in (0, 10_000):
        fit, held = split.validation_split(built, windows)
        assert held.isEmpty() and fit.count() == built.count()


def test_daily_trend_fills_quiet_days(spark):
    from kerbwatch.operators.summaries import zone_daily_trend

    rows = [("a", dt.datetime(2024, 1, 1, 22), 2, 1.5), ("a", dt.datetime(2024, 1, 4), 1, 0.5)]
    df = spark.createDataFrame(
        rows, "zone_id string, window_start timestamp_ntz, violation_count bigint, impact_units double"
    )
    got = [(str(r["day"]), r["violations"]) for r in zone_daily_trend(df).orderBy("day").collect()]
    assert got == [("2024-01-01", 2.0), ("2024-01-02", 0.0), ("2024-01-03", 0.0), ("2024-01-04", 1.0)]


def test_nearest_window_prefers_the_earlier(spark):
    from kerbwatch.operators.summaries import nearest_window

    times = pd.date_range("2024-01-01", periods=4, freq="2h")
    df = spark.createDataFrame([(t.to_pydatetime(),) for t in times], "target_window_start timestamp_ntz")
    assert str(nearest_window(df, "2024-01-01 03:00:00").first()[0]) == "2024-01-01 02:00:00"


def test_stored_panel_needs_no_exchange(spark, tmp_path):
    rows = [(f"Z{z}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=2 * w), *[float(z * w % 5)] * len(panel.MEASURES)) for z in range(6) for w in range(40)]
    schema = "zone_id string, window_start timestamp_ntz" + "".join(f", {m} double" for m in panel.MEASURES)
    wide = spark.createDataFrame(rows, schema)
    temporal = TemporalSettings(rolling_windows=(3, 12))
    name = store_panel(wide, str(tmp_path / "panel"))
    stored = features.rolling_means(spark.table(name), temporal)
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    names = ["zone_id", "window_start", "count_roll_mean_3", "impact_roll_mean_12"]
    plain = features.rolling_means(wide, temporal).select(*names)
    assert sorted(map(tuple, stored.select(*names).collect())) == sorted(map(tuple, plain.collect()))
