import datetime as dt
import math

import numpy as np
import pytest

from kerbwatch.config import Settings
from kerbwatch.operators import patrol, prioritise

SCHEMA = (
    "zone_id string, zone_name string, police_station string, centroid_latitude double, "
    "centroid_longitude double, target_window_start timestamp_ntz, priority_score double, "
    "predicted_impact_units double, predicted_violation_count double, impact_score int, "
    "risk_level string, model_confidence double, top_reason string"
)
S = Settings()


def frame(spark, zones):
    """Rows from (zone, latitude, longitude, window, priority, impact)."""
    rows = [
        (z, z + " road", "Station", la, lo, w, p, i, 1.0, 90, "Critical", 0.9, "Recurring hotspot")
        for z, la, lo, w, p, i in zones
    ]
    return spark.createDataFrame(rows, SCHEMA)


def metres(a, b):
    (la, lo), (lb, lob) = a, b
    s = math.sin(math.radians(lb - la) / 2) ** 2
    s += math.cos(math.radians(la)) * math.cos(math.radians(lb)) * math.sin(math.radians(lob - lo) / 2) ** 2
    return 2 * 6_371_000.0 * math.atan2(math.sqrt(s), math.sqrt(1 - s))


def brute_plan(zones, teams, spacing):
    plans = {}
    for window in {z[3] for z in zones}:
        order = sorted((z for z in zones if z[3] == window), key=lambda z: (-z[4], -z[5], z[0]))
        picked = []
        for z in order:
            if len(picked) < teams and all(metres(z[1:3], p[1:3]) >= spacing for p in picked):
                picked.append(z)
        picked += [z for z in order if z not in picked][: teams - len(picked)]
        plans[window] = [z[0] for z in picked[:teams]]
    return plans


def plan_of(df):
    plans = {}
    for r in df.orderBy("target_window_start", "rank").collect():
        assert r["team"] == f"Team {r['rank']}"
        plans.setdefault(r["target_window_start"], []).append(r["zone_id"])
    return plans


def grid_zones(seed, windows=4, size=14):
    rng = np.random.default_rng(seed)
    grid = S.grid
    out = []
    for w in range(windows):
        for x in range(size):
            for y in range(size):
                la = grid.origin_latitude + (y + 0.5) * 500 / 111_320.0
                lo = grid.origin_longitude + (x + 0.5) * 500 / grid.metres_per_degree_longitude
                out.append((f"Z{x}_{y}", la, lo, dt.datetime(2024, 4, 1, 2 * w), float(rng.integers(0, 60)), float(rng.integers(0, 9))))
    return out


def test_requested_number_of_teams(spark):
    day = dt.datetime(2024, 4, 1, 8)
    df = frame(spark, [("A", 12.97, 77.59, day, 90.0, 20.0), ("B", 12.98, 77.60, day, 80.0, 15.0), ("C", 12.99, 77.61, day, 70.0, 10.0)])
    rows = patrol.patrol_plan(df, 2, 100.0).collect()
    assert [r["zone_id"] for r in rows] == ["A", "B"]
    assert rows[0]["recommended_action"] == "Schedule a visible repeat patrol during the full window"


@pytest.mark.parametrize("teams, spacing", [(1, 600.0), (8, 400.0), (8, 600.0), (5, 1400.0), (8, 2500.0), (8, 9000.0)])
def test_grid_plan_matches_a_plain_loop(spark, teams, spacing):
    zones = grid_zones(seed=int(spacing) + teams)
    df = frame(spark, zones).repartition(6)
    assert plan_of(patrol.patrol_plan(df, teams, spacing, S)) == brute_plan(zones, teams, spacing)


@pytest.mark.parametrize("spacing", [300.0, 3000.0, 50_000.0])
def test_points_off_the_grid_match_a_plain_loop(spark, spacing):
    # Many points crowd one spot in one window, so the plan needs several slices of the ranking.
    rng = np.random.default_rng(9)
    zones = []
    for w, crowd in ((0, 150), (1, 10)):
        for i in range(200):
            spread = 0.001 if i < crowd else 0.08
            zones.append((f"P{i:03d}", 12.97 + spread * rng.random(), 77.59 + spread * rng.random(),
                          dt.datetime(2024, 4, 1, 2 * w), 100.0 - i / 3 if i < crowd else 10.0 - i / 100, 1.0))
    got = plan_of(patrol.patrol_plan(frame(spark, zones), 6, spacing, step=40))
    assert got == brute_plan(zones, 6, spacing)


def test_head_holds_every_zone_that_can_matter():
    assert patrol.head_size(S, 8, 400.0) == 8
    assert patrol.head_size(S, 8, 600.0) == 7 * 5 + 1
    assert patrol.head_size(S, 3, 0.0) == 3


def test_no_teams_is_an_error_and_no_zones_no_plan(spark):
    df = frame(spark, [("A", 12.97, 77.59, dt.datetime(2024, 4, 1), 1.0, 1.0)])
    with pytest.raises(ValueError):
        patrol.patrol_plan(df, 0, 100.0, S)
    assert patrol.patrol_plan(df.filter("false"), 3, 100.0, S).isEmpty()
    assert patrol.patrol_plan(df, 3, 100.0, S, station="Elsewhere").isEmpty()
    assert patrol.patrol_plan(df, 3, 100.0, S, station="All stations").count() == 1


def test_only_the_head_of_the_ranking_is_shuffled(spark):
    df = frame(spark, [("A", 12.97, 77.59, dt.datetime(2024, 4, 1), 1.0, 1.0)])
    plan = patrol.patrol_plan(df, 8, 600.0, S)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan.split("Exchange hashpartitioning(target_window_start")[1]


def test_scores_of_a_window(spark):
    day = dt.datetime(2024, 4, 1)
    rows = [(f"Z{i}", day, v, 100.0, 1.0, 1.0) for i, v in enumerate([0.0, 0.0, 1.0, 5.0])]
    df = spark.createDataFrame(
        rows,
        "zone_id string, target_window_start timestamp_ntz, predicted_impact_units double, "
        "history_observations double, count_roll_mean_84 double, trend_ratio double",
    )
    got = prioritise.add_operational_scores(df).orderBy("zone_id").collect()
    assert [r["impact_percentile"] for r in got] == [0.375, 0.375, 0.75, 1.0]
    # 37.5 rounds to the even 38.
    assert [r["impact_score"] for r in got] == [38, 38, 75, 100]
    assert [r["risk_level"] for r in got] == ["Moderate", "Moderate", "High", "Critical"]
    assert {r["model_confidence"] for r in got} == {0.94}
    assert [r["priority_score"] for r in got] == [35.7, 35.7, 70.5, 94.0]


def test_missing_history_columns_have_defaults(spark):
    rows = [("Z0", dt.datetime(2024, 4, 1), 1.0, 0.0)]
    df = spark.createDataFrame(
        rows, "zone_id string, target_window_start timestamp_ntz, predicted_impact_units double, history_observations double"
    )
    got = prioritise.add_operational_scores(df).first()
    assert got["model_confidence"] == pytest.approx(0.40)
