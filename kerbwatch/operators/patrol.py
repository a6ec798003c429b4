"""Patrol plans: a few well-spaced, high-priority zones for every window at once.

The rule is greedy: walk a window's zones in priority order, take a zone when it keeps its distance
from all taken ones, stop at the number of teams; if zones run out first, fill up in priority order
regardless of distance. Only a short head of each window's ranking can matter. On the grid at most
`r` cells lie within the distance of a taken zone, so among the first (teams - 1) * r + 1 zones at
least `teams` are taken: that many rows per window are enough, and they are exact, not a cap.
Points off the grid have no such bound; they are worked through in further slices of the ranking
until every window is settled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbwatch.config import Settings
from kerbwatch.functions import clock, geo
from kerbwatch.operators.prioritise import action_for_reason, rank_candidates, select_window_station
from kerbwatch.session import staged

# Names and order of the columns.
PLAN_COLUMNS = [
    "team", "rank", "zone_id", "zone_name", "police_station", "centroid_latitude",
    "centroid_longitude", "recommended_window", "predicted_violation_count",
    "predicted_impact_units", "impact_score", "risk_level", "model_confidence", "top_reason",
    "recommended_action",
]

_CARRIED = [
    "zone_id", "zone_name", "police_station", "centroid_latitude", "centroid_longitude",
    "predicted_violation_count", "predicted_impact_units", "impact_score", "risk_level",
    "model_confidence", "top_reason",
]


def _slices(ranked: DataFrame, low: int, high: int) -> DataFrame:
    """Per window, the candidates ranked in (low, high] as one ordered array of bounded length."""
    row = F.struct("candidate_rank", *_CARRIED)
    return (
        ranked.filter((F.col("candidate_rank") > low) & (F.col("candidate_rank") <= high))
        .groupBy("target_window_start")
        .agg(F.sort_array(F.collect_list(row)).alias("candidates"))
    )


def _greedy(taken: Column, candidates: Column, teams: int, metres: float) -> Column:
    def step(picked: Column, c: Column) -> Column:
        apart = F.forall(
            picked,
            lambda p: geo.haversine(
                p["centroid_latitude"],
                p["centroid_longitude"],
                c["centroid_latitude"],
                c["centroid_longitude"],
            )
            >= metres,
        )
        room = F.size(picked) < teams
        return F.when(room & apart, F.concat(picked, F.array(c))).otherwise(picked)

    return F.aggregate(candidates, taken, step)


def _filled(taken: Column, head: Column, teams: int) -> Column:
    """Taken zones first, then the best others; the first `teams` candidates suffice for those."""
    ranks = F.transform(taken, lambda p: p["candidate_rank"])
    others = F.filter(
        F.slice(head, 1, teams), lambda c: ~F.array_contains(ranks, c["candidate_rank"])
    )
    return F.slice(F.concat(taken, others), 1, teams)


def head_size(settings: Settings, teams: int, metres: float) -> int:
    reach = max(1, len(geo.cell_reach(settings, metres)))
    return max(teams, (teams - 1) * reach + 1)


def _picked_on_grid(ranked: DataFrame, teams: int, metres: float, settings: Settings) -> DataFrame:
    heads = _slices(ranked, 0, head_size(settings, teams, metres))
    none = F.slice("candidates", 1, 0)
    # A column of its own: it is read twice below and must not be worked out twice.
    walked = heads.withColumn("taken", _greedy(none, F.col("candidates"), teams, metres))
    filled = _filled(F.col("taken"), F.col("candidates"), teams)
    return walked.select("target_window_start", filled.alias("picked"))


def _picked_anywhere(ranked: DataFrame, teams: int, metres: float, step: int) -> DataFrame:
    ranked = staged(ranked, "patrol-ranked")
    none = F.slice("candidates", 1, 0)
    heads = _slices(ranked, 0, max(step, teams))
    state = staged(
        heads.select(
            "target_window_start",
            F.slice("candidates", 1, teams).alias("head"),
            _greedy(none, F.col("candidates"), teams, metres).alias("taken"),
            (F.size("candidates") == max(step, teams)).alias("more"),
        ),
        "patrol-state",
    )
    low = max(step, teams)
    while not state.filter(F.col("more") & (F.size("taken") < teams)).isEmpty():
        following = _slices(ranked, low, low + step)
        joined = state.join(following, "target_window_start", "left")
        state = staged(
            joined.select(
                "target_window_start",
                "head",
                F.when(
                    F.col("candidates").isNotNull(),
                    _greedy(F.col("taken"), F.col("candidates"), teams, metres),
                ).otherwise(F.col("taken")).alias("taken"),
                F.coalesce(F.size("candidates") == step, F.lit(False)).alias("more"),
            ),
            "patrol-state",
        )
        low += step
    return state.select(
        "target_window_start", _filled(F.col("taken"), F.col("head"), teams).alias("picked")
    )


def patrol_plan(
    scored: DataFrame,
    teams: int,
    minimum_metres: float,
    settings: Settings | None = None,
    station: str | None = None,
    step: int = 500,
) -> DataFrame:
    """Plan of every window present. Pass `settings` when zones are cells of that grid."""
    if teams < 1:
        raise ValueError("teams must be at least 1")
    ranked = rank_candidates(select_window_station(scored, station=station))
    if settings is not None:
        picked = _picked_on_grid(ranked, teams, minimum_metres, settings)
    else:
        picked = _picked_anywhere(ranked, teams, minimum_metres, step)
    rows = picked.select("target_window_start", F.posexplode("picked").alias("_place", "stop"))
    plan = rows.select(
        "target_window_start",
        F.concat(F.lit("Team "), (F.col("_place") + 1).cast("string")).alias("team"),
        (F.col("_place") + 1).alias("rank"),
        "stop.*",
        clock.plan_window_text(F.col("target_window_start")).alias("recommended_window"),
    )
    return action_for_reason(plan).select("target_window_start", *PLAN_COLUMNS)
