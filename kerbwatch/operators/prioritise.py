"""Operational scores of forecasts, per target window.

A window's group holds one row per zone, and the number of zones is bounded by the coordinate box
(`Settings.max_zones`), so grouping by window never builds a group that grows with the data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbwatch.functions import scoring
from kerbwatch.functions.scoring import clip


def _by_impact() -> W:
    return W.partitionBy("target_window_start").orderBy("predicted_impact_units")


def _whole_window() -> W:
    # Same partitioning and order as the rank, so that one sort serves both.
    return _by_impact().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def impact_percentile(predictions: DataFrame) -> DataFrame:
    """Average-rank percentile of the predicted impact within its window, and the 0-100 score."""
    peers = F.count("*").over(_by_impact().rangeBetween(W.currentRow, W.currentRow))
    size = F.count("*").over(_whole_window())
    percentile = (F.rank().over(_by_impact()) + (peers - 1) / 2) / size
    return predictions.withColumn("impact_percentile", percentile).withColumn(
        "impact_score", clip(F.rint(F.lit(100.0) * F.col("impact_percentile")), 0.0, 100.0).cast("int")
    )


def window_caps(predictions: DataFrame) -> DataFrame:
    """Largest history and recent activity per window, with a floor, on every row."""
    caps = {
        "history_cap": F.greatest(F.max("history_observations").over(_whole_window()), F.lit(1.0)),
        "recent_cap": F.lit(0.1),
    }
    if "count_roll_mean_84" in predictions.columns:
        recent = F.max("count_roll_mean_84").over(_whole_window())
        caps["recent_cap"] = F.greatest(recent, F.lit(0.1))
    return predictions.withColumns(caps)


def _evidence(value: Column, cap: Column) -> Column:
    return clip(F.log1p(F.greatest(value, F.lit(0.0))) / F.log1p(cap), 0.0, 1.0)


def model_confidence(capped: DataFrame) -> DataFrame:
    have = capped.columns
    recent = F.col("count_roll_mean_84") if "count_roll_mean_84" in have else F.lit(0.0)
    trend = F.col("trend_ratio") if "trend_ratio" in have else F.lit(1.0)
    drift = F.abs(F.log(F.greatest(trend, F.lit(0.05)))) / F.lit(math.log(3.0))
    stability = clip(1.0 - clip(drift, 0.0, 1.0) * 0.30, 0.75, 1.0)
    score = (
        0.34
        + 0.42 * _evidence(F.col("history_observations"), F.col("history_cap"))
        + 0.18 * _evidence(recent, F.col("recent_cap"))
        + 0.06 * stability
    )
    return capped.withColumn("model_confidence", clip(score, 0.35, 0.94))


def priority_score(scored: DataFrame) -> DataFrame:
    return scored.withColumn(
        "priority_score", F.rint(F.col("impact_score") * F.col("model_confidence") * 10) / 10
    )


def risk_level(scored: DataFrame) -> DataFrame:
    return scored.withColumn("risk_level", scoring.risk_level(F.col("impact_score")))


def top_reason(features: DataFrame) -> DataFrame:
    def signal(name: str) -> Column:
        return F.col(name) if name in features.columns else F.lit(0.0)

    return features.withColumn(
        "top_reason",
        scoring.top_reason(
            signal("trend_ratio"),
            signal("junction_share_84"),
            signal("main_road_share_84"),
            signal("heavy_vehicle_share_84"),
            signal("count_roll_mean_84"),
        ),
    )


def action_for_reason(reasoned: DataFrame) -> DataFrame:
    return reasoned.withColumn("recommended_action", scoring.action_for(F.col("top_reason")))


def add_operational_scores(predictions: DataFrame) -> DataFrame:
    df = model_confidence(window_caps(impact_percentile(predictions)))
    return top_reason(risk_level(priority_score(df))).drop("history_cap", "recent_cap")


def by_priority(*before: str) -> W:
    return W.partitionBy(*before).orderBy(
        F.desc("priority_score"), F.desc("predicted_impact_units"), F.col("zone_id")
    )


def rank_candidates(scored: DataFrame) -> DataFrame:
    order = by_priority("target_window_start")
    return scored.withColumn("candidate_rank", F.row_number().over(order))


def select_window_station(
    predictions: DataFrame, window: str | None = None, station: str | None = None
) -> DataFrame:
    df = predictions
    if window is not None:
        df = df.filter(F.col("target_window_start") == F.lit(window).cast("timestamp_ntz"))
    if station and station != "All stations":
        df = df.filter(F.col("police_station") == station)
    return df


def risk_level_filter(scored: DataFrame, levels: list[str]) -> DataFrame:
    return scored.filter(F.col("risk_level").isin(levels))


def top_risk_zones(scored: DataFrame, levels: list[str], k: int) -> DataFrame:
    """The k highest-priority zones of every window among the chosen risk levels."""
    order = W.partitionBy("target_window_start").orderBy(F.desc("priority_score"), "zone_id")
    chosen = risk_level_filter(scored, levels)
    return chosen.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def map_style(scored: DataFrame) -> DataFrame:
    return scored.withColumns(
        {
            "color": scoring.map_colour(F.col("impact_score")),
            "radius": scoring.map_radius(F.col("predicted_impact_units")),
        }
    )
