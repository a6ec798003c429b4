"""Forecast evaluation: error, rank correlation and top-k capture, all systems in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbwatch.functions.scoring import snapped
from kerbwatch.operators.ranking import rank_correlation, topk_per_window

TARGETS = {"count": "target_violation_count", "impact": "target_impact_units"}

# Forecast columns per system: (count, impact).
SYSTEMS = {
    "forecast": ("predicted_violation_count", "predicted_impact_units"),
    "same_window_last_week": ("count_lag_84", "impact_lag_84"),
    "seven_day_average": ("count_roll_mean_84", "impact_roll_mean_84"),
}

# Predictions below this count as this, in every system.
SMALLEST_PREDICTION = 1e-9


def long_form(predictions: DataFrame, systems: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """One row per system, target, window and zone: (series, system, target, actual, predicted)."""
    entries = [
        F.struct(
            F.lit(f"{system}:{target}").alias("series"),
            F.lit(system).alias("system"),
            F.lit(target).alias("target"),
            F.col(TARGETS[target]).cast("double").alias("actual"),
            F.col(column).cast("double").alias("predicted"),
        )
        for system, columns in (systems or SYSTEMS).items()
        for target, column in zip(TARGETS, columns)
    ]
    return predictions.select("target_window_start", "zone_id", F.inline(F.array(*entries)))


def _stack(df: DataFrame, keys: list[str], metrics: dict[str, Column]) -> DataFrame:
    entries = [F.struct(F.lit(m).alias("metric"), c.alias("value")) for m, c in metrics.items()]
    return df.select(*keys, F.inline(F.array(*entries)))


def error_metrics(rows: DataFrame) -> DataFrame:
    """Error per series; one aggregation, combined map-side."""
    y = F.col("actual")
    p = F.greatest(F.col("predicted"), F.lit(SMALLEST_PREDICTION))
    gap = y - p
    surprise = F.when(y > 0, y * F.log(y / p)).otherwise(F.lit(0.0))
    return rows.groupBy("series", "system", "target").agg(
        F.avg(F.abs(gap)).alias("mae"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        (F.lit(2.0) * F.avg(surprise - y + p)).alias("poisson_deviance"),
    )


def regression_metrics(rows: DataFrame) -> DataFrame:
    """Errors and rank correlation per series, as rows."""
    floor = F.greatest(F.col("predicted"), F.lit(SMALLEST_PREDICTION))
    ranks = rank_correlation(rows.select("series", "actual", floor.alias("predicted")))
    # Both sides hold one row per series.
    joined = error_metrics(rows).join(F.broadcast(ranks), "series")
    names = ["mae", "rmse", "poisson_deviance", "rank_correlation"]
    return _stack(joined, ["system", "target"], {n: F.col(n) for n in names})


def window_captures(rows: DataFrame, ks: list[int]) -> DataFrame:
    """Per series, window and k: zones hit, actual captured, actual total, size of the top list.

    Only the top rows and the per-window totals are shuffled, never all zones of a window.
    """
    largest = max(ks)
    window = "target_window_start"
    keys = ["series", "system", "target", window]
    called = topk_per_window(rows, largest, "predicted", ["series", window], "called_rank").select(
        *keys, "zone_id", "actual", "called_rank"
    )
    best = topk_per_window(rows, largest, "actual", ["series", window], "true_rank").select(
        "series", window, "zone_id", "true_rank"
    )
    totals = rows.groupBy(*keys).agg(F.sum("actual").alias("total"), F.count("*").alias("zones"))
    hits = called.join(best, ["series", window, "zone_id"], "left")
    per_k = hits.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    counted = (
        per_k.filter(F.col("called_rank") <= F.col("k"))
        .groupBy(*keys, "k")
        .agg(
            F.sum("actual").alias("captured"),
            F.count(F.when(F.col("true_rank") <= F.col("k"), 1)).alias("hits"),
        )
    )
    return counted.join(totals, keys).withColumn(
        "size", F.least(F.col("k").cast("bigint"), F.col("zones"))
    )


def topk_intersection(rows: DataFrame, k: int) -> DataFrame:
    return window_captures(rows, [k]).select(
        "system", "target", "target_window_start", "k", "hits", "size"
    )


def ranking_metrics(rows: DataFrame, ks: list[int]) -> DataFrame:
    """Precision and capture at each k per series, as rows."""
    windows = window_captures(rows, ks)
    share = F.when(F.col("total") > 0, F.col("captured") / F.col("total")).otherwise(F.lit(0.0))
    weighted = F.try_divide(F.sum("captured"), F.sum("total"))
    per_k = windows.groupBy("system", "target", "k").agg(
        F.avg(F.col("hits") / F.col("size")).alias("precision"),
        F.avg(share).alias("mean_capture"),
        F.coalesce(weighted, F.lit(0.0)).alias("weighted_capture"),
    )
    names = ["precision", "mean_capture", "weighted_capture"]
    stacked = _stack(per_k, ["system", "target", "k"], {n: F.col(n) for n in names})
    metric = F.concat(F.col("metric"), F.lit("_at_"), F.col("k").cast("string"))
    return stacked.select("system", "target", metric.alias("metric"), "value")


def evaluate_systems(
    predictions: DataFrame, ks: list[int], systems: dict[str, tuple[str, str]] | None = None
) -> DataFrame:
    """All metrics of all systems as (system, target, metric, value).

    `predictions` is read by several branches; pass a staged frame.
    """
    rows = long_form(predictions, systems)
    return regression_metrics(rows).unionByName(ranking_metrics(rows, ks))


def evaluation_coverage(predictions: DataFrame) -> DataFrame:
    return predictions.agg(
        F.min("target_window_start").alias("evaluation_start"),
        F.max("target_window_start").alias("evaluation_end"),
        F.count("*").alias("rows"),
        F.count_distinct("target_window_start").alias("windows"),
        F.count_distinct("zone_id").alias("zones"),
    )


def weighted_capture(
    rows: DataFrame, k: int, actual: str, predicted: str, keys: list[str] | None = None
) -> DataFrame:
    """Share of the actual total found in each window's top k; windows without actuals are skipped."""
    keys = keys or []
    window = "target_window_start"
    top = topk_per_window(rows, k, predicted, [*keys, window]).groupBy(*keys).agg(
        snapped(F.sum(actual)).alias("captured")
    )
    total = rows.groupBy(*keys).agg(snapped(F.sum(actual)).alias("total"))
    joined = top.join(total, keys) if keys else top.withColumn(
        "total", total.select("total").scalar()
    )
    share = F.coalesce(F.try_divide("captured", "total"), F.lit(0.0))
    return joined.withColumn("weighted_capture", share)


def comparison_table(metrics: DataFrame) -> DataFrame:
    """The four headline figures per system, capture in percent."""

    def pick(target: str, metric: str) -> Column:
        match = (F.col("target") == target) & (F.col("metric") == metric)
        return F.max(F.when(match, F.col("value")))

    return metrics.groupBy("system").agg(
        pick("count", "mae").alias("count_mae"),
        pick("impact", "mae").alias("impact_mae"),
        (pick("impact", "weighted_capture_at_10") * 100).alias("impact_capture_at_10"),
        (pick("impact", "weighted_capture_at_25") * 100).alias("impact_capture_at_25"),
    )


def baseline_lift(metrics: DataFrame, baseline: str = "same_window_last_week") -> DataFrame:
    """Comparison table plus the relative gain of every system over the baseline."""
    table = comparison_table(metrics)
    figures = ["count_mae", "impact_mae", "impact_capture_at_10", "impact_capture_at_25"]
    base = table.filter(F.col("system") == baseline)
    joined = table.withColumns({f"_{c}": base.select(c).scalar() for c in figures})
    return joined.select(
        "system",
        *figures,
        *[
            F.try_divide(F.col(f"_{c}") - F.col(c), F.col(f"_{c}")).alias(f"{c}_reduction")
            for c in figures[:2]
        ],
        *[
            F.try_divide(F.col(c) - F.col(f"_{c}"), F.col(f"_{c}")).alias(f"{c}_gain")
            for c in figures[2:]
        ],
    )
