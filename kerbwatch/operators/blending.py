"""Blending model forecasts with recent history, and choosing the blend on held-out windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbwatch.config import ModelSettings
from kerbwatch.functions.scoring import snapped
from kerbwatch.operators.evaluation import weighted_capture

HISTORY = {
    "count": ("count_lag_84", "count_roll_mean_84"),
    "impact": ("impact_lag_84", "impact_roll_mean_84"),
}
SMALLEST_SCALE = 1e-6


def blend(df: DataFrame, prediction: Column, kind: str, weights: dict[str, float]) -> Column:
    """Weighted sum of the model and the history columns that exist, at least zero."""
    total = prediction * F.lit(float(weights.get("model", 1.0)))
    for column in HISTORY[kind]:
        if column in df.columns:
            total = total + F.col(column) * F.lit(float(weights.get(column, 0.0)))
    return F.greatest(total, F.lit(0.0))


def blend_candidates(spark: SparkSession, step: float, minimum_model: float) -> DataFrame:
    """All (model, lag, roll) weights on the grid that sum to one, in order of choice.

    The grid follows from the step alone: (1/step + 1) (1/step + 2) / 2 rows at most.
    """
    units = max(round(1.0 / step), 1)
    least = max(round(minimum_model * units), 0)

    def share(c: Column) -> Column:
        return F.round(c / F.lit(units), 4)

    model = spark.range(least, units + 1).select(F.col("id").cast("int").alias("m"))
    pairs = model.select("m", F.explode(F.sequence(F.lit(0), F.lit(units) - F.col("m"))).alias("l"))
    return pairs.select(
        (F.col("m") * (units + 1) + F.col("l")).alias("candidate"),
        share(F.col("m")).alias("model_weight"),
        share(F.col("l")).alias("lag_weight"),
        share(F.lit(units) - F.col("m") - F.col("l")).alias("roll_weight"),
    )


@dataclass(frozen=True)
class BlendChoice:
    weights: dict[str, float]
    mae: float
    weighted_capture: float
    objective: float


def blend_objectives(
    validation: DataFrame, prediction: str, actual: str, kind: str, model: ModelSettings, k: int
) -> DataFrame:
    """Error, capture and objective of every candidate, scored side by side.

    Each row is widened by one entry per candidate, a number fixed by the grid step; errors are
    combined map-side and the ranking keeps only k rows per candidate and window before shuffling.
    """
    grid = blend_candidates(
        validation.sparkSession, model.calibration_grid_step, model.minimum_model_blend_weight
    )
    present = [c for c in HISTORY[kind] if c in validation.columns]
    if len(present) < 2:
        # With a history column missing, its share cannot be used; with both, the model stands alone.
        for column, weight in zip(HISTORY[kind], ("lag_weight", "roll_weight")):
            if column not in present and present:
                grid = grid.filter(F.col(weight) == 0)
        if not present:
            grid = grid.filter(F.col("model_weight") == 1)
    entries = [
        F.struct(
            F.lit(c["candidate"]).alias("candidate"),
            snapped(
                blend(
                    validation,
                    F.col(prediction),
                    kind,
                    {
                        "model": c["model_weight"],
                        HISTORY[kind][0]: c["lag_weight"],
                        HISTORY[kind][1]: c["roll_weight"],
                    },
                )
            ).alias("blended"),
        )
        # A few dozen rows of weights.
        for c in grid.collect()
    ]
    rows = validation.select(
        "target_window_start", "zone_id", F.col(actual).alias("_y"), F.inline(F.array(*entries))
    )
    gap = F.abs(F.col("_y") - F.col("blended"))
    errors = rows.groupBy("candidate").agg(F.avg(gap).alias("mae"), F.avg(F.abs("_y")).alias("_m"))
    captures = weighted_capture(rows, k, "_y", "blended", ["candidate"])
    scale = F.greatest(F.col("_m"), F.lit(SMALLEST_SCALE))
    objective = F.col("mae") / scale - model.calibration_ranking_weight * F.col("weighted_capture")
    scored = errors.join(captures.select("candidate", "weighted_capture"), "candidate")
    return scored.join(F.broadcast(grid), "candidate").select(
        "candidate",
        "model_weight",
        "lag_weight",
        "roll_weight",
        "mae",
        "weighted_capture",
        objective.alias("objective"),
    )


def best_blend(objectives: DataFrame) -> DataFrame:
    """The candidate with the smallest objective; the first one wins a tie.

    Objectives are compared after snapping, so that summation order cannot decide a tie.
    """
    first = F.min_by(F.struct("*"), F.struct(snapped(F.col("objective")), F.col("candidate")))
    return objectives.agg(first.alias("best")).select("best.*")


def calibrate_blend(
    validation: DataFrame, prediction: str, actual: str, kind: str, model: ModelSettings, k: int
) -> BlendChoice:
    best = best_blend(blend_objectives(validation, prediction, actual, kind, model, k)).first()
    lag, roll = HISTORY[kind]
    weights = {"model": best["model_weight"], lag: best["lag_weight"], roll: best["roll_weight"]}
    used = {n: w for n, w in weights.items() if n == "model" or n in validation.columns}
    return BlendChoice(used, best["mae"], best["weighted_capture"], best["objective"])
