"""Fitting, scoring and explaining the volume and obstruction forecasts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbwatch.config import BoostSettings, ModelSettings, Settings
from kerbwatch.functions.scoring import clip
from kerbwatch.operators.blending import BlendChoice, blend, calibrate_blend
from kerbwatch.operators.boosting import POISSON, SQUARED, BoostedTrees, fit_boosted, matrix
from kerbwatch.operators.features import feature_columns
from kerbwatch.operators.ranking import quantile, seeded_hash
from kerbwatch.operators.sampling import ROW_KEYS, SampleInfo, negative_sample
from kerbwatch.operators.split import validation_split
from kerbwatch.session import staged

COUNT_TARGET, IMPACT_TARGET = "target_violation_count", "target_impact_units"
_CAP_QUANTILE, _CAP_MARGIN, _LEAST_CAP = 0.999, 1.5, 1.0
# Rows among which a feature's values change places; more rows only mean more such groups.
_SHUFFLE_ROWS = 100_000
# Rows for which another task is worth its start, when rows are scored for every feature.
_SCORED_ROWS = 4_096

MODEL_ONLY = {"model": 1.0}


@dataclass
class ImpactMember:
    name: str
    weight: float
    model: BoostedTrees


@dataclass
class ForecastModels:
    hotspot: BoostedTrees
    impact: list[ImpactMember]
    impact_cap: float
    count_blend: dict[str, float] = field(default_factory=lambda: dict(MODEL_ONLY))
    impact_blend: dict[str, float] = field(default_factory=lambda: dict(MODEL_ONLY))


@dataclass
class TrainingInfo:
    hotspot_sample: SampleInfo
    impact_samples: dict[str, SampleInfo]
    calibration_rows: int = 0
    calibration_windows: int = 0
    count_choice: BlendChoice | None = None
    impact_choice: BlendChoice | None = None

    @property
    def model_fit_rows(self) -> int:
        samples = [self.hotspot_sample, *self.impact_samples.values()]
        return max(s.model_fit_rows for s in samples)

    def as_dict(self) -> dict:
        return {**asdict(self), "model_fit_rows": self.model_fit_rows}


def feature_vector(df: DataFrame, settings: Settings) -> DataFrame:
    """The model features as one vector column, in model order."""
    names = feature_columns(settings.temporal)
    return VectorAssembler(inputCols=names, outputCol="features").transform(df)


def feature_array(settings: Settings) -> Column:
    """The model features as one array, in model order."""
    return F.array(*[F.col(n).cast("double") for n in feature_columns(settings.temporal)])


def hotspot_model(train: DataFrame, settings: Settings) -> tuple[BoostedTrees, SampleInfo]:
    """Poisson boosting of the next window's volume."""
    boost, model = settings.model.hotspot, settings.model
    sample, info = negative_sample(train, COUNT_TARGET, boost.zero_to_positive_ratio, model.random_seed)
    x, y = feature_array(settings), F.col(COUNT_TARGET)
    return fit_boosted(sample, x, y, "sample_weight", POISSON, boost, model, model.random_seed), info


def impact_model(sample: DataFrame, boost: BoostSettings, settings: Settings) -> BoostedTrees:
    """Squared-error boosting of log1p(units). Needs the features, the target and the weight."""
    x, y = feature_array(settings), F.log1p(IMPACT_TARGET)
    seed = settings.model.random_seed + 1
    return fit_boosted(sample, x, y, "sample_weight", SQUARED, boost, settings.model, seed)


def _impact_member(train: DataFrame, boost: BoostSettings, settings: Settings) -> tuple[BoostedTrees, SampleInfo, float]:
    """A member, its sample and the quantile of its sample that the cap follows."""
    sample, info = negative_sample(train, IMPACT_TARGET, boost.zero_to_positive_ratio, settings.model.random_seed)
    sample = staged(sample, "impact-sample")
    high = quantile(sample, IMPACT_TARGET, _CAP_QUANTILE).first()[0]
    return impact_model(sample, boost, settings), info, high or 0.0


def impact_ensemble(
    train: DataFrame, settings: Settings
) -> tuple[list[ImpactMember], float, dict[str, SampleInfo]]:
    """All members, their shared prediction cap and their samples; one member when none is named.

    Members are fitted side by side: a round is a chain of short jobs that leaves most cores idle.
    """
    wanted = settings.model.impact_members or (settings.model.impact_base,)
    total = sum(m.weight for m in wanted)
    if total <= 0:
        raise ValueError("ensemble weights must sum to a positive value")
    with ThreadPoolExecutor(len(wanted)) as pool:
        fitted = list(pool.map(lambda boost: _impact_member(train, boost, settings), wanted))
    members = [ImpactMember(b.name, b.weight / total, model) for b, (model, _, _) in zip(wanted, fitted, strict=True)]
    infos = {b.name: info for b, (_, info, _) in zip(wanted, fitted, strict=True)}
    return members, max([_LEAST_CAP, *[high * _CAP_MARGIN for _, _, high in fitted]]), infos


def raw_scores(models: ForecastModels, df: DataFrame, x: Column) -> DataFrame:
    """What the models themselves say of rows whose features are the array `x`."""
    impact: Column = F.lit(0.0)
    for member in models.impact:
        impact = impact + F.lit(member.weight) * member.model.predict(x)
    return df.withColumns({"predicted_violation_count": models.hotspot.predict(x), "predicted_impact_units": impact})


def score_models(
    models: ForecastModels, frame: DataFrame, settings: Settings, apply_blend: bool = True
) -> DataFrame:
    df = raw_scores(models, frame, feature_array(settings)).withColumn(
        "predicted_impact_units", clip(F.col("predicted_impact_units"), 0.0, models.impact_cap)
    )
    if not apply_blend:
        return df
    return blend_forecasts(df, models)


def blend_forecasts(df: DataFrame, models: ForecastModels) -> DataFrame:
    count = blend(df, F.col("predicted_violation_count"), "count", models.count_blend)
    impact = blend(df, F.col("predicted_impact_units"), "impact", models.impact_blend)
    return df.withColumns(
        {
            "predicted_violation_count": count,
            "predicted_impact_units": clip(impact, 0.0, models.impact_cap),
        }
    )


def fit_pair(train: DataFrame, settings: Settings) -> tuple[ForecastModels, TrainingInfo]:
    """Both forecasts on the same rows, fitted side by side."""
    with ThreadPoolExecutor(2) as pool:
        volume = pool.submit(hotspot_model, train, settings)
        members, cap, impact_infos = impact_ensemble(train, settings)
        hotspot, hotspot_info = volume.result()
    return ForecastModels(hotspot, members, cap), TrainingInfo(hotspot_info, impact_infos)


def train_models(
    train: DataFrame, settings: Settings, pair: Future[tuple[ForecastModels, TrainingInfo]] | None = None
) -> tuple[ForecastModels, TrainingInfo]:
    """Choose the blend on the last windows, then fit on all rows. Pass a staged frame.

    `pair` is what `fit_pair` makes of the same rows, if that was begun already.
    """
    fit, held = validation_split(train, settings.model.calibration_windows)
    choices = {}
    calibration_rows = held.count()
    with ThreadPoolExecutor(1) as pool:
        final = pair or pool.submit(fit_pair, train, settings)
        if calibration_rows:
            trial, _ = fit_pair(fit, settings)
            scored = staged(score_models(trial, held, settings, apply_blend=False), "calibration")
            k = settings.deployment.top_k[0] if settings.deployment.top_k else 10
            for kind, prediction, actual in (
                ("count", "predicted_violation_count", COUNT_TARGET),
                ("impact", "predicted_impact_units", IMPACT_TARGET),
            ):
                choices[kind] = calibrate_blend(scored, prediction, actual, kind, settings.model, k)
        models, info = final.result()
    models, info = replace(models), replace(info)
    if choices:
        models.count_blend = choices["count"].weights
        models.impact_blend = choices["impact"].weights
        info.calibration_rows = calibration_rows
        info.calibration_windows = settings.model.calibration_windows
        info.count_choice, info.impact_choice = choices["count"], choices["impact"]
    return models, info


def feature_importance(
    models: ForecastModels, holdout: DataFrame, settings: Settings, group_rows: int = _SHUFFLE_ROWS
) -> DataFrame:
    """Loss of accuracy per feature when its values are shuffled among the holdout rows.

    All rows count. They are dealt by hash into groups of about `group_rows`, and in each group the
    rows in one hash order meet those in another, side by side for all groups. A row is scored once,
    and for each feature only by the trees that ask for it, with its value from the row it met.
    Scores are those of the models, not clipped. `rows_scored` is the number of rows behind each loss.
    """
    names = feature_columns(settings.temporal)
    seed = settings.model.random_seed
    values = F.array(*[F.col(n).cast("double") for n in names])
    rows = staged(
        holdout.select(*ROW_KEYS, values.alias("x"), COUNT_TARGET, IMPACT_TARGET), "importance-rows"
    )
    count = rows.count()
    groups = max(1, -(-count // group_rows))
    dealt = rows.withColumn("_g", F.pmod(F.xxhash64(*ROW_KEYS, F.lit(seed)), F.lit(groups)))

    def place(salt: int) -> Column:
        return F.row_number().over(W.partitionBy("_g").orderBy(seeded_hash(ROW_KEYS, seed + salt)))

    numbered = dealt.withColumn("_i", place(0))
    shuffled = dealt.select("_g", place(1).alias("_i"), F.col("x").alias("other"))
    met = numbered.join(shuffled, ["_g", "_i"]).select("x", "other", COUNT_TARGET, IMPACT_TARGET)
    tasks = min(rows.sparkSession.sparkContext.defaultParallelism, -(-count // _SCORED_ROWS))
    if groups < tasks:
        met = met.repartition(tasks)  # scoring is the work; a few groups would leave it to as many tasks
    scored = met.mapInArrow(
        lambda parts: _swapped_errors(models, parts), "feature_id int, rows bigint, hotspot double, impact double"
    )
    errors = staged(
        scored.groupBy("feature_id").agg(
            F.sum("rows").alias("rows_scored"),
            *[(F.sum(kind) / F.sum("rows")).alias(kind) for kind in ("hotspot", "impact")],
        ),
        "importance-errors",
    )
    plain = errors.filter("feature_id = -1")
    kinds = [
        F.struct(
            F.lit(kind).alias("model"),
            (F.col(kind) - plain.select(kind).scalar()).alias("importance"),
        )
        for kind in ("hotspot", "impact")
    ]
    labels = F.array(*[F.lit(n) for n in names])
    return (
        errors.filter("feature_id >= 0")
        .select(
            F.element_at(labels, F.col("feature_id") + 1).alias("feature"),
            "rows_scored",
            F.inline(F.array(*kinds)),
        )
        .select("model", "feature", "importance", F.lit(0.0).alias("importance_std"), "rows_scored")
        .orderBy("model", F.desc("importance"), "feature")
    )


def _swapped_errors(models: ForecastModels, parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summed absolute errors of a task's rows: as they are (-1), and with each feature swapped."""
    fitted = [models.hotspot, *[m.model for m in models.impact]]
    users: list[dict[int, list[int]]] = []
    for model in fitted:
        of: dict[int, list[int]] = {}
        for t, tree in enumerate(model.trees):
            for f in set(tree.feature) - {-1}:
                of.setdefault(f, []).append(t)
        users.append(of)
    total = None
    rows = 0
    for batch in parts:
        if not batch.num_rows:
            continue
        x, other = matrix(batch.column("x")).copy(), matrix(batch.column("other"))
        actual = [batch.column(c).to_numpy() for c in (COUNT_TARGET, IMPACT_TARGET)]
        parts_of = [[tree.add_to(x) for tree in model.trees] for model in fitted]
        margins = [np.full(len(x), m.start) + np.sum(p, axis=0) if p else np.full(len(x), m.start) for m, p in zip(fitted, parts_of, strict=True)]

        def errors(margins: list[np.ndarray]) -> list[float]:
            forecasts = [m.forecast(g) for m, g in zip(fitted, margins, strict=True)]
            impact = sum(m.weight * p for m, p in zip(models.impact, forecasts[1:], strict=True))
            return [float(np.abs(a - p).sum()) for a, p in zip(actual, (forecasts[0], impact), strict=True)]

        made = [errors(margins)]
        for f in range(x.shape[1]):
            own = x[:, f].copy()
            x[:, f] = other[:, f]
            swapped = []
            for model, of, known, margin in zip(fitted, users, parts_of, margins, strict=True):
                swapped.append(margin + sum(model.trees[t].add_to(x) - known[t] for t in of.get(f, ())))
            made.append(errors(swapped))
            x[:, f] = own
        total = np.array(made) + (0 if total is None else total)
        rows += len(x)
    if total is not None:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(-1, len(total) - 1), pa.int32()), pa.array([rows] * len(total), pa.int64()),
                pa.array(total[:, 0]), pa.array(total[:, 1]),
            ],
            ["feature_id", "rows", "hotspot", "impact"],
        )


def importance_topn(importance: DataFrame, model: str, n: int = 12) -> DataFrame:
    chosen = importance.filter(F.col("model") == model)
    return chosen.orderBy(F.desc("importance"), "feature").limit(n)
