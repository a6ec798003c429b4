"""Training sample: all positive rows and an exact number of zero rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbwatch.operators.ranking import prefix_of, seeded_hash, smallest_hashes

ROW_KEYS = ["zone_id", "window_start"]


@dataclass(frozen=True)
class SampleInfo:
    full_training_rows: int
    positive_rows: int
    full_negative_rows: int
    sampled_negative_rows: int
    model_fit_rows: int
    negative_sample_weight: float


def union_samples(positive: DataFrame, negative: DataFrame) -> DataFrame:
    return positive.unionByName(negative)


def negative_sample(
    train: DataFrame, target: str, ratio: float, seed: int
) -> tuple[DataFrame, SampleInfo]:
    """All rows with a positive target and `min(zeros, int(max(positives, 1) * ratio))` zero rows.

    Zero rows are chosen by a hash of their key, so the choice does not depend on partitions. The
    histogram that goes to the driver has one number per hash prefix, whatever the input size.
    Zero-count rows carry the weight that makes up for the rows left out.
    """
    zero = F.col(target) == 0
    hashed = seeded_hash(ROW_KEYS, seed)
    counted = train.select(F.when(F.col(target) > 0, "").when(zero, prefix_of(hashed)).alias("p"))
    histogram = {r["p"]: r["count"] for r in counted.groupBy("p").count().collect()}
    total = sum(histogram.values())
    histogram.pop(None, None)
    positives = histogram.pop("", 0)
    zeros = sum(histogram.values())
    wanted = min(zeros, int(max(positives, 1) * ratio))
    info = SampleInfo(
        total, positives, zeros, wanted, positives + wanted, zeros / max(wanted, 1)
    )
    sample = union_samples(
        train.filter(F.col(target) > 0),
        smallest_hashes(train.filter(zero), hashed, wanted, histogram),
    )
    weight = F.when(F.col("target_violation_count") == 0, F.lit(info.negative_sample_weight))
    return sample.withColumn("sample_weight", weight.otherwise(F.lit(1.0))), info
