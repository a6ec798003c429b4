"""Distributed ranks, quantiles, top-k and exact-size samples.

None of these brings all rows, or all rows of one value, into one task: equal values are counted
map-side first, and the distinct values are cut into ranges that are ranked side by side.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbwatch.session import staged

# Hash prefixes of three hex digits give 4,096 buckets.
_PREFIX_DIGITS = 3
# Distinct values of one range, and ranges at least.
_RANGE_VALUES = 1_000_000
_LEAST_RANGES = 8
# So few hashes are read to find a cut among them.
_READ_HASHES = 10_000


def topk_per_window(
    df: DataFrame, k: int, column: str, window: list[str], rank: str = "rank", tie: str = "zone_id"
) -> DataFrame:
    """The k largest rows per window, ties by zone. Pruned to k rows per map task before shuffling."""
    order = W.partitionBy(*window).orderBy(F.col(column).desc(), F.col(tie))
    return df.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


def ordered_counts(
    df: DataFrame, keys: list[str], value: str, weight: Column | None = None
) -> DataFrame:
    """Per key and distinct value: `n` rows have it and `before` rows have a smaller one.

    The number of ranges follows the number of distinct values, so a range stays of one size.
    """
    rows = F.count("*") if weight is None else F.sum(weight)
    counts = staged(df.groupBy(*keys, value).agg(rows.alias("n")), "ordered-counts")
    ranges = max(_LEAST_RANGES, -(-counts.count() // _RANGE_VALUES))
    # Cut points only balance the work; the result does not depend on them.
    cuts = counts.approxQuantile(value, [i / ranges for i in range(1, ranges)], min(0.01, 0.25 / ranges))
    cuts = sorted(set(cuts))
    if cuts:
        splits = [-math.inf, *cuts, math.inf]
        ranged = Bucketizer(splits=splits, inputCol=value, outputCol="_range").transform(counts)
        ranged = ranged.withColumn("_range", F.col("_range").cast("int"))
    else:
        ranged = counts.withColumn("_range", F.lit(0))
    totals = ranged.groupBy(*keys, "_range").agg(F.sum("n").alias("_total"))
    lower = (
        totals.filter(F.col("_range") < len(cuts))
        .select(
            *keys,
            F.explode(F.sequence(F.col("_range") + 1, F.lit(len(cuts)))).alias("_range"),
            "_total",
        )
        .groupBy(*keys, "_range")
        .agg(F.sum("_total").alias("_lower"))
    )
    inside = W.partitionBy(*keys, "_range").orderBy(value)
    earlier = F.sum("n").over(inside.rowsBetween(W.unboundedPreceding, -1))
    zero = F.lit(0).cast("bigint")
    return ranged.join(lower, [*keys, "_range"], "left").select(
        *keys,
        value,
        "n",
        (F.coalesce(F.col("_lower"), zero) + F.coalesce(earlier, zero)).alias("before"),
    )


def average_ranks(
    df: DataFrame, keys: list[str], value: str, weight: Column | None = None
) -> DataFrame:
    """Average rank of every distinct value per key."""
    counted = ordered_counts(df, keys, value, weight)
    rank = F.col("before") + (F.col("n") + 1) / 2
    return counted.select(*keys, value, "n", rank.alias("average_rank"))


def quantile(df: DataFrame, value: str, q: float) -> DataFrame:
    """Exact quantile with linear interpolation, as one row `quantile`."""
    counted = staged(ordered_counts(df, [], value), "quantile")
    position = F.lit(q) * (F.sum("n") - 1)
    place = counted.agg(position.alias("p")).scalar()
    low = F.floor(place)
    high = F.ceil(place)

    def holds(index: Column) -> Column:
        return (F.col("before") <= index) & (index < F.col("before") + F.col("n"))

    ends = counted.agg(
        F.max(F.when(holds(low), F.col(value))).alias("lo"),
        F.max(F.when(holds(high), F.col(value))).alias("hi"),
        F.max(place - low).alias("share"),
    )
    return ends.select((F.col("lo") + F.col("share") * (F.col("hi") - F.col("lo"))).alias("quantile"))


def _join_ranks(pairs: DataFrame, ranks: DataFrame, side: str) -> DataFrame:
    """Look up the rank of one side.

    The value zero is very common. Its pairs were counted, so there is one for each value of the
    other side; where these still crowd one task, Spark's skewed-join handling splits them, as
    their partner is a single row.
    """
    table = ranks.filter(F.col("side") == side).select(
        "series", F.col("value").alias(side), F.col("average_rank").alias(f"{side}_rank")
    )
    return pairs.join(table, ["series", side])


def rank_correlation(pairs: DataFrame) -> DataFrame:
    """Spearman correlation per series of (series, actual, predicted); zero when undefined."""
    counted = staged(
        pairs.groupBy("series", "actual", "predicted").agg(F.count("*").alias("n")), "rank-pairs"
    )
    sides = counted.select(
        "series",
        "n",
        F.inline(
            F.array(
                F.struct(F.lit("actual").alias("side"), F.col("actual").alias("value")),
                F.struct(F.lit("predicted").alias("side"), F.col("predicted").alias("value")),
            )
        ),
    )
    ranks = average_ranks(sides, ["series", "side"], "value", F.col("n"))
    joined = _join_ranks(_join_ranks(counted, ranks, "actual"), ranks, "predicted")
    totals = counted.groupBy("series").agg(F.sum("n").alias("_rows"))
    middle = (F.col("_rows") + 1) / 2
    a, p = F.col("actual_rank") - middle, F.col("predicted_rank") - middle
    n = F.col("n")
    # Few rows: one per series.
    sums = joined.join(F.broadcast(totals), "series").groupBy("series").agg(
        F.sum(n * a * p).alias("ap"), F.sum(n * a * a).alias("aa"), F.sum(n * p * p).alias("pp")
    )
    value = F.try_divide(F.col("ap"), F.sqrt(F.col("aa")) * F.sqrt(F.col("pp")))
    return sums.select("series", F.coalesce(value, F.lit(0.0)).alias("rank_correlation"))


def seeded_hash(keys: list[str], seed: int) -> Column:
    """Hash text that depends on the row's key and the seed only, never on its partition."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def prefix_of(hashed: Column) -> Column:
    return F.substring(hashed, 1, _PREFIX_DIGITS)


def smallest_hashes(df: DataFrame, hashed: Column, size: int, histogram: dict[str, int]) -> DataFrame:
    """Exactly the `size` rows with the smallest hashes.

    `histogram` holds the row count per hash prefix (a few thousand numbers). The prefix at the cut
    is counted again by its next digits, until what is cut is a few rows, whose hashes are read. Then
    one filter by one hash keeps the rows; nothing is sorted, whatever the size.
    """
    rows = df.withColumn("_hash", hashed)
    cut = _hash_at(rows, size, histogram)
    return (rows if cut is None else rows.filter(F.col("_hash") < cut)).drop("_hash")


def _hash_at(rows: DataFrame, size: int, histogram: dict[str, int]) -> str | None:
    """The least hash that is too large for the `size` smallest; None if all rows belong to them."""
    inside, left = rows, size
    while True:
        for prefix in sorted(histogram):
            if histogram[prefix] > left:
                break
            left -= histogram[prefix]
        else:
            return None
        if len(prefix) == 32:  # very many rows of one hash, that is of one key
            return prefix
        inside = inside.filter(F.col("_hash").startswith(prefix))
        if histogram[prefix] <= _READ_HASHES:
            return sorted(r["_hash"] for r in inside.select("_hash").collect())[left]
        longer = F.substring("_hash", 1, len(prefix) + _PREFIX_DIGITS)
        histogram = {r["p"]: r["count"] for r in inside.groupBy(longer.alias("p")).count().collect()}
