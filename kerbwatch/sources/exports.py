"""Writing result tables and reading them back.

Every writer keeps Spark's partitioned output: one folder per table, one file per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbwatch.config import Settings
from kerbwatch.functions import clock

# Names and order of the columns.
PREDICTION_COLUMNS = [
    "zone_id", "target_window_start", "zone_name", "police_station", "primary_junction",
    "centroid_latitude", "centroid_longitude", "predicted_violation_count",
    "predicted_impact_units", "target_violation_count", "target_impact_units", "impact_score",
    "risk_level", "model_confidence", "priority_score", "top_reason", "trend_ratio",
    "junction_share_84", "junction_offence_share_84", "main_road_share_84",
    "heavy_vehicle_share_84", "high_severity_share_84", "repeat_vehicle_rate_84",
    "count_roll_mean_84", "impact_roll_mean_84", "history_observations", "target_is_peak",
]

# Names and order of the columns.
HISTORY_COLUMNS = [
    "zone_id", "window_start", "violation_count", "impact_units", "police_station", "zone_name",
]

# Days of zone history kept before the test period.
HISTORY_DAYS = 35


def with_offset_text(df: DataFrame, column: str, timezone: str) -> DataFrame:
    """Local wall-clock column as text with its UTC offset, as result files carry it."""
    utc = F.convert_timezone(F.lit(timezone), F.lit("UTC"), F.col(column))
    return df.withColumn(column, F.date_format(utc, "yyyy-MM-dd HH:mm:ss.SSSSSS+00:00"))


def write_table(df: DataFrame, path: str, compression: str = "none") -> str:
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    # Keep blanks at the ends of text as they are.
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.option("compression", compression).csv(path)
    return path


def write_intermediate(df: DataFrame, path: str, time: str = "window_start") -> str:
    """Parquet partitioned by local date, so that date ranges read only their folders."""
    dated = df.withColumn("window_date", F.to_date(time))
    # Rows of one date go to a handful of tasks, not to every task: few files per date, and a date
    # with very many rows still splits.
    by_date = dated.hint("rebalance", "window_date")
    by_date.write.mode("overwrite").partitionBy("window_date").parquet(path)
    return path


def prediction_table(scored: DataFrame) -> DataFrame:
    return scored.select(*PREDICTION_COLUMNS)


def zone_history(features: DataFrame, settings: Settings) -> DataFrame:
    start = clock.ntz(settings.temporal.test_start) - clock.hours(24 * HISTORY_DAYS)
    end = clock.ntz(settings.temporal.test_end)
    window = F.col("window_start")
    return features.filter((window >= start) & (window < end)).select(*HISTORY_COLUMNS)


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def read_table(
    spark: SparkSession, path: str, schema, timezone: str, times: tuple[str, ...] = ()
) -> DataFrame:
    """CSV table with a known schema; the named columns become local wall-clock times."""
    df = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    local = {t: clock.local_time(F.try_to_timestamp(F.col(t)), timezone) for t in times}
    return df.withColumns(local) if local else df


def text_times(df: DataFrame, times: tuple[str, ...]):
    """Schema of `df` with the named columns as text, for reading its CSV back."""
    return df.withColumns({t: F.col(t).cast("string") for t in times}).schema


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)
