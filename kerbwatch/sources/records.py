"""Reading raw violation records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbwatch.functions.text import null_if_token

REQUIRED_COLUMNS = [
    "id", "latitude", "longitude", "location", "vehicle_number", "vehicle_type", "violation_type",
    "created_datetime", "device_id", "created_by_id", "center_code", "police_station",
    "junction_name", "updated_vehicle_number", "updated_vehicle_type", "validation_status",
]


def record_contract(df: DataFrame, order=None) -> DataFrame:
    """The sixteen text columns by name, missing-value tokens as null, plus `ingest_seq`."""
    missing = [c for c in REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"input lacks required columns: {', '.join(missing)}")
    texts = [null_if_token(f"CAST({c} AS STRING)").alias(c) for c in REQUIRED_COLUMNS]
    sequence = F.col("ingest_seq") if "ingest_seq" in df.columns else order
    return df.select(*texts, sequence.alias("ingest_seq"))


def _file_order():
    """Position of a row in the input: file, split within the file, row within the split."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def scan_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Records from CSV with a header.

    Files split into tasks, which needs every record on a line of its own. Pass `multiline=True` if
    quoted fields hold line breaks; then a file is one task, whatever its size.
    """
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    return record_contract(reader.option("multiLine", multiline).csv(path), _file_order())


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return record_contract(spark.read.parquet(path), _file_order())
