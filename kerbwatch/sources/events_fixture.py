"""Violation records derived from the `events` test table."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbwatch.config import (
    GridSettings,
    ModelSettings,
    Settings,
    TemporalSettings,
)
from kerbwatch.session import spread
from kerbwatch.sources.records import record_contract


def fixture_settings() -> Settings:
    """Settings that suit one month of test events: a lower zone threshold."""
    return Settings(
        grid=GridSettings(min_zone_observations=10),
        temporal=TemporalSettings(test_start="2024-01-24 00:00:00", test_end="2024-01-31 00:00:00"),
        model=replace(
            ModelSettings(),
            calibration_windows=24,
            minimum_model_blend_weight=0.0,
        ),
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spread(events, events.count())  # told by the footers


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a text record, and every 37th id a second time as a later correction."""
    events = raw_events(spark, sf_dir).withColumn(
        "k", F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    )
    copies = F.expr("CASE WHEN event_id % 37 = 0 THEN array(0L, 1L) ELSE array(0L) END")
    rows = events.withColumn("ingest_seq", F.explode(copies))
    columns = {
        "id": "event_id",
        "latitude": "CASE WHEN k = 99 THEN 0e0 WHEN k = 98 THEN NULL "
        "ELSE 1.29e1 + (user_id % 20) * 4.5e-3 + (k % 5) * 3e-4 END",
        "longitude": "7.752e1 + (CAST(floor(user_id / 20) AS INT) % 20) * 4.6e-3 + (k % 7) * 2e-4",
        "location": "concat(CASE user_id % 4 WHEN 0 THEN 'Outer Ring Road, Ward ' "
        "WHEN 1 THEN 'Market Street, Ward ' WHEN 2 THEN '5th Cross, Ward ' ELSE '' END, user_id % 9)",
        "vehicle_number": "concat('KA', user_id * 3 + k % 3)",
        "vehicle_type": "CASE k % 6 WHEN 0 THEN 'CAR' WHEN 1 THEN 'SCOOTER' WHEN 2 THEN 'HGV' "
        "WHEN 3 THEN 'MINI LORRY' WHEN 4 THEN 'PASSENGER AUTO' ELSE 'HOVERCRAFT' END",
        "violation_type": """CASE event_type WHEN 'click' THEN CASE k % 5 WHEN 0 THEN '["WRONG PARKING"]'
              WHEN 1 THEN '["PARKING NEAR TRAFFIC LIGHT OR ZEBRA CROSS","WRONG PARKING"]'
              WHEN 2 THEN '["PARKING OPPOSITE TO ANOTHER PARKED VEHICLE"]'
              WHEN 3 THEN '["PARKING OTHER THAN BUS STOP"]' ELSE 'NO PARKING; wrong  parking' END
            WHEN 'view' THEN '["NO PARKING","PARKING ON FOOTPATH"]'
            WHEN 'purchase' THEN '["DOUBLE PARKING","PARKING IN A MAIN ROAD"]'
            WHEN 'signup' THEN '["parking near road crossing","DEFECTIVE NUMBER PLATE"]'
            ELSE CASE WHEN k % 2 = 0 THEN '["DEFECTIVE NUMBER PLATE"]'
                 ELSE '["PARKING NEAR BUSTOP/SCHOOL/HOSPITAL ETC"]' END END""",
        "created_datetime": "CAST(ts AS STRING)",
        "device_id": "event_id % 11",
        "created_by_id": "event_id % 5",
        "center_code": "'C1'",
        "police_station": "CASE WHEN ingest_seq = 1 THEN 'Station X' "
        "ELSE concat('Station ', user_id % 7) END",
        "junction_name": "CASE user_id % 3 WHEN 0 THEN concat('Junction ', user_id % 5) "
        "WHEN 1 THEN 'No Junction' ELSE NULL END",
        "updated_vehicle_number": "CASE k % 9 WHEN 0 THEN concat(' KA', user_id, ' ') WHEN 1 THEN 'NULL' "
        "WHEN 2 THEN '' END",
        "updated_vehicle_type": "CASE k % 8 WHEN 0 THEN ' van ' WHEN 1 THEN 'NULL' WHEN 2 THEN '' END",
        "validation_status": "CASE WHEN k < 50 THEN 'approved' WHEN k < 70 THEN NULL "
        "WHEN k < 75 THEN 'Rejected' WHEN k < 78 THEN 'duplicate' WHEN k < 85 THEN 'created1' "
        "WHEN k < 90 THEN 'processing' ELSE 'other' END",
    }
    named = [F.expr(f"CAST({sql} AS STRING)").alias(name) for name, sql in columns.items()]
    return record_contract(rows.select(*named, "ingest_seq"))
