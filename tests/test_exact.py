"""Results that must not depend on partitions or on the driver's clock."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kerbwatch.operators import ranking, zones

ROOT = Path(__file__).resolve().parents[1]
FLAGS = [
    "is_high_severity", "is_named_junction", "has_junction_offence", "has_main_road_offence",
    "is_heavy_vehicle", "canonical_vehicle_number", "device_id", "created_by_id",
]


def test_sums_above_a_billion_have_the_same_bits(spark):
    rows = spark.range(300_000).select(
        F.lit("Z0_0").alias("zone_id"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("window_start"),
        (F.lit(5000.0) + (F.col("id") % 9973) * 0.00010001).alias("obstruction_units"),
        F.lit(0.7).alias("record_confidence"),
        *[F.lit(1).alias(c) for c in FLAGS],
    )
    seen = set()
    for parts in (1, 4, 13):
        row = zones.zone_window_agg(rows.repartition(parts)).first()
        seen.add((row["impact_units"], row["mean_record_confidence"]))
    exact = sum(500_000_000_000 + (i % 9973) * 10_001 for i in range(300_000)) / 1e8
    assert exact > 1e9 and seen == {(exact, 0.7)}


@pytest.mark.parametrize("size", [0, 1, 777, 4_000, 29_999, 30_000])
def test_smallest_hashes_are_exact_without_a_sort(spark, size, monkeypatch):
    monkeypatch.setattr(ranking, "_READ_HASHES", 3)  # many rounds of refining
    rows = spark.range(30_000).repartition(5)
    hashed = ranking.seeded_hash(["id"], 1)
    counts = rows.groupBy(ranking.prefix_of(hashed).alias("p")).count().collect()
    chosen = ranking.smallest_hashes(rows, hashed, size, {r["p"]: r["count"] for r in counts})
    assert "TakeOrdered" not in chosen._jdf.queryExecution().toString()
    expected = sorted((r["h"], r["id"]) for r in rows.select("id", hashed.alias("h")).collect())[:size]
    assert sorted(r["id"] for r in chosen.collect()) == sorted(i for _, i in expected)


CLOCK = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import functions as F
from kerbwatch.operators.split import validation_split
from kerbwatch.session import build_session
spark = build_session("local[2]", 2)
start = F.lit("2024-03-08 00:00:00").cast("timestamp_ntz")
rows = spark.range(100).select(
    (start + F.make_dt_interval(F.lit(0), (F.col("id") * 2).cast("int"), F.lit(0), F.lit(0))).alias("target_window_start")
)
fit, held = validation_split(rows, 24)
print("SPLIT", fit.count(), held.count())
"""


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_validation_split_ignores_the_drivers_clock(zone):
    done = subprocess.run(
        [sys.executable, "-c", CLOCK.format(root=str(ROOT))],
        env={**os.environ, "TZ": zone}, capture_output=True, text=True, timeout=300,
    )
    assert "SPLIT 76 24" in done.stdout, done.stderr[-800:]
