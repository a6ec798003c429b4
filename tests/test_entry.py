"""Entry points, and a part of the registered queries next to their SQL twins."""

from pathlib import Path

import pytest

import __spark_entry__ as driver
from tools.check_oracles import canonical

SMALL = "/root/testdata/sf0.001"
CHECKED = [
    "scan_violations", "parse_created_at", "clean_records", "cleaning_summary", "zone_window_agg",
    "zone_reference", "build_features", "negative_sample", "impact_cap", "calibrate_blend",
    "evaluate_systems", "patrol_plan_wide", "window_kpis", "zone_daily_trend",
]


def test_entry_returns_rows(spark):
    rows = driver.entry(spark).limit(5).collect()
    assert rows and {"zone_id", "window_start", "impact_units", "rank"} <= set(rows[0].asDict())


def test_every_twin_belongs_to_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql_twin(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = driver.queries()[name](spark, SMALL)
    result = db.execute(driver.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    assert got and got == canonical(columns, result.fetchall())
