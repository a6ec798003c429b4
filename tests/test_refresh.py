"""A store refreshed by late and corrected records against one run over all of them."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from kerbwatch import session
from kerbwatch.operators import cleaning
from kerbwatch.operators.zones import zone_window_agg
from kerbwatch.plans import refresh as store
from kerbwatch.plans import stages
from kerbwatch.plans.queries import S
from kerbwatch.session import staged
from kerbwatch.sources.events_fixture import event_records

SMALL = "/root/testdata/sf0.001"
# Few records: a zone with two is active, and windows reach back three days.
FEW = replace(
    S,
    grid=replace(S.grid, min_zone_observations=2),
    temporal=replace(S.temporal, lag_windows=(1, 2, 12), rolling_windows=(12, 36)),
)


@pytest.fixture(scope="module")
def records(spark):
    """Corrections move a record to another place, another day, or reject it."""
    rows = event_records(spark, SMALL)
    number = F.col("id").cast("long")
    again = rows.filter((number % 9 == 0) & (F.col("ingest_seq") == 0)).withColumns(
        {
            "ingest_seq": F.lit(7).cast("long"),
            "latitude": F.when(number % 2 == 0, F.lit("12.95")).otherwise(F.col("latitude")),
            "validation_status": F.when(number % 4 == 1, F.lit("rejected")).otherwise(F.col("validation_status")),
            "created_datetime": F.when(number % 5 == 0, F.lit("2024-01-20 10:00:00")).otherwise(F.col("created_datetime")),
        }
    )
    return staged(rows.unionByName(again), "refresh-records")


def rows_of(df):
    names = sorted(df.columns)
    told = df.select(*[F.round(c, 7).alias(c) if t == "double" else F.col(c) for c, t in sorted(df.dtypes)])
    return sorted((tuple(r[n] for n in names) for r in told.collect()), key=str)


def same_as_one_run(spark, root, records, settings):
    clean = staged(cleaning.clean_records(records, settings), "whole")
    read = lambda name: store.read_stored(spark, root, name).drop("window_date")
    assert rows_of(read("records")) == rows_of(clean)
    assert rows_of(read("zone_windows")) == rows_of(zone_window_agg(clean))
    expected = rows_of(stages.bare_features(clean, settings))
    assert rows_of(read("features")) == expected
    return len(expected)


def test_late_days_and_corrections_give_the_whole_run(spark, records, tmp_path):
    root = str(tmp_path / "store")
    store.create_store(spark, root, records, FEW)
    assert store.read_stored(spark, root, "features").count() == 0
    day = F.col("created_datetime").substr(1, 10)
    late = (day == "2024-01-24") | (F.col("ingest_seq") > 0)
    store.refresh(records.filter(~late), root, FEW)
    touched = store.refresh(records.filter(late), root, FEW)
    assert touched and same_as_one_run(spark, root, records, FEW) > 100
    # Old versions once more, and the same batch again as after a crash, change nothing.
    assert store.refresh(records.filter("ingest_seq = 0"), root, FEW) == []
    assert store.refresh(records.filter(late), root, FEW) == []


def test_only_the_touched_days_and_those_after_are_written(spark, records, tmp_path):
    root = str(tmp_path / "store")
    store.create_store(spark, root, records, FEW)
    day = F.col("created_datetime").substr(1, 10)
    base = records.filter("ingest_seq = 0")
    store.refresh(base.filter(day != "2024-01-27"), root, FEW)
    # In the test period, so that no zone becomes active by it.
    files = lambda name: {str(p.relative_to(root)) for p in (tmp_path / "store" / name).rglob("*.parquet")}
    before = {n: files(n) for n in store.TABLES}
    touched = [str(d) for d in store.refresh(base.filter(day == "2024-01-27"), root, FEW)]
    assert 1 <= len(touched) <= 2
    for name in ("records", "zone_windows", "day_sums"):
        new = files(name) ^ before[name]
        assert new and all(any(f"window_date={d}" in f for d in touched) for f in new)
    changed = {f.split("window_date=")[1][:10] for f in files("features") ^ before["features"]}
    assert min(changed) == "2024-01-26"
    same_as_one_run(spark, root, base, FEW)


def test_days_that_lose_all_records_are_emptied(spark, records, tmp_path):
    root = str(tmp_path / "store")
    store.create_store(spark, root, records, FEW)
    base = records.filter("ingest_seq = 0")
    store.refresh(base, root, FEW)
    day = F.col("created_datetime").substr(1, 10)
    gone = base.filter(day >= "2024-01-28").withColumns(
        {"ingest_seq": F.lit(3).cast("long"), "validation_status": F.lit("rejected")}
    )
    store.refresh(gone, root, FEW)
    same_as_one_run(spark, root, base.unionByName(gone), FEW)
    nothing = base.withColumns({"ingest_seq": F.lit(5).cast("long"), "validation_status": F.lit("rejected")})
    store.refresh(nothing, root, FEW)
    assert all(store.read_stored(spark, root, n).isEmpty() for n in store.TABLES)
    store.refresh(base.limit(0), root, FEW)


def test_a_batch_is_dealt_by_its_rows_for_cleaning(spark, records, tmp_path, monkeypatch):
    """However few files the batch was written to, no task sorts more of its rows than it should."""
    told, plain = [], store.spread
    monkeypatch.setattr(store, "spread", lambda df, rows: told.append(rows) or plain(df, rows))
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    root, batch = str(tmp_path / "dealt"), records.filter("ingest_seq = 0")
    store.create_store(spark, root, batch, FEW)
    store.refresh(batch, root, FEW)
    assert told == [batch.count()]
    assert rows_of(store.read_stored(spark, root, "records").drop("window_date")) == rows_of(cleaning.clean_records(batch, FEW))
