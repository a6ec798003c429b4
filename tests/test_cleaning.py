import pytest
from pyspark.sql import functions as F

from kerbwatch import session
from kerbwatch.config import DataSettings, Settings
from kerbwatch.operators import cleaning
from kerbwatch.sources import exports, records

GOOD = {
    "latitude": "12.971", "longitude": "77.591", "location": "MG Road", "vehicle_number": "KA1",
    "vehicle_type": "CAR", "violation_type": '["NO PARKING"]', "created_datetime": "2024-01-01 00:00:00",
    "device_id": "d", "created_by_id": "o", "center_code": "c", "police_station": "S",
    "junction_name": None, "updated_vehicle_number": None, "updated_vehicle_type": None,
    "validation_status": "approved",
}


def raw(spark, *rows):
    names = ["id", *GOOD, "ingest_seq"]
    data = [tuple({**GOOD, **row}.get(n, i) for n in names) for i, row in enumerate(rows)]
    schema = ", ".join(f"{n} string" for n in names[:-1]) + ", ingest_seq bigint"
    return records.record_contract(spark.createDataFrame(data, schema))


def test_last_row_of_an_id_decides_even_when_it_is_dropped(spark):
    df = raw(spark, {"id": "a"}, {"id": "a", "validation_status": "Rejected "}, {"id": "b"})
    assert [r["id"] for r in cleaning.clean_records(df, Settings()).collect()] == ["b"]


def test_last_row_wins_and_null_ids_count_as_one(spark):
    df = raw(
        spark,
        {"id": "a", "police_station": "old"},
        {"id": "a", "police_station": "new"},
        {"id": None, "police_station": "x"},
        {"id": "NULL", "police_station": "y"},
    )
    got = {r["id"]: r["police_station"] for r in cleaning.clean_records(df, Settings()).collect()}
    assert got == {"a": "new", None: "y"}


def test_row_filters(spark):
    df = raw(
        spark,
        {"id": "ok"},
        {"id": "box", "latitude": "12.70", "longitude": "77.90"},
        {"id": "outside", "latitude": "13.4"},
        {"id": "text", "latitude": "north"},
        {"id": "none", "longitude": "NaN"},
        {"id": "dup", "validation_status": "DUPLICATE"},
        {"id": "time", "created_datetime": "soon"},
        {"id": "offence", "violation_type": "DEFECTIVE NUMBER PLATE"},
    )
    got = {r["id"] for r in cleaning.clean_records(df, Settings()).collect()}
    assert got == {"ok", "box"}


def test_policies(spark):
    df = raw(spark, {"id": "a"}, {"id": "b", "validation_status": None})
    approved = Settings(data=DataSettings(validation_policy="approved_only"))
    assert [r["id"] for r in cleaning.clean_records(df, approved).collect()] == ["a"]
    statuses = {r["validation_status"] for r in cleaning.clean_records(df, Settings()).collect()}
    assert statuses == {"approved", "unreviewed"}
    with pytest.raises(ValueError):
        cleaning.validation_filter(df, "anything")


def test_units_of_a_peak_hour_record(spark):
    row = {
        "id": "a", "updated_vehicle_type": "hgv", "junction_name": "J1", "location": "Ring Road",
        "created_datetime": "2024-01-01 02:00:00",
    }
    got = cleaning.clean_records(raw(spark, row), Settings()).first()
    assert got["obstruction_units"] == 1.5 * 1.5 * 1.35 * 1.2
    assert got["is_peak_hour"] == 1 and got["is_heavy_vehicle"] == 1


def test_missing_column_is_an_error(spark):
    with pytest.raises(ValueError, match="police_station"):
        records.record_contract(raw(spark, {"id": "a"}).drop("police_station"))


def test_csv_keeps_quotes_line_breaks_and_row_order(spark, tmp_path):
    df = raw(
        spark,
        {"id": "a", "location": 'Gate "7",\nmain road', "police_station": "old"},
        {"id": "a", "location": 'Gate "8",\nmain road', "police_station": "new"},
        {"id": "b", "junction_name": "n/a", "vehicle_type": "NULL"},
    )
    extra = df.drop("ingest_seq").withColumn("unused", F.lit("z")).coalesce(1)
    path = exports.write_table(extra, str(tmp_path / "csv"))
    got = {r["id"]: r for r in cleaning.dedupe_last(records.scan_csv(spark, path, multiline=True)).collect()}
    assert got["a"]["location"] == 'Gate "8",\nmain road'
    assert got["a"]["police_station"] == "new"
    assert got["b"]["junction_name"] is None and got["b"]["vehicle_type"] is None


def test_dedupe_prunes_before_the_shuffle(spark):
    plan = cleaning.dedupe_last(raw(spark, {"id": "a"}))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan.split("Exchange hashpartitioning(id")[-1]


def test_dropped_rows_travel_without_payload(spark):
    plan = cleaning.clean_records(raw(spark, {"id": "a"}), Settings()).select("zone_id")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "vehicle_number" not in text.split("Window [row_number()")[0]


def test_an_input_is_dealt_by_its_rows(spark, monkeypatch):
    """No task sorts more rows than it should, however few files there are; nothing is lost or doubled."""
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    one = spark.range(1000).withColumn("x", F.col("id") % 7).coalesce(1)
    parts = session.spread(one, 1000)
    sizes = [r["count"] for r in parts.groupBy(F.spark_partition_id()).count().collect()]
    assert parts.rdd.getNumPartitions() == 10 and max(sizes) < 200
    assert sorted(r.id for r in parts.collect()) == list(range(1000))
    assert session.spread(parts, 1000) is parts
