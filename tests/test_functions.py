import math

import pytest
from pyspark.sql import functions as F

from kerbwatch.config import GridSettings, Settings
from kerbwatch.functions import clock, geo, scoring, text
from kerbwatch.operators import cleaning


def one(spark, sql, column):
    return spark.sql(sql).select(column.alias("v")).first()["v"]


def tokens(spark, value):
    df = spark.createDataFrame([(value,)], "violation_type string")
    return df.select(cleaning.offence_tokens(F.col("violation_type")).alias("v")).first()["v"]


def severity_of(spark, value):
    df = spark.createDataFrame([("1", 0, value)], "id string, ingest_seq int, violation_type string")
    return cleaning.offence_list_severity(df, Settings().scoring).first()


def test_json_list_is_parsed_in_order(spark):
    assert tokens(spark, '["WRONG PARKING", "DOUBLE PARKING"]') == ["WRONG PARKING", "DOUBLE PARKING"]


@pytest.mark.parametrize(
    "value, expected",
    [
        ("['no  parking', 'Wrong Parking']", ["NO PARKING", "WRONG PARKING"]),
        ("no parking; wrong parking|x", ["NO PARKING", "WRONG PARKING", "X"]),
        ('"NO PARKING"', ["NO PARKING"]),
        ('["PARKING NEAR BUSTOP\\/SCHOOL\\/HOSPITAL ETC"]', ["PARKING NEAR BUSTOP/SCHOOL/HOSPITAL ETC"]),
        ("null", []),
        ("  ", []),
        (None, []),
    ],
)
def test_other_list_spellings(spark, value, expected):
    assert tokens(spark, value) == expected


def test_unknown_offence_is_left_out(spark):
    assert severity_of(spark, '["NO PARKING","DEFECTIVE NUMBER PLATE"]')["offences"] == ["NO PARKING"]


def test_severity_order_and_extra_fraction(spark):
    double = severity_of(spark, '["DOUBLE PARKING"]')["list_severity"]
    assert double > severity_of(spark, '["WRONG PARKING"]')["list_severity"]
    mixed = severity_of(spark, '["PARKING ON FOOTPATH","DOUBLE PARKING","WRONG PARKING"]')
    assert mixed["list_severity"] == 5.0 + 0.25 * 3.0
    assert severity_of(spark, "DEFECTIVE NUMBER PLATE")["list_severity"] == 0.0


def test_flags_match_by_containment(spark):
    rows = [('["SLOW NO PARKING ZONE"]',), ('["PARKING NEAR BUSTOP\\/SCHOOL"]',), (None,)]
    df = spark.createDataFrame(rows, "violation_type string")
    flags = cleaning.offence_flags(df).collect()
    assert flags[0]["off_no_parking"] == 1
    assert sum(v for k, v in flags[1].asDict().items() if k.startswith("off_")) == 0
    assert sum(v for k, v in flags[2].asDict().items() if k.startswith("off_")) == 0


def test_combined_severity_can_be_high(spark):
    # 3 + 0.25 * (3 + 2) = 4.25 although no single offence weighs 4.
    offences = "PARKING NEAR BUSTOP/SCHOOL/HOSPITAL ETC,PARKING OTHER THAN BUS STOP,PARKING ON FOOTPATH"
    df = spark.createDataFrame([(offences, "CAR")], "violation_type string, canonical_vehicle_type string")
    flagged = cleaning.offence_severity(cleaning.offence_flags(df), Settings().scoring)
    row = cleaning.severity_flags(cleaning.vehicle_factor(flagged)).first()
    assert row["offence_severity"] == 4.25 and row["is_high_severity"] == 1


def test_vehicle_factor(spark):
    df = spark.createDataFrame([(" hgv ",), ("SCOOTER",), ("HOVERCRAFT",)], "canonical_vehicle_type string")
    factors = [r["vehicle_factor"] for r in cleaning.vehicle_factor(df).collect()]
    assert factors == [1.5, 0.6, 1.0]


def test_canonical_text_falls_back(spark):
    df = spark.createDataFrame(
        [(" van ", "CAR"), ("null", "CAR"), (None, " "), ("\tNaN\n", None)], "a string, b string"
    )
    got = [r[0] for r in df.select(text.canonical(F.col("a"), F.col("b"), "Unknown")).collect()]
    assert got == ["van", "CAR", "Unknown", "Unknown"]


def test_numbers_are_plain_numbers(spark):
    df = spark.createDataFrame([("12.9",), (" 1e1 ",), ("12.9d",), ("x",), (None,)], "a string")
    assert [r[0] for r in df.select(text.number(F.col("a"))).collect()] == [12.9, 10.0, None, None, None]


def test_road_words_need_word_boundaries(spark):
    rows = [("MG Main Road", 1, 0), ("mainroads", 0, 0), ("Supermarket", 0, 0), ("Metro, ring road", 1, 1)]
    df = spark.createDataFrame(rows, "location string, road int, place int").withColumn(
        "junction_name", F.lit(" no junction ")
    )
    for row in cleaning.road_context(df).collect():
        assert (row["is_main_road"], row["is_sensitive_place"]) == (row["road"], row["place"])
        assert row["is_named_junction"] == 0


def test_word_boundary_next_to_non_ascii(spark):
    # A letter of another script is a word character: no boundary before "mall".
    df = spark.createDataFrame([("ನಗರmall",), ("ನಗರ mall",)], "location string")
    got = [r[0] for r in df.select(scoring.sensitive_place(F.col("location"))).collect()]
    assert got == [0, 1]


def test_times_are_read_as_utc_unless_they_say_otherwise(spark):
    df = spark.createDataFrame(
        [
            ("2024-01-01 00:00:37+00",),
            ("2024-01-01 00:00:37",),
            ("2024-01-01T05:30:37+05:30",),
            ("01-01-2024 00:00:37",),
            ("nonsense",),
        ],
        "created_datetime string",
    )
    got = [str(r["created_at"]) for r in cleaning.with_created_at(df, "Asia/Kolkata").collect()]
    assert got == ["2024-01-01 05:30:37"] * 4 + ["None"]


def test_window_floor_is_local(spark):
    sql = "SELECT TIMESTAMP_NTZ'2024-01-01 05:29:59' AS t"
    assert str(one(spark, sql, clock.window_floor(F.col("t"), 2))) == "2024-01-01 04:00:00"
    # Lengths that do not divide a day count from the epoch, in local time.
    assert str(one(spark, sql, clock.window_floor(F.col("t"), 5))) == "2024-01-01 03:00:00"


def test_grid_is_deterministic_and_centred(spark):
    grid = GridSettings()
    df = spark.createDataFrame([(12.971, 77.591)] * 2, "latitude double, longitude double")
    rows = cleaning.grid_centroid(cleaning.assign_grid(df, grid), grid).collect()
    assert rows[0]["zone_id"] == rows[1]["zone_id"] == "Z0_0"
    assert 12.97 < rows[0]["centroid_latitude"] < 12.98
    assert 77.59 < rows[0]["centroid_longitude"] < 77.60


@pytest.mark.parametrize(
    "x, y, latitude, longitude",
    [
        # Published centroids of a 500 m grid with this origin.
        (-3, 1, 12.976737333812434, 77.57847713571864),
        (4, 2, 12.981228889687388, 77.61074115570645),
        (-9, 6, 12.99919511318721, 77.5508222614434),
        (-1, 22, 13.07106000718649, 77.58769542714373),
    ],
)
def test_published_centroids(spark, x, y, latitude, longitude):
    df = spark.createDataFrame([(x, y)], "cell_x int, cell_y int")
    row = cleaning.grid_centroid(df, GridSettings()).first()
    assert math.isclose(row["centroid_latitude"], latitude, rel_tol=1e-14)
    assert math.isclose(row["centroid_longitude"], longitude, rel_tol=1e-14)


def test_haversine(spark):
    same = geo.haversine(*[F.lit(v) for v in (12.97, 77.59, 12.97, 77.59)])
    degree = geo.haversine(*[F.lit(v) for v in (0.0, 0.0, 1.0, 0.0)])
    assert one(spark, "SELECT 1", same) == 0
    assert math.isclose(one(spark, "SELECT 1", degree), math.radians(1) * 6_371_000.0)


def test_scores_round_half_to_even(spark):
    assert one(spark, "SELECT 2.5D AS x", F.rint("x")) == 2.0


def test_reason_ties_follow_the_listed_order(spark):
    def reason(*values):
        return one(spark, "SELECT 1", scoring.top_reason(*[F.lit(v) for v in values]))

    assert reason(1.0, 0.5, 0.5, 0.5, 1.0) == "Recurring hotspot"
    assert reason(0.9, 0.5, 0.5, 0.1, 1.0) == "Junction obstruction pattern"
    assert reason(0.0, 0.0, 0.0, 0.0, 3.0) == "High recent violation volume"


def test_unknown_reason_has_a_default_action(spark):
    action = one(spark, "SELECT 1", scoring.action_for(F.lit("other")))
    assert action == "Deploy a targeted parking-enforcement patrol"


def test_plan_window_text(spark):
    sql = "SELECT TIMESTAMP_NTZ'2024-04-07 10:00:00' AS t"
    assert one(spark, sql, clock.plan_window_text(F.col("t"))) == "07 Apr, 10:00 AM–12:00 PM"
