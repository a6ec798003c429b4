"""The streamed zone-window table against the batch one, whatever the order of arrival."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kerbwatch.operators import cleaning, zones
from kerbwatch.plans.queries import S
from kerbwatch.session import staged
from kerbwatch.sources.events_fixture import event_records
from kerbwatch.streaming import zone_windows as stream

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def records(spark):
    """Every fifth record once more, as a correction that moves it, rejects it or changes nothing."""
    rows = event_records(spark, SMALL)
    number = F.col("id").cast("long")
    again = rows.filter((number % 5 == 0) & (F.col("ingest_seq") == 0)).withColumns(
        {
            "ingest_seq": F.lit(7).cast("long"),
            "latitude": F.when(number % 3 == 0, F.lit("12.95")).otherwise(F.col("latitude")),
            "validation_status": F.when(number % 3 == 1, F.lit("rejected")).otherwise(F.col("validation_status")),
            "created_datetime": F.when(number % 20 == 0, F.lit("no time")).otherwise(F.col("created_datetime")),
        }
    )
    return staged(rows.unionByName(again), "stream-records")


def replay(spark, folder, batches, lateness=stream.LATENESS):
    for k, batch in enumerate(batches):
        batch.write.mode("append").parquet(f"{folder}/in")
        arrived = spark.readStream.schema(batch.schema).parquet(f"{folder}/in")
        stream.run_stream(arrived, f"{folder}/log", f"{folder}/checkpoint", S, lateness)
    return stream.read_changes(spark, f"{folder}/log")


def rows_of(df):
    names = sorted(df.columns)
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival_gives_the_batch_table(spark, records, tmp_path, seed):
    turn = F.pmod(F.xxhash64("id", "ingest_seq", F.lit(seed)), F.lit(3))
    log = replay(spark, tmp_path, [records.filter(turn == k) for k in range(3)])
    clean = cleaning.clean_records(records, S)
    assert rows_of(stream.zone_windows(log)) == rows_of(zones.zone_window_agg(clean))
    live = {(r.id, r.ingest_seq) for r in stream.live_records(log).collect()}
    assert live == {(r.id, r.ingest_seq) for r in clean.select("id", "ingest_seq").collect()}
    assert log.filter("sign < 0").count() > 0


def test_nothing_new_changes_nothing(spark, records, tmp_path):
    log = replay(spark, tmp_path, [records, records.limit(0)])
    before = log.count()
    again = replay(spark, tmp_path, [records.filter("ingest_seq = 0")])  # old versions once more
    assert again.count() == before


def test_corrections_beyond_the_watermark_do_not_count(spark, records, tmp_path):
    """An hour behind the newest record an id is closed; what comes then is late."""
    first = records.filter("ingest_seq = 0")
    keep = cleaning.clean_records(first, S)
    closed = keep.orderBy("created_at").select("id").first().id
    late = first.filter(F.col("id") == closed).withColumns({"ingest_seq": F.lit(9).cast("long"), "validation_status": F.lit("rejected")})
    newest = keep.orderBy(F.desc("created_at")).select("id").first().id
    timely = first.filter(F.col("id") == newest).withColumns({"ingest_seq": F.lit(9).cast("long"), "validation_status": F.lit("rejected")})
    log = replay(spark, tmp_path, [first, first.limit(0), late, timely], "1 hour")
    live = {r.id for r in stream.live_records(log).collect()}
    assert closed in live and newest not in live


def test_an_empty_stream_is_an_empty_table(spark, records, tmp_path):
    log = replay(spark, tmp_path, [records.limit(0)])
    assert stream.zone_windows(log).count() == 0


class Group:
    """State of one group, as Spark hands it over."""

    def __init__(self, watermark=0):
        self.get, self.exists, self.hasTimedOut, self.timeout, self.watermark = None, False, False, None, watermark

    def getCurrentWatermarkMs(self):
        return self.watermark

    def update(self, value):
        self.get, self.exists = value, True

    def remove(self):
        self.get, self.exists = None, False

    def setTimeoutTimestamp(self, ms):
        assert ms > self.watermark
        self.timeout = ms


def told(state, rows):
    """Runs one group over rows of (id, second, ingest_seq, keep, zone_id)."""
    names = ["id", "event_time", "ingest_seq", "keep", "zone_id"]
    frame = pd.DataFrame(rows, columns=names).reindex(columns=["id", "event_time", *stream._NAMES])
    frame["event_time"] = pd.to_datetime(frame["event_time"], unit="s")
    frame["window_second"] = [3600.0 if keep else None for keep in frame["keep"]]
    out = [f for f in stream._replace((0,), iter([frame] if rows else []), state)]
    return sorted((r.id or "", r.sign, r.ingest_seq, r.zone_id, r.window_second) for f in out for r in f.itertuples())


def test_one_call_takes_the_changes_of_many_ids():
    """A group is a bucket of ids, each with a version, an order and an end of its own."""
    state = Group()
    rows = [("a", 10, 0, True, "Z1"), ("b", 20, 0, True, "Z1"), (None, 30, 0, True, "Z2"), ("c", 20, 0, False, None), ("a", 5, 2, True, "Z3")]
    want = [("", 1, 0, "Z2", 3600), ("a", 1, 2, "Z3", 3600), ("b", 1, 0, "Z1", 3600)]
    assert told(state, rows) == want and state.timeout == 10_000
    assert told(state, [("a", 40, 1, True, "Z9"), ("b", 20, 1, False, None), ("c", 20, 1, True, "Z4")]) == [
        ("b", -1, 0, "Z1", 3600), ("c", 1, 1, "Z4", 3600),
    ]
    state.watermark, state.hasTimedOut = 25_000, True  # b and c are closed, a and the null id are not
    assert told(state, []) == [] and state.timeout == 30_000
    state.hasTimedOut = False
    assert told(state, [("a", 50, 3, True, "Z5"), ("b", 50, 0, True, "Z6")]) == [
        ("a", -1, 2, "Z3", 3600), ("a", 1, 3, "Z5", 3600), ("b", 1, 0, "Z6", 3600),
    ]
    state.watermark, state.hasTimedOut = 60_000, True
    assert told(state, []) == [] and not state.exists
