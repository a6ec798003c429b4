"""Zone-window table of a stream of records, with corrections taken back exactly.

A stateful step keeps the last version of every record id and writes changes: what a version adds,
and, when a later one replaces it, the same with the opposite sign. Changes are appended to a table
by the file sink, each exactly once. Sums of changes are the sums of the last versions, and an actor
is present in a zone and window as long as its changes there add up to more than nothing, so distinct
counts are exact too.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kerbwatch.config import Settings
from kerbwatch.functions.scoring import from_steps, in_steps
from kerbwatch.operators.cleaning import score_records

FLAGS = {
    "is_high_severity": "high_severity_count",
    "is_named_junction": "junction_count",
    "has_junction_offence": "junction_offence_count",
    "has_main_road_offence": "main_road_count",
    "is_heavy_vehicle": "heavy_vehicle_count",
}
ACTORS = {
    "canonical_vehicle_number": "unique_vehicles",
    "device_id": "active_devices",
    "created_by_id": "active_officers",
}
_VERSION = (
    "ingest_seq long, keep boolean, zone_id string, window_second long, "
    + "".join(f"{c} int, " for c in FLAGS)
    + "unit_steps long, confidence_steps long, "
    + ", ".join(f"{c} string" for c in ACTORS)
)
_NAMES = [part.split()[0] for part in _VERSION.split(", ")]
_WHOLE = [part.split()[0] for part in _VERSION.split(", ") if part.split()[1] in ("int", "long")]
_CHANGE = f"id string, sign int, {_VERSION}"
# Groups of ids that share one state: 36 million ids are 35,000 in each.
_BUCKETS = 1024
# How far behind the newest record a correction may come, unless told otherwise.
LATENESS = "60 days"


def versions(records: DataFrame, settings: Settings) -> DataFrame:
    """Scored records, row by row; a version that cleaning drops carries its id, order and flag only."""
    scored = score_records(records, settings)
    second = F.unix_seconds(F.col("window_start").cast("timestamp"))
    values = {
        "zone_id": F.col("zone_id"),
        "window_second": second,
        **{c: F.col(c).cast("int") for c in FLAGS},
        "unit_steps": in_steps(F.col("obstruction_units")).cast("long"),
        "confidence_steps": in_steps(F.col("record_confidence")).cast("long"),
        **{c: F.col(c) for c in ACTORS},
    }
    kept = [F.when(F.col("keep"), v).alias(n) for n, v in values.items()]
    return scored.select(
        "id", F.col("created_at").cast("timestamp").alias("event_time"), F.col("ingest_seq").cast("long").alias("ingest_seq"), "keep", *kept
    )


def _rows(frame: pd.DataFrame) -> Iterator[tuple]:
    """(id, time in ms, version) of every row; whole numbers beside nulls arrive as floats."""
    columns = [[None if v != v else v for v in frame[c].tolist()] for c in ("id", *_NAMES)]
    for n, name in enumerate(("id", *_NAMES)):
        if name in _WHOLE and frame[name].dtype.kind != "i":
            columns[n] = [None if v is None else int(v) for v in columns[n]]
    stamps = pd.to_datetime(frame["event_time"])
    stamps = stamps.to_numpy("datetime64[ms]").astype("int64").tolist()
    times = [None if missing else t for t, missing in zip(stamps, frame["event_time"].isna(), strict=True)]
    return zip(columns[0], times, zip(*columns[1:], strict=True), strict=True)


def _replace(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Changes from the versions known so far of a bucket's ids to the last ones seen.

    A version that comes late is older and changes nothing. An id is forgotten once no correction of
    it can come any more: when the watermark has passed the newest time of what it last brought.
    """
    now = state.getCurrentWatermarkMs()
    known = pickle.loads(zlib.decompress(state.get[0])) if state.exists else {}  # id -> (end, version)
    seen: dict = {}  # id -> [newest time, version]
    if not state.hasTimedOut:
        for frame in frames:
            for id_, time, version in _rows(frame):
                entry = seen.setdefault(id_, [time, version])
                if version[0] > entry[1][0]:
                    entry[1] = version
                if time is not None and (entry[0] is None or time > entry[0]):
                    entry[0] = time
    changes = []
    for id_, (newest, version) in seen.items():
        old = known[id_][1] if id_ in known else None
        if old is None or version[0] > old[0]:
            changes += [(id_, sign, *v) for sign, v in ((-1, old), (1, version)) if v is not None and v[1]]
        else:
            version = old
        known[id_] = (None if newest is None else max(newest, now + 1), version)
    known = {i: entry for i, entry in known.items() if entry[0] is None or entry[0] >= now}
    if known:
        state.update((zlib.compress(pickle.dumps(known, pickle.HIGHEST_PROTOCOL), 1),))
        ends = [end for end, _ in known.values() if end is not None]
        if ends:
            state.setTimeoutTimestamp(max(min(ends), now + 1))
    elif state.exists:
        state.remove()
    if changes:
        yield pd.DataFrame(changes, columns=["id", "sign", *_NAMES], dtype=object)


def changes(records: DataFrame, settings: Settings, lateness: str = LATENESS) -> DataFrame:
    """Stream of changes. State is one version per id for as long as the watermark allows.

    A group costs a call into Python, so it is not one id but a bucket of ids, with their versions as
    its state. The number of buckets is part of the state's keys.
    """
    stamped = versions(records, settings).withWatermark("event_time", lateness)
    bucket = F.pmod(F.xxhash64("id"), F.lit(_BUCKETS))
    return stamped.withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(
        _replace, _CHANGE, "versions binary", "append", GroupStateTimeout.EventTimeTimeout
    )


def run_stream(records: DataFrame, log: str, checkpoint: str, settings: Settings, lateness: str = LATENESS) -> None:
    """Takes what has arrived since the last run into the table of changes under `log`, and ends.

    Both paths must be shared by all executors. State and progress live under `checkpoint`.
    """
    writer = changes(records, settings, lateness).writeStream.format("parquet").outputMode("append")
    job = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(log)
    job.awaitTermination()


def read_changes(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.schema(_CHANGE).parquet(log)


def live_records(log: DataFrame) -> DataFrame:
    """(id, ingest_seq) of the versions that count now."""
    sums = log.groupBy("id", "ingest_seq").agg(F.sum("sign").alias("n"))
    return sums.filter("n > 0").drop("n")


def zone_windows(log: DataFrame) -> DataFrame:
    """The zone-window table of everything streamed so far.

    Changes are first added up by zone, window and actor, combined before the shuffle, so a zone with
    a large share of the records is spread over tasks.
    """
    entries = [F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("actor"))]
    entries += [F.struct(F.lit(out).alias("kind"), F.col(c).alias("actor")) for c, out in ACTORS.items()]
    sums = {**{out: F.col(c) for c, out in FLAGS.items()}, "unit_steps": F.col("unit_steps"), "confidence_steps": F.col("confidence_steps")}
    own = F.col("kind").isNull()
    by_actor = (
        log.select("*", F.inline(F.array(*entries)))
        .groupBy("zone_id", "window_second", "kind", "actor")
        .agg(F.sum("sign").alias("n"), *[F.sum(F.when(own, F.col("sign") * v)).alias(n) for n, v in sums.items()])
    )
    present = F.col("n") > 0
    table = by_actor.groupBy("zone_id", "window_second").agg(
        F.sum(F.when(own, F.col("n"))).alias("violation_count"),
        from_steps(F.sum("unit_steps")).alias("impact_units"),
        *[F.sum(n).alias(n) for n in FLAGS.values()],
        *[F.count(F.when(present & (F.col("kind") == out) & F.col("actor").isNotNull(), 1)).alias(out) for out in ACTORS.values()],
        F.sum("confidence_steps").alias("_confidence"),
    )
    return table.filter("violation_count > 0").select(
        "zone_id",
        F.timestamp_seconds("window_second").cast("timestamp_ntz").alias("window_start"),
        "violation_count", "impact_units", *FLAGS.values(), *ACTORS.values(),
        (from_steps(F.col("_confidence")) / F.col("violation_count")).alias("mean_record_confidence"),
    )
