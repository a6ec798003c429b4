"""Stored tables kept up to date: late or corrected records make again only the days they touch.

A store is a folder of four tables by local date, a ledger of record versions and the bounds of the
panel. `create_store` lays it down, `refresh` takes a batch of raw records in. After any order of
batches the tables equal those of one run over all records.

    records       cleaned records
    zone_windows  per zone and window, see `zone_window_agg`
    day_sums      per zone and day, what running sums need: history before a day is their sum
    features      feature rows of the active zones, by the date of their own window

Whole days are replaced by dynamic partition overwrite. That passes over days without rows, so every
replaced day also holds one marker row (`kept` is false), which readers leave out; a day whose last
record moved away is thereby emptied. The ledger is appended last: a refresh that died midway is
simply run again with the same batch.
"""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbwatch.config import Settings
from kerbwatch.functions import clock
from kerbwatch.functions.scoring import in_steps
from kerbwatch.operators import cleaning, panel, zones
from kerbwatch.operators import features as feats
from kerbwatch.session import small_side, spread, staged

TABLES = ("records", "zone_windows", "day_sums", "features")
EPOCH = date(1970, 1, 1)
LEDGER = "key string, ingest_seq bigint, window_date date"
BOUNDS = "zone_id string, first timestamp_ntz, last timestamp_ntz"


def _key() -> Column:
    """Record id as a join key; null is an id of its own."""
    return F.when(F.col("id").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("id")))


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("window_date", F.to_date("window_start"))


def _put(df: DataFrame, path: str, days: list[date]) -> None:
    """Replaces the given days by the rows of `df`, which must lie within them."""
    marks = df.sparkSession.createDataFrame([(d,) for d in days], "window_date date")
    kinds = {f.name: f.dataType for f in df.schema.fields if f.name != "window_date"}
    marks = marks.select("window_date", *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
    every = df.withColumn("kept", F.lit(True)).unionByName(marks.withColumn("kept", F.lit(False)))
    writer = every.hint("rebalance", "window_date").write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("window_date").parquet(path)


def read_stored(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of the four tables, with `window_date` to prune by."""
    return spark.read.parquet(f"{root}/{name}").filter("kept").drop("kept")


def _stages(raw: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    """The four tables as one run would make them, for their columns."""
    clean = _dated(cleaning.clean_records(raw, settings))
    windows = zones.zone_window_agg(clean)
    dense = panel.densify(windows, "zone_id", "window_start", clock.hours(1), panel.MEASURES)
    features = feats.build_features(dense, settings.temporal)
    return dict(zip(TABLES, (clean, _dated(windows), _day_sums(_dated(windows)), _dated(features)), strict=True))


def create_store(spark: SparkSession, root: str, raw: DataFrame, settings: Settings) -> None:
    """An empty store for records with the columns of `raw`, whose rows are not read."""
    for name, df in _stages(raw, settings).items():
        _put(df.limit(0), f"{root}/{name}", [EPOCH])
    spark.createDataFrame([], LEDGER).write.parquet(f"{root}/ledger")
    spark.createDataFrame([], BOUNDS).write.parquet(f"{root}/bounds")


def refresh(raw: DataFrame, root: str, settings: Settings) -> list[date]:
    """Takes in a batch of raw records; returns the days whose records changed.

    Of each id the version with the largest `ingest_seq` counts, whichever batch brings it. Only
    the ids of the batch are looked up in the ledger, only days that lose or gain a record are made
    again, and features from the day before the first of them, with the history of older days added
    from `day_sums` instead of being read again. Should the set of active zones or the start of the
    panel change, all features are made anew. Batches must be taken in one after the other.
    """
    spark = raw.sparkSession
    raw = staged(raw, "batch")
    newer = _newer_versions(raw, root)
    # Cleaning sorts the rows of a split; written files would be read as one split per core.
    dealt = spread(raw, raw.count())
    added = _dated(cleaning.clean_records(dealt, settings)).withColumn("key", _key())
    added = staged(added.join(newer.select("key"), "key", "left_semi"), "batch-records")
    moved = newer.select(F.col("was").alias("window_date")).union(added.select("window_date"))
    days = sorted(r["window_date"] for r in moved.dropna().distinct().collect())  # a row per day
    if days:
        of_days = F.col("window_date").isin(days)
        stored = read_stored(spark, root, "records").filter(of_days).withColumn("key", _key())
        left = stored.join(newer.select("key"), "key", "left_anti")
        records = staged(left.unionByName(added).drop("key"), "refreshed-records")
        _put(records, f"{root}/records", days)
        windows = staged(_dated(zones.zone_window_agg(records)), "refreshed-windows")
        _put(windows, f"{root}/zone_windows", days)
        _put(_day_sums(windows), f"{root}/day_sums", days)
        _refresh_features(spark, root, settings, days)
    told = newer.join(added.select("key", "window_date"), "key", "left")
    told.select("key", "ingest_seq", "window_date").write.mode("append").parquet(f"{root}/ledger")
    return days


def _newer_versions(raw: DataFrame, root: str) -> DataFrame:
    """key, ingest_seq, was: ids of the batch that it has a newer version of, and their day so far."""
    ledger = raw.sparkSession.read.schema(LEDGER).parquet(f"{root}/ledger")
    latest = raw.groupBy(_key().alias("key")).agg(F.max("ingest_seq").cast("bigint").alias("ingest_seq"))
    latest = staged(latest, "batch-versions")
    known = ledger.join(latest.select("key"), "key", "left_semi")
    known = known.groupBy("key").agg(F.max(F.struct("ingest_seq", "window_date")).alias("known"))
    both = latest.join(known, "key", "left")
    newer = both.filter(F.col("known").isNull() | (F.col("ingest_seq") > F.col("known.ingest_seq")))
    return staged(newer.select("key", "ingest_seq", F.col("known.window_date").alias("was")), "newer")


def _day_sums(windows: DataFrame) -> DataFrame:
    """Per zone and day the sums that running sums go on from."""
    sums = [
        F.sum(in_steps(F.col(c)) if c in feats.STEPPED else F.col(c).cast("double")).alias(c)
        for c in feats.RUNNING
    ]
    return feats.repeat_vehicle_rate(windows).groupBy("zone_id", "window_date").agg(*sums)


def _bounds(windows: DataFrame, settings: Settings) -> DataFrame:
    """Active zones, each with the first and last window of all of them."""
    active = zones.in_active_zones(windows, zones.active_zones(windows, settings), settings)
    per_zone = active.groupBy("zone_id").agg(F.min("window_start").alias("a"), F.max("window_start").alias("b"))
    per_zone = staged(per_zone, "active-zones")
    ends = per_zone.agg(F.min("a").alias("first"), F.max("b").alias("last")).first()
    texts = {c: None if ends[c] is None else str(ends[c]) for c in ("first", "last")}  # none without zones
    return per_zone.select("zone_id", *[clock.ntz(text).alias(c) for c, text in texts.items()])


def _ends(bounds: DataFrame) -> tuple[datetime, datetime] | None:
    row = bounds.select("first", "last").first()
    return (row["first"], row["last"]) if row else None


def _refresh_features(spark: SparkSession, root: str, settings: Settings, days: list[date]) -> None:
    windows = read_stored(spark, root, "zone_windows")
    bounds = staged(_bounds(windows, settings), "bounds")
    # Read before it is replaced.
    before = staged(spark.read.schema(BOUNDS).parquet(f"{root}/bounds"), "bounds-before")
    now, then = _ends(bounds), _ends(before)
    if now is None and then is None:
        return
    known = [e for e in (now, then) if e]
    zones_then, zones_now = before.select("zone_id"), bounds.select("zone_id")
    same = now and then and now[0] == then[0]
    same = same and zones_then.exceptAll(zones_now).isEmpty() and zones_now.exceptAll(zones_then).isEmpty()
    first = min(e[0] for e in known)
    start = min(days[0], *(e[1].date() for e in known)) if same else first.date()
    step = timedelta(hours=settings.temporal.window_hours)
    # The window before the first touched one has its target in it.
    since = max((datetime.combine(start, time()) - step).date(), first.date())
    until = max(e[1] for e in known).date()
    replaced = [since + timedelta(days=i) for i in range((until - since).days + 1)]
    if now is None:
        made = read_stored(spark, root, "features").limit(0)
    else:
        made = _features_since(spark, root, settings, zones_now, now, since).filter(F.col("window_date") >= F.lit(since))
    _put(staged(made, "refreshed-features"), f"{root}/features", replaced)
    bounds.write.mode("overwrite").parquet(f"{root}/bounds")


def _features_since(
    spark: SparkSession, root: str, settings: Settings, active: DataFrame, ends: tuple[datetime, datetime], since: date
) -> DataFrame:
    """Feature rows from `since` on, from the stored days that its widest window reaches back to."""
    temporal, (first, last) = settings.temporal, ends
    step = timedelta(hours=temporal.window_hours)
    reach = max(*temporal.lags, *temporal.rolls, temporal.context_roll) + 1
    opened = (datetime.combine(since, time()) - reach * step).date()
    skipped = max(0, -(-(datetime.combine(opened, time()) - first) // step))
    start = first + skipped * step  # the first window of the slice
    at = clock.ntz(str(start))
    of_zone = small_side(active, settings.max_zones())
    seen = read_stored(spark, root, "zone_windows").filter(F.col("window_date") >= F.lit(start.date()))
    seen = seen.filter(F.col("window_start") >= at).join(of_zone, "zone_id", "left_semi")
    # Every zone gets a row at the start, so that all are stretched over the whole slice.
    anchors = active.select("zone_id", at.alias("window_start"), *[F.lit(0).alias(m) for m in panel.MEASURES])
    held = seen.select("zone_id", "window_start", *panel.MEASURES).unionByName(anchors)
    held = held.groupBy("zone_id", "window_start").agg(*[F.max(m).alias(m) for m in panel.MEASURES])
    dense = panel.densify(
        held, "zone_id", "window_start", clock.hours(temporal.window_hours), panel.MEASURES, last=clock.ntz(str(last))
    )
    older = read_stored(spark, root, "day_sums").filter(F.col("window_date") < F.lit(start.date()))
    carried = older.groupBy("zone_id").agg(*[F.sum(c).alias(c) for c in feats.RUNNING])
    running = feats.with_history(dense, small_side(carried, settings.max_zones()), skipped)
    return _dated(feats.build_features(running, temporal))
