"""Record cleaning: raw text records in, scored and gridded records out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbwatch.config import DataSettings, GridSettings, ScoringSettings, Settings
from kerbwatch.functions import clock, geo, scoring, text

POLICIES = ("approved_only", "exclude_rejected_duplicate")


def dedupe_last(records: DataFrame, key: str = "id", order: str = "ingest_seq") -> DataFrame:
    """Keep the last row per key in ingest order (null is a key of its own).

    The rank-one filter prunes to one row per key inside every map task before the shuffle, so a
    key that holds a large share of the rows sends only one row per task.
    """
    newest = W.partitionBy(key).orderBy(F.col(order).desc())
    return records.withColumn("_age", F.row_number().over(newest)).filter("_age = 1").drop("_age")


def with_coordinates(records: DataFrame) -> DataFrame:
    return records.withColumns(
        {
            "latitude": text.number(F.col("latitude").cast("string")),
            "longitude": text.number(F.col("longitude").cast("string")),
        }
    )


def in_box(data: DataSettings) -> Column:
    inside = F.col("latitude").between(*data.latitude_range) & F.col("longitude").between(
        *data.longitude_range
    )
    return F.coalesce(inside, F.lit(False))


def coord_filter(records: DataFrame, data: DataSettings) -> DataFrame:
    return with_coordinates(records).filter(in_box(data))


def with_status(records: DataFrame) -> DataFrame:
    status = F.lower(text.strip(F.coalesce(F.col("validation_status"), F.lit("unreviewed"))))
    return records.withColumn("validation_status", status)


def status_allowed(policy: str) -> Column:
    status = F.col("validation_status")
    if policy == "approved_only":
        return status == "approved"
    if policy == "exclude_rejected_duplicate":
        return ~status.isin("rejected", "duplicate")
    raise ValueError(f"unknown validation policy {policy!r}; use one of {POLICIES}")


def validation_filter(records: DataFrame, policy: str) -> DataFrame:
    return with_status(records).filter(status_allowed(policy))


def with_created_at(records: DataFrame, timezone: str) -> DataFrame:
    """Local wall-clock creation time; null where the text is unreadable."""
    zoned = records.withColumn("_text", text.strip(F.col("created_datetime"))).withColumn(
        "_text", text.with_offset(F.col("_text"))
    )
    created = clock.local_time(text.instant(F.col("_text")), timezone)
    return zoned.withColumn("created_at", created).drop("_text")


def parse_created_at(records: DataFrame, timezone: str) -> DataFrame:
    return with_created_at(records, timezone).filter(F.col("created_at").isNotNull())


def canonical_text(records: DataFrame) -> DataFrame:
    """Officer-corrected vehicle type and number, falling back to the first entry."""
    return records.withColumns(
        {
            "canonical_vehicle_type": F.upper(
                text.canonical(F.col("updated_vehicle_type"), F.col("vehicle_type"), "Unknown")
            ),
            "canonical_vehicle_number": text.canonical(
                F.col("updated_vehicle_number"), F.col("vehicle_number"), "Unknown vehicle"
            ),
        }
    )


def offence_flags(records: DataFrame) -> DataFrame:
    upper = F.upper(F.coalesce(F.col("violation_type"), F.lit("")))
    return records.withColumn("_text", upper).withColumns(
        scoring.offence_flags(F.col("_text"))
    ).drop("_text")


def any_offence() -> Column:
    names = [scoring.offence_name(o) for o in scoring.OFFENCE_WEIGHTS]
    return F.greatest(*[F.col(n) for n in names]) > 0


def parking_filter(records: DataFrame) -> DataFrame:
    return offence_flags(records).filter(any_offence())


def offence_severity(flagged: DataFrame, scoring_settings: ScoringSettings) -> DataFrame:
    flags = {n: F.col(n) for n in map(scoring.offence_name, scoring.OFFENCE_WEIGHTS)}
    return flagged.withColumn(
        "offence_severity", scoring.severity(flags, scoring_settings.additional_offence_fraction)
    )


def vehicle_factor(canonical: DataFrame) -> DataFrame:
    return canonical.withColumn(
        "vehicle_factor", scoring.vehicle_factor(F.col("canonical_vehicle_type"))
    )


def road_context(records: DataFrame) -> DataFrame:
    return records.withColumns(
        {
            "is_named_junction": scoring.named_junction(F.col("junction_name")),
            "is_main_road": scoring.main_road(F.col("location")),
            "is_sensitive_place": scoring.sensitive_place(F.col("location")),
        }
    )


def location_factor(context: DataFrame, scoring_settings: ScoringSettings) -> DataFrame:
    return context.withColumn(
        "location_factor",
        scoring.location_factor(
            F.col("is_named_junction"),
            F.col("is_main_road"),
            F.col("is_sensitive_place"),
            scoring_settings,
        ),
    )


def peak_factor(timed: DataFrame, scoring_settings: ScoringSettings) -> DataFrame:
    peak = scoring.flag(clock.is_peak(F.col("created_at")))
    return timed.withColumn("is_peak_hour", peak).withColumn(
        "peak_factor",
        F.when(F.col("is_peak_hour") == 1, F.lit(scoring_settings.peak_hour_factor)).otherwise(1.0),
    )


def obstruction_units(scored: DataFrame) -> DataFrame:
    units = F.col("offence_severity") * F.col("vehicle_factor")
    return scored.withColumn(
        "obstruction_units", units * F.col("location_factor") * F.col("peak_factor")
    )


def severity_flags(scored: DataFrame) -> DataFrame:
    junction = [F.col(scoring.offence_name(o)) for o in scoring.JUNCTION_OFFENCES]
    return scored.withColumns(
        {
            "is_high_severity": scoring.flag(F.col("offence_severity") >= scoring.HIGH_SEVERITY),
            "is_heavy_vehicle": scoring.flag(F.col("vehicle_factor") >= scoring.HEAVY_VEHICLE),
            "has_main_road_offence": F.col(scoring.offence_name(scoring.MAIN_ROAD_OFFENCE)),
            "has_junction_offence": F.greatest(*junction),
        }
    )


def record_confidence(records: DataFrame) -> DataFrame:
    return records.withColumn(
        "record_confidence", scoring.record_confidence(F.col("validation_status"))
    )


def assign_grid(located: DataFrame, grid: GridSettings) -> DataFrame:
    return located.withColumns(
        {
            "cell_x": geo.cell_x(F.col("longitude"), grid),
            "cell_y": geo.cell_y(F.col("latitude"), grid),
        }
    ).withColumn("zone_id", geo.zone_id(F.col("cell_x"), F.col("cell_y")))


def grid_centroid(cells: DataFrame, grid: GridSettings) -> DataFrame:
    return cells.withColumns(
        {
            "centroid_latitude": geo.centroid_latitude(F.col("cell_y"), grid),
            "centroid_longitude": geo.centroid_longitude(F.col("cell_x"), grid),
        }
    )


def window_floor(timed: DataFrame, window_hours: int) -> DataFrame:
    return timed.withColumn("window_start", clock.window_floor(F.col("created_at"), window_hours))


def fill_defaults(records: DataFrame) -> DataFrame:
    return records.withColumns(
        {
            "police_station": text.filled(F.col("police_station"), "Unknown"),
            "junction_name": text.filled(F.col("junction_name"), "No Junction"),
            "location": text.filled(F.col("location"), "Location unavailable"),
            "device_id": F.coalesce(F.col("device_id"), F.lit("Unknown device")),
            "created_by_id": F.coalesce(F.col("created_by_id"), F.lit("Unknown officer")),
        }
    )


# Columns of a cleaned record, raw ones first.
CLEAN_COLUMNS = [
    "id", "ingest_seq", "latitude", "longitude", "location", "vehicle_number", "vehicle_type",
    "violation_type", "created_datetime", "device_id", "created_by_id", "center_code",
    "police_station", "junction_name", "updated_vehicle_number", "updated_vehicle_type",
    "validation_status", "created_at", "canonical_vehicle_type", "canonical_vehicle_number",
    "offence_severity", "vehicle_factor", "is_named_junction", "is_main_road",
    "is_sensitive_place", "location_factor", "is_peak_hour", "peak_factor", "obstruction_units",
    "is_high_severity", "is_heavy_vehicle", "has_main_road_offence", "has_junction_offence",
    "record_confidence", "cell_x", "cell_y", "zone_id", "window_start",
]


def score_records(records: DataFrame, settings: Settings) -> DataFrame:
    """Every derived column plus `keep`, row by row and without dropping anything."""
    df = with_created_at(with_status(with_coordinates(records)), settings.data.timezone)
    df = offence_flags(canonical_text(df))
    df = df.withColumn(
        "keep",
        in_box(settings.data)
        & status_allowed(settings.data.validation_policy)
        & F.col("created_at").isNotNull()
        & any_offence(),
    )
    df = vehicle_factor(offence_severity(df, settings.scoring))
    df = location_factor(road_context(df), settings.scoring)
    df = obstruction_units(peak_factor(df, settings.scoring))
    df = record_confidence(severity_flags(df))
    df = window_floor(assign_grid(df, settings.grid), settings.temporal.window_hours)
    return fill_defaults(df)


def clean_records(records: DataFrame, settings: Settings) -> DataFrame:
    """Cleaned records, one row per id.

    The last row of an id decides, even when that row is then dropped, so the row filters may not
    run before the de-duplication. What may run before is their evaluation: rows that will be
    dropped travel through the shuffle as id, order and a flag only, and of the kept rows only
    the derived columns that the caller reads.
    """
    scored = score_records(records, settings)
    payload = [c for c in CLEAN_COLUMNS if c not in ("id", "ingest_seq")]
    slim = scored.selectExpr(
        "id", "ingest_seq", "keep", *[f"CASE WHEN keep THEN {c} END AS {c}" for c in payload]
    )
    return dedupe_last(slim).filter("keep").select(*CLEAN_COLUMNS)


def offence_tokens(violation: Column) -> Column:
    """Offence names of a list-like text: JSON list, quoted list, or text split at , ; |."""
    raw = text.strip(violation)
    usable = F.when(~F.upper(raw).isin(text.BLANK_WORDS), raw)
    body = F.regexp_extract(usable, r"(?s)^[\[(](.*)[\])]$", 1)
    python_list = F.when(
        usable.rlike(r"(?s)^\[\s*'.*'\s*,?\s*\]$"),
        F.filter(
            F.regexp_extract_all(body, F.lit(r"(?s)'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\""), 1),
            lambda t: t.isNotNull(),
        ),
    )
    json_list = F.when(usable.startswith("["), F.from_json(usable, "array<string>"))
    json_text = F.when(
        usable.rlike(r"(?s)^\"([^\"\\]|\\.)*\"$"), F.from_json(F.concat(F.lit("["), usable, F.lit("]")), "array<string>")
    )
    parts = F.coalesce(python_list, json_list, json_text, F.split(usable, "[,;|]"), F.array())
    tidy = F.transform(parts, lambda t: F.regexp_replace(F.upper(text.strip(t)), r"\s+", " "))
    return F.filter(tidy, lambda t: t != "")


def offence_explode(records: DataFrame) -> DataFrame:
    """One row per record and known offence named in its list."""
    exploded = records.select(
        "id", "ingest_seq", F.explode(offence_tokens(F.col("violation_type"))).alias("offence")
    )
    return exploded.filter(F.col("offence").isin(list(scoring.OFFENCE_WEIGHTS))).withColumn(
        "offence_weight", scoring.lookup(scoring.OFFENCE_WEIGHTS, F.col("offence"), 0.0)
    )


def offence_list_severity(records: DataFrame, scoring_settings: ScoringSettings) -> DataFrame:
    """Severity from the parsed list; zero when no known offence is named. Row-local, no shuffle."""
    names = F.array(*[F.lit(o) for o in scoring.OFFENCE_WEIGHTS])
    known = F.filter(
        offence_tokens(F.col("violation_type")), lambda t: F.array_contains(names, t)
    )
    table = scoring.constant_map(scoring.OFFENCE_WEIGHTS)
    weights = F.transform(known, lambda t: F.try_element_at(table, t))
    top = F.coalesce(F.array_max("_w"), F.lit(0.0))
    total = F.aggregate("_w", F.lit(0.0), lambda a, w: a + w)
    extra = F.lit(scoring_settings.additional_offence_fraction)
    return (
        records.select("id", "ingest_seq", known.alias("offences"), weights.alias("_w"))
        .withColumn("list_severity", top + extra * (total - top))
        .drop("_w")
    )


def offence_frequency(records: DataFrame) -> DataFrame:
    return offence_explode(records).groupBy("offence").agg(F.count("*").alias("mentions"))
