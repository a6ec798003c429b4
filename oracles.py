"""SQL twins of the registered queries, for DuckDB over the same tables.

Written from the definitions, not generated from the Spark code. Every statement starts from the
whole `events` table; the common table expressions below are the steps of the definitions.
"""

from __future__ import annotations

import math

LAT0, LON0, CELL = "1.297e1", "7.759e1", "5e2"
M_LAT = "1.1132e5"
M_LON = repr(111_320.0 * math.cos(math.radians(12.97))) + "e0"
TEST_START, TEST_END = "TIMESTAMP '2024-01-24 00:00:00'", "TIMESTAMP '2024-01-31 00:00:00'"

OFFENCES = {
    "DOUBLE PARKING": 5.0,
    "PARKING NEAR TRAFFIC LIGHT OR ZEBRA CROSS": 5.0,
    "PARKING NEAR ROAD CROSSING": 5.0,
    "PARKING OPPOSITE TO ANOTHER PARKED VEHICLE": 4.0,
    "PARKING IN A MAIN ROAD": 4.0,
    "PARKING NEAR BUSTOP/SCHOOL/HOSPITAL ETC": 3.0,
    "PARKING OTHER THAN BUS STOP": 3.0,
    "PARKING ON FOOTPATH": 2.0,
    "NO PARKING": 1.5,
    "WRONG PARKING": 1.0,
}


def flag_name(offence: str) -> str:
    return "off_" + "".join(ch if ch.isalnum() else "_" for ch in offence.lower())


FLAGS = {flag_name(o): (o, w) for o, w in OFFENCES.items()}


def num(expr: str, name: str) -> str:
    """A double of the result, rounded to six places with the edge moved off short decimals."""
    return f"floor(CAST({expr} AS DOUBLE) * 1e6 + 0.5003e0) / 1e6 AS {name}"


def nums(*names: str) -> str:
    return ", ".join(num(n, n) for n in names)


def snap(expr: str) -> str:
    return f"(round_even(CAST({expr} AS DOUBLE) * 1e8, 0) / 1e8)"


STEPS: dict[str, str] = {}

STEPS["ev"] = "SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events"

STEPS["rec"] = """
SELECT CAST(event_id AS VARCHAR) AS id, c.seq AS ingest_seq,
  CASE WHEN k = 99 THEN 0e0 WHEN k = 98 THEN NULL
       ELSE 1.29e1 + (user_id % 20) * 4.5e-3 + (k % 5) * 3e-4 END AS latitude,
  7.752e1 + (CAST(floor(user_id / 20) AS INTEGER) % 20) * 4.6e-3 + (k % 7) * 2e-4 AS longitude,
  CASE user_id % 4 WHEN 0 THEN 'Outer Ring Road, Ward ' WHEN 1 THEN 'Market Street, Ward '
       WHEN 2 THEN '5th Cross, Ward ' ELSE '' END || CAST(user_id % 9 AS VARCHAR) AS location,
  'KA' || CAST(user_id * 3 + k % 3 AS VARCHAR) AS vehicle_number,
  CASE k % 6 WHEN 0 THEN 'CAR' WHEN 1 THEN 'SCOOTER' WHEN 2 THEN 'HGV' WHEN 3 THEN 'MINI LORRY'
       WHEN 4 THEN 'PASSENGER AUTO' ELSE 'HOVERCRAFT' END AS vehicle_type,
  CASE event_type WHEN 'click' THEN CASE k % 5 WHEN 0 THEN '["WRONG PARKING"]'
              WHEN 1 THEN '["PARKING NEAR TRAFFIC LIGHT OR ZEBRA CROSS","WRONG PARKING"]'
              WHEN 2 THEN '["PARKING OPPOSITE TO ANOTHER PARKED VEHICLE"]'
              WHEN 3 THEN '["PARKING OTHER THAN BUS STOP"]' ELSE 'NO PARKING; wrong  parking' END
       WHEN 'view' THEN '["NO PARKING","PARKING ON FOOTPATH"]'
       WHEN 'purchase' THEN '["DOUBLE PARKING","PARKING IN A MAIN ROAD"]'
       WHEN 'signup' THEN '["parking near road crossing","DEFECTIVE NUMBER PLATE"]'
       ELSE CASE WHEN k % 2 = 0 THEN '["DEFECTIVE NUMBER PLATE"]'
                 ELSE '["PARKING NEAR BUSTOP/SCHOOL/HOSPITAL ETC"]' END END AS violation_type,
  ts AS created_datetime, CAST(event_id % 11 AS VARCHAR) AS device_id,
  CAST(event_id % 5 AS VARCHAR) AS created_by_id, 'C1' AS center_code,
  CASE WHEN c.seq = 1 THEN 'Station X' ELSE 'Station ' || CAST(user_id % 7 AS VARCHAR) END
    AS police_station,
  CASE user_id % 3 WHEN 0 THEN 'Junction ' || CAST(user_id % 5 AS VARCHAR)
       WHEN 1 THEN 'No Junction' END AS junction_name,
  CASE k % 9 WHEN 0 THEN ' KA' || CAST(user_id AS VARCHAR) || ' ' END AS updated_vehicle_number,
  CASE k % 8 WHEN 0 THEN ' van ' END AS updated_vehicle_type,
  CASE WHEN k < 50 THEN 'approved' WHEN k < 70 THEN NULL WHEN k < 75 THEN 'Rejected'
       WHEN k < 78 THEN 'duplicate' WHEN k < 85 THEN 'created1' WHEN k < 90 THEN 'processing'
       ELSE 'other' END AS validation_status
FROM ev CROSS JOIN (SELECT CAST(unnest([0, 1]) AS BIGINT) AS seq) c
WHERE c.seq = 0 OR event_id % 37 = 0"""

STEPS["der"] = f"""
SELECT rec.* EXCLUDE (validation_status),
  lower(trim(coalesce(validation_status, 'unreviewed'))) AS validation_status,
  created_datetime + INTERVAL '330' MINUTE AS created_at,
  upper(coalesce(nullif(trim(updated_vehicle_type), ''), nullif(trim(vehicle_type), ''), 'Unknown'))
    AS canonical_vehicle_type,
  coalesce(nullif(trim(updated_vehicle_number), ''), nullif(trim(vehicle_number), ''),
    'Unknown vehicle') AS canonical_vehicle_number,
  {", ".join(f"CAST(contains(upper(violation_type), '{o}') AS INTEGER) AS {n}" for n, (o, _) in FLAGS.items())},
  CAST(coalesce(trim(junction_name), '') NOT IN ('', 'No Junction') AS INTEGER) AS is_named_junction,
  CAST(regexp_matches(location, '(?i)\\b(main road|highway|ring road|flyover|service road|arterial)\\b')
    AS INTEGER) AS is_main_road,
  CAST(regexp_matches(location,
    '(?i)\\b(metro|market|bus stand|bus stop|school|hospital|mall|station|terminal)\\b') AS INTEGER)
    AS is_sensitive_place,
  CAST(floor((longitude - {LON0}) * {M_LON} / {CELL}) AS INTEGER) AS cell_x,
  CAST(floor((latitude - {LAT0}) * {M_LAT} / {CELL}) AS INTEGER) AS cell_y
FROM rec"""

WEIGHTED = [f"{n} * {w!r}e0" for n, (_, w) in FLAGS.items()]

STEPS["fac"] = f"""
SELECT *,
  greatest({", ".join(WEIGHTED)})
    + 0.25e0 * ({" + ".join(WEIGHTED)} - greatest({", ".join(WEIGHTED)})) AS offence_severity,
  CASE canonical_vehicle_type WHEN 'HGV' THEN 1.5e0 WHEN 'MINI LORRY' THEN 1.4e0 WHEN 'VAN' THEN 1.25e0
    WHEN 'SCOOTER' THEN 0.6e0 WHEN 'PASSENGER AUTO' THEN 0.85e0 ELSE 1e0 END AS vehicle_factor,
  greatest(1e0, CASE WHEN is_named_junction = 1 THEN 1.35e0 ELSE 1e0 END,
    CASE WHEN is_main_road = 1 THEN 1.25e0 ELSE 1e0 END,
    CASE WHEN is_sensitive_place = 1 THEN 1.15e0 ELSE 1e0 END) AS location_factor,
  CAST(hour(created_at) BETWEEN 7 AND 10 OR hour(created_at) BETWEEN 16 AND 19 AS INTEGER) AS is_peak_hour,
  CASE validation_status WHEN 'approved' THEN 1e0 WHEN 'unreviewed' THEN 0.75e0
    WHEN 'created1' THEN 0.65e0 WHEN 'processing' THEN 0.65e0 ELSE 0.7e0 END AS record_confidence,
  'Z' || CAST(cell_x AS VARCHAR) || '_' || CAST(cell_y AS VARCHAR) AS zone_id,
  date_trunc('day', created_at)
    + to_hours(CAST(floor(hour(created_at) / 2) AS INTEGER) * 2) AS window_start,
  (latitude BETWEEN 12.7e0 AND 13.3e0 AND longitude BETWEEN 77.3e0 AND 77.9e0) AS in_box,
  ({" + ".join(FLAGS)}) > 0 AS is_parking
FROM der"""

STEPS["sco"] = """
SELECT *, CASE WHEN is_peak_hour = 1 THEN 1.2e0 ELSE 1e0 END AS peak_factor,
  offence_severity * vehicle_factor * location_factor
    * CASE WHEN is_peak_hour = 1 THEN 1.2e0 ELSE 1e0 END AS obstruction_units,
  CAST(offence_severity >= 4e0 AS INTEGER) AS is_high_severity,
  CAST(vehicle_factor >= 1.4e0 AS INTEGER) AS is_heavy_vehicle,
  off_parking_in_a_main_road AS has_main_road_offence,
  greatest(off_parking_near_road_crossing, off_parking_near_traffic_light_or_zebra_cross)
    AS has_junction_offence,
  coalesce(trim(junction_name), 'No Junction') AS junction_filled
FROM fac"""

STEPS["ded"] = """
SELECT * FROM sco QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingest_seq DESC) = 1"""

STEPS["cln"] = """
SELECT * FROM ded
WHERE coalesce(in_box, false) AND validation_status NOT IN ('rejected', 'duplicate') AND is_parking"""

STEPS["zw"] = f"""
SELECT zone_id, window_start, count(*) AS violation_count, {snap("sum(obstruction_units)")} AS impact_units,
  CAST(sum(is_high_severity) AS BIGINT) AS high_severity_count,
  CAST(sum(is_named_junction) AS BIGINT) AS junction_count,
  CAST(sum(has_junction_offence) AS BIGINT) AS junction_offence_count,
  CAST(sum(has_main_road_offence) AS BIGINT) AS main_road_count,
  CAST(sum(is_heavy_vehicle) AS BIGINT) AS heavy_vehicle_count,
  count(DISTINCT canonical_vehicle_number) AS unique_vehicles,
  count(DISTINCT device_id) AS active_devices, count(DISTINCT created_by_id) AS active_officers,
  avg(record_confidence) AS mean_record_confidence
FROM cln GROUP BY zone_id, window_start"""

STEPS["act"] = f"""
SELECT zone_id, count(*) AS training_records FROM cln WHERE window_start < {TEST_START}
GROUP BY zone_id HAVING count(*) >= 10"""

STEPS["kept"] = "SELECT * FROM cln WHERE zone_id IN (SELECT zone_id FROM act)"


def ref_steps(prefix: str, source: str) -> dict[str, str]:
    usable = "upper(trim({c})) NOT IN ('', 'NULL', 'NAN', 'NONE')"

    def mode(column: str, extra: str = "") -> str:
        return f"""
SELECT zone_id, trim({column}) AS v FROM {source} WHERE {usable.format(c=column)} {extra}
GROUP BY zone_id, trim({column})
QUALIFY row_number() OVER (PARTITION BY zone_id ORDER BY count(*) DESC, trim({column})) = 1"""

    return {
        f"{prefix}_st": mode("police_station"),
        f"{prefix}_ju": mode("junction_filled"),
        f"{prefix}_nj": mode("junction_filled", "AND is_named_junction = 1"),
        f"{prefix}_lo": mode("location"),
        f"{prefix}_ref": f"""
SELECT b.*, coalesce(st.v, 'Unknown') AS police_station, coalesce(ju.v, 'No Junction') AS primary_junction,
  coalesce(nj.v, nullif(left(trim(split_part(lo.v, ',', 1)), 70), ''), 'Mapped road segment') AS zone_name,
  {LAT0} + (CAST(cell_y AS DOUBLE) + 0.5e0) * {CELL} / {M_LAT} AS centroid_latitude,
  {LON0} + (CAST(cell_x AS DOUBLE) + 0.5e0) * {CELL} / {M_LON} AS centroid_longitude
FROM (SELECT zone_id, min(cell_x) AS cell_x, min(cell_y) AS cell_y, count(*) AS total_records
      FROM {source} GROUP BY zone_id) b
LEFT JOIN {prefix}_st st USING (zone_id) LEFT JOIN {prefix}_ju ju USING (zone_id)
LEFT JOIN {prefix}_nj nj USING (zone_id) LEFT JOIN {prefix}_lo lo USING (zone_id)""",
    }


MEASURES = [
    "violation_count", "impact_units", "high_severity_count", "junction_count",
    "junction_offence_count", "main_road_count", "heavy_vehicle_count", "unique_vehicles",
    "active_devices", "active_officers", "mean_record_confidence",
]

STEPS.update(ref_steps("kept", "kept"))

STEPS["pan"] = f"""
SELECT z.zone_id, w.window_start,
  {", ".join(f"coalesce(CAST(a.{m} AS DOUBLE), 0e0) AS {m}" for m in MEASURES)}
FROM act z CROSS JOIN (
  SELECT unnest(generate_series((SELECT min(window_start) FROM kept),
    (SELECT max(window_start) FROM kept), INTERVAL 2 HOUR)) AS window_start) w
LEFT JOIN zw a ON a.zone_id = z.zone_id AND a.window_start = w.window_start"""

STEPS["rep"] = """
SELECT *, CASE WHEN violation_count = 0 THEN 0e0
  ELSE least(greatest(1e0 - unique_vehicles / violation_count, 0e0), 1e0) END
  AS repeat_vehicle_rate_window FROM pan"""

LAGS, ROLLS = [1, 2, 3, 12, 84], [12, 84, 336]
KINDS = {"count": "violation_count", "impact": "impact_units"}
SHARES = {
    "junction_share_84": "junction_count",
    "junction_offence_share_84": "junction_offence_count",
    "main_road_share_84": "main_road_count",
    "heavy_vehicle_share_84": "heavy_vehicle_count",
    "high_severity_share_84": "high_severity_count",
}
CONTEXT = {
    "repeat_vehicle_rate_84": "repeat_vehicle_rate_window",
    "active_devices_mean_84": "active_devices",
    "active_officers_mean_84": "active_officers",
    "record_confidence_mean_84": "mean_record_confidence",
}
LAG_NAMES = [f"{k}_lag_{n}" for k in KINDS for n in LAGS]
ROLL_NAMES = [f"{k}_roll_mean_{w}" for k in KINDS for w in ROLLS]


def over(width: int | None) -> str:
    return f"w{width}" if width else "wall"


def rolled(column: str, width: int) -> str:
    return f"{snap(f'sum({column}) OVER w{width}')} / count(*) OVER w{width}"


STEPS["fea0"] = f"""
SELECT *,
  {", ".join(f"lag({c}, {n - 1}) OVER z AS {k}_lag_{n}" for k, c in KINDS.items() for n in LAGS)},
  {", ".join(f"{rolled(c, w)} AS {k}_roll_mean_{w}" for k, c in KINDS.items() for w in ROLLS)},
  {", ".join(f"CASE WHEN sum(violation_count) OVER w84 = 0 THEN 0e0 ELSE least(greatest(sum({c}) OVER w84 / sum(violation_count) OVER w84, 0e0), 1e0) END AS {n}" for n, c in SHARES.items())},
  {", ".join(f"avg({c}) OVER w84 AS {n}" for n, c in CONTEXT.items())},
  sum(violation_count) OVER wall AS history_observations,
  avg(violation_count) OVER wall AS zone_expanding_mean_count,
  {snap("sum(impact_units) OVER wall")} / count(*) OVER wall AS zone_expanding_mean_impact,
  window_start + INTERVAL 2 HOUR AS target_window_start,
  lead(violation_count) OVER z AS target_violation_count,
  lead(impact_units) OVER z AS target_impact_units
FROM rep
WINDOW z AS (PARTITION BY zone_id ORDER BY window_start),
  w12 AS (PARTITION BY zone_id ORDER BY window_start ROWS BETWEEN 11 PRECEDING AND CURRENT ROW),
  w84 AS (PARTITION BY zone_id ORDER BY window_start ROWS BETWEEN 83 PRECEDING AND CURRENT ROW),
  w336 AS (PARTITION BY zone_id ORDER BY window_start ROWS BETWEEN 335 PRECEDING AND CURRENT ROW),
  wall AS (PARTITION BY zone_id ORDER BY window_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""

STEPS["fea"] = """
SELECT *, (count_roll_mean_84 + 0.1e0) / (count_roll_mean_336 + 0.1e0) AS trend_ratio,
  (impact_roll_mean_84 + 0.1e0) / (impact_roll_mean_336 + 0.1e0) AS impact_trend_ratio,
  sin(2e0 * pi() * hour(target_window_start) / 24) AS target_hour_sin,
  cos(2e0 * pi() * hour(target_window_start) / 24) AS target_hour_cos,
  sin(2e0 * pi() * (isodow(target_window_start) - 1) / 7) AS target_weekday_sin,
  cos(2e0 * pi() * (isodow(target_window_start) - 1) / 7) AS target_weekday_cos,
  CAST(isodow(target_window_start) >= 6 AS INTEGER) AS target_is_weekend,
  CAST(hour(target_window_start) BETWEEN 7 AND 10 OR hour(target_window_start) BETWEEN 16 AND 19
    AS INTEGER) AS target_is_peak
FROM fea0"""

STEPS["war"] = """
SELECT * FROM fea WHERE count_lag_84 IS NOT NULL AND target_violation_count IS NOT NULL"""
STEPS["tra"] = f"SELECT * FROM war WHERE target_window_start < {TEST_START}"
STEPS["tes"] = f"""
SELECT * FROM war WHERE target_window_start >= {TEST_START} AND target_window_start < {TEST_END}"""
STEPS["pre"] = """
SELECT *, count_roll_mean_84 AS predicted_violation_count,
  impact_roll_mean_84 AS predicted_impact_units FROM tes"""

W = "target_window_start"
STEPS["sc0"] = f"""
SELECT *,
  (rank() OVER (PARTITION BY {W} ORDER BY predicted_impact_units)
    + (count(*) OVER (PARTITION BY {W}, predicted_impact_units) - 1) / 2e0)
    / count(*) OVER (PARTITION BY {W}) AS impact_percentile,
  greatest(max(history_observations) OVER (PARTITION BY {W}), 1e0) AS history_cap,
  greatest(max(count_roll_mean_84) OVER (PARTITION BY {W}), 0.1e0) AS recent_cap
FROM pre"""
STEPS["sc1"] = """
SELECT *, CAST(least(greatest(round_even(100e0 * impact_percentile, 0), 0), 100) AS INTEGER) AS impact_score,
  least(greatest(0.34e0
    + 0.42e0 * least(greatest(ln(1 + greatest(history_observations, 0)) / ln(1 + history_cap), 0e0), 1e0)
    + 0.18e0 * least(greatest(ln(1 + greatest(count_roll_mean_84, 0)) / ln(1 + recent_cap), 0e0), 1e0)
    + 0.06e0 * least(greatest(1e0 - 0.3e0
        * least(greatest(abs(ln(greatest(trend_ratio, 0.05e0))) / ln(3e0), 0e0), 1e0), 0.75e0), 1e0),
    0.35e0), 0.94e0) AS model_confidence,
  greatest(trend_ratio, 2 * junction_share_84, 2 * main_road_share_84, 2 * heavy_vehicle_share_84,
    count_roll_mean_84) AS strongest
FROM sc0"""
STEPS["sco2"] = """
SELECT *, round_even(impact_score * model_confidence * 10, 0) / 10 AS priority_score,
  CASE WHEN impact_score <= 29 THEN 'Low' WHEN impact_score <= 59 THEN 'Moderate'
    WHEN impact_score <= 79 THEN 'High' ELSE 'Critical' END AS risk_level,
  CASE strongest WHEN trend_ratio THEN 'Recurring hotspot'
    WHEN 2 * junction_share_84 THEN 'Junction obstruction pattern'
    WHEN 2 * main_road_share_84 THEN 'Main-road parking pattern'
    WHEN 2 * heavy_vehicle_share_84 THEN 'Large-vehicle obstruction'
    ELSE 'High recent violation volume' END AS top_reason
FROM sc1"""
ACTION = """CASE top_reason
    WHEN 'Recurring hotspot' THEN 'Schedule a visible repeat patrol during the full window'
    WHEN 'Junction obstruction pattern' THEN 'Clear the junction approaches and monitor turning lanes'
    WHEN 'Main-road parking pattern' THEN 'Prioritize carriageway clearance and tow-away readiness'
    WHEN 'Large-vehicle obstruction' THEN 'Deploy a heavy-vehicle capable enforcement unit'
    WHEN 'High recent violation volume' THEN 'Deploy an enforcement team before the expected peak'
    ELSE 'Deploy a targeted parking-enforcement patrol' END"""
STEPS["ful"] = """
SELECT s.*, r.* EXCLUDE (zone_id) FROM sco2 s JOIN kept_ref r USING (zone_id)"""

STEPS["lng"] = """
SELECT target_window_start, zone_id, system, target, system || ':' || target AS series, actual, predicted
FROM pre, LATERAL (VALUES
  ('forecast', 'count', target_violation_count, predicted_violation_count),
  ('forecast', 'impact', target_impact_units, predicted_impact_units),
  ('same_window_last_week', 'count', target_violation_count, count_lag_84),
  ('same_window_last_week', 'impact', target_impact_units, impact_lag_84),
  ('seven_day_average', 'count', target_violation_count, count_roll_mean_84),
  ('seven_day_average', 'impact', target_impact_units, impact_roll_mean_84))
  AS v(system, target, actual, predicted)"""
STEPS["err"] = """
SELECT system, target, avg(abs(actual - p)) AS mae, sqrt(avg((actual - p) * (actual - p))) AS rmse,
  2e0 * avg(CASE WHEN actual > 0 THEN actual * ln(actual / p) ELSE 0e0 END - actual + p)
    AS poisson_deviance,
  coalesce(corr(ra, rp), 0e0) AS rank_correlation
FROM (SELECT *,
    rank() OVER (PARTITION BY series ORDER BY actual)
      + (count(*) OVER (PARTITION BY series, actual) - 1) / 2e0 AS ra,
    rank() OVER (PARTITION BY series ORDER BY p)
      + (count(*) OVER (PARTITION BY series, p) - 1) / 2e0 AS rp
  FROM (SELECT *, greatest(predicted, 1e-9) AS p FROM lng))
GROUP BY system, target"""
STEPS["reg"] = """
SELECT system, target, metric, value FROM err, LATERAL (VALUES ('mae', mae), ('rmse', rmse),
  ('poisson_deviance', poisson_deviance), ('rank_correlation', rank_correlation)) AS v(metric, value)"""
STEPS["win"] = f"""
SELECT system, target, {W}, k, sum(actual) AS total,
  sum(CASE WHEN cr <= k THEN actual ELSE 0e0 END) AS captured,
  count(*) FILTER (WHERE cr <= k AND tr <= k) AS hits, least(k, count(*)) AS size
FROM (SELECT *, row_number() OVER (PARTITION BY series, {W} ORDER BY predicted DESC, zone_id) AS cr,
    row_number() OVER (PARTITION BY series, {W} ORDER BY actual DESC, zone_id) AS tr FROM lng)
CROSS JOIN (SELECT unnest([10, 25, 50]) AS k)
GROUP BY system, target, {W}, k"""
STEPS["rnk"] = """
SELECT system, target, metric, value FROM (
  SELECT system, target, k, avg(hits / size) AS pr,
    avg(CASE WHEN total > 0 THEN captured / total ELSE 0e0 END) AS mc,
    coalesce(sum(captured) / nullif(sum(total), 0), 0e0) AS wc
  FROM win GROUP BY system, target, k), LATERAL (VALUES
  ('precision_at_' || k, pr), ('mean_capture_at_' || k, mc), ('weighted_capture_at_' || k, wc))
  AS v(metric, value)"""
STEPS["met"] = "SELECT * FROM reg UNION ALL SELECT * FROM rnk"

# The training sample: hash text of the row key and the seed, smallest hashes first.
STEPS["has"] = """
SELECT *, md5(zone_id || '|' || strftime(window_start, '%Y-%m-%d %H:%M:%S') || '|42') AS h FROM tra"""


def sample_step(target: str, ratio: str) -> str:
    return f"""
SELECT *, CASE WHEN target_violation_count = 0 THEN n0 / greatest(wanted, 1) ELSE 1e0 END AS sample_weight
FROM (SELECT *, least(n0, CAST(floor(greatest(n1, 1) * {ratio}) AS BIGINT)) AS wanted FROM (
    SELECT *, count(*) FILTER (WHERE {target} = 0) OVER () AS n0,
      count(*) FILTER (WHERE {target} > 0) OVER () AS n1,
      row_number() OVER (PARTITION BY {target} = 0 ORDER BY h) AS pos FROM has))
WHERE {target} > 0 OR pos <= wanted"""


STEPS["smp3"] = sample_step("target_violation_count", "3e0")
STEPS["smp1"] = sample_step("target_impact_units", "1e0")
STEPS["smp2"] = sample_step("target_impact_units", "2e0")

STEPS["vcut"] = f"SELECT min({W}) AS cut FROM (SELECT DISTINCT {W} FROM tra ORDER BY {W} DESC LIMIT 24)"
STEPS["val"] = f"SELECT * FROM tra WHERE {W} >= (SELECT cut FROM vcut)"
STEPS["cand"] = """
SELECT CAST(m * 11 + l AS INTEGER) AS candidate, round(m / 10e0, 4) AS model_weight,
  round(l / 10e0, 4) AS lag_weight, round((10 - m - l) / 10e0, 4) AS roll_weight
FROM (SELECT unnest(range(11)) AS m) CROSS JOIN (SELECT unnest(range(11)) AS l) WHERE m + l <= 10"""
STEPS["obj"] = f"""
SELECT candidate, model_weight, lag_weight, roll_weight, avg(abs(y - b)) AS mae,
  coalesce(sum(CASE WHEN r <= 10 THEN y END) / nullif(sum(y), 0), 0e0) AS weighted_capture,
  avg(abs(y - b)) / greatest(avg(abs(y)), 1e-6)
    - 0.15e0 * coalesce(sum(CASE WHEN r <= 10 THEN y END) / nullif(sum(y), 0), 0e0) AS objective
FROM (SELECT *, row_number() OVER (PARTITION BY candidate, {W} ORDER BY b DESC, zone_id) AS r FROM (
    SELECT c.*, v.{W}, v.zone_id, v.target_violation_count AS y,
      {snap("greatest(v.zone_expanding_mean_count * c.model_weight + v.count_lag_84 * c.lag_weight + v.count_roll_mean_84 * c.roll_weight, 0e0)")} AS b
    FROM val v CROSS JOIN cand c))
GROUP BY candidate, model_weight, lag_weight, roll_weight"""


def haversine(la: str, lo: str, lb: str, lob: str) -> str:
    a = (
        f"(pow(sin(radians({lb} - {la}) / 2), 2)"
        f" + cos(radians({la})) * cos(radians({lb})) * pow(sin(radians({lob} - {lo}) / 2), 2))"
    )
    return f"(2e0 * 6.371e6 * atan2(sqrt({a}), sqrt(1e0 - {a})))"


def plan_steps(metres: str, where: str = "true") -> dict[str, str]:
    """Greedy plan as a walk down each window's ranking, one position per step."""
    near = haversine("p.la", "p.lo", "c.centroid_latitude", "c.centroid_longitude")
    return {
        "rk": f"""
SELECT *, CAST(row_number() OVER (PARTITION BY {W}
  ORDER BY priority_score DESC, predicted_impact_units DESC, zone_id) AS INTEGER) AS pos
FROM ful WHERE {where}""",
        "walk": f"""
SELECT {W}, 0 AS pos, CAST([] AS STRUCT(la DOUBLE, lo DOUBLE, pos INTEGER)[]) AS picked
FROM (SELECT DISTINCT {W} FROM rk)
UNION ALL
SELECT c.{W}, c.pos, CASE WHEN len(w.picked) < 8
    AND len(list_filter(w.picked, lambda p : {near} < {metres})) = 0
  THEN list_append(w.picked, {{'la': c.centroid_latitude, 'lo': c.centroid_longitude, 'pos': c.pos}})
  ELSE w.picked END
FROM walk w JOIN rk c ON c.{W} = w.{W} AND c.pos = w.pos + 1""",
        "last": f"""
SELECT {W}, list_transform(picked, lambda p : p.pos) AS taken FROM walk
QUALIFY row_number() OVER (PARTITION BY {W} ORDER BY pos DESC) = 1""",
        "pln": f"""
SELECT * FROM (SELECT rk.*, CAST(row_number() OVER (PARTITION BY rk.{W}
    ORDER BY CASE WHEN list_contains(l.taken, rk.pos) THEN 0 ELSE 1 END, rk.pos) AS INTEGER) AS rank
  FROM rk JOIN last l ON l.{W} = rk.{W}) WHERE rank <= 8""",
    }


PLAN = plan_steps("6e2")


def sql(final: str, upto: str, extra: dict[str, str] | None = None) -> str:
    """Statement with the steps `upto` needs: every step whose name occurs in a later one."""
    import re

    steps = {**STEPS, **(extra or {})}
    wanted: list[str] = []

    def need(text: str) -> None:
        for name in steps:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                wanted.append(name)
                need(steps[name])

    need(final)
    parts = [f"{n} AS ({steps[n]})" for n in steps if n in wanted]
    return f"WITH RECURSIVE {', '.join(parts)}\n{final}"


ORACLES: dict[str, str] = {}


def oracle(name: str, final: str, extra: dict[str, str] | None = None) -> None:
    ORACLES[name] = sql(final, name, extra)


ROW, SLOT, TGT = "id, ingest_seq", "zone_id, window_start", f"zone_id, {W}"

# Scans, sources, sinks
oracle("scan_violations", f"""
SELECT id, {nums("latitude", "longitude")}, location, vehicle_number, vehicle_type, violation_type,
  created_datetime, device_id, created_by_id, center_code, police_station, junction_name,
  updated_vehicle_number, updated_vehicle_type, validation_status FROM rec""")
oracle("write_intermediate", f"""
SELECT CAST(window_start AS DATE) AS window_date, count(*) AS records, {num("sum(obstruction_units)", "units")}
FROM cln GROUP BY 1""")
oracle("export_predictions", f"""
SELECT {TGT}, zone_name, police_station, primary_junction, {nums(
    "centroid_latitude", "centroid_longitude", "predicted_violation_count", "predicted_impact_units",
    "target_violation_count", "target_impact_units", "model_confidence", "priority_score",
    "trend_ratio", *SHARES, "repeat_vehicle_rate_84", "count_roll_mean_84", "impact_roll_mean_84",
    "history_observations")}, impact_score, risk_level, top_reason, target_is_peak FROM ful""")
oracle("export_zone_history", f"""
SELECT w.zone_id, w.window_start, {nums("violation_count", "impact_units")}, r.police_station, r.zone_name
FROM war w JOIN kept_ref r USING (zone_id)
WHERE window_start >= {TEST_START} - INTERVAL 35 DAY AND window_start < {TEST_END}""")
oracle("export_json", f"SELECT system, target, metric, {nums('value')} FROM met")
oracle("read_artifacts", f"""
SELECT zone_id, cell_x, cell_y, police_station, primary_junction, total_records, zone_name,
  {nums("centroid_latitude", "centroid_longitude")} FROM kept_ref""")

# Record level
oracle("dedupe_last", f"""
SELECT {ROW}, police_station, validation_status FROM rec
QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingest_seq DESC) = 1""")
oracle("coord_filter", f"SELECT {ROW}, {nums('latitude', 'longitude')} FROM fac WHERE in_box")
oracle("validation_filter", f"""
SELECT {ROW}, validation_status FROM der WHERE validation_status NOT IN ('rejected', 'duplicate')""")
oracle("parse_created_at", f"""
SELECT {ROW}, CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN created_at ELSE date_trunc('second', created_at) END
  AS created_at FROM der WHERE CAST(id AS BIGINT) % 5 < 4""")
oracle("canonical_text", f"SELECT {ROW}, canonical_vehicle_type, canonical_vehicle_number FROM der")
oracle("offence_flags", f"SELECT {ROW}, {', '.join(FLAGS)} FROM der")
oracle("parking_filter", f"SELECT {ROW}, violation_type FROM fac WHERE is_parking")
oracle("offence_severity", f"SELECT {ROW}, {nums('offence_severity')} FROM fac WHERE is_parking")
oracle("vehicle_factor", f"SELECT {ROW}, canonical_vehicle_type, {nums('vehicle_factor')} FROM fac")
oracle("road_context", f"SELECT {ROW}, is_named_junction, is_main_road, is_sensitive_place FROM der")
oracle("location_factor", f"SELECT {ROW}, {nums('location_factor')} FROM fac")
oracle("peak_factor", f"SELECT {ROW}, is_peak_hour, {nums('peak_factor')} FROM sco")
oracle("obstruction_units", f"SELECT {ROW}, {nums('obstruction_units')} FROM cln")
oracle("severity_flags", f"""
SELECT {ROW}, is_high_severity, is_heavy_vehicle, has_main_road_offence, has_junction_offence
FROM sco WHERE is_parking""")
oracle("record_confidence", f"SELECT {ROW}, validation_status, {nums('record_confidence')} FROM fac")
oracle("assign_grid", f"SELECT {ROW}, cell_x, cell_y, zone_id FROM fac WHERE in_box")
oracle("grid_centroid", f"""
SELECT {ROW}, zone_id, {num(f"{LAT0} + (cell_y + 0.5e0) * {CELL} / {M_LAT}", "centroid_latitude")},
  {num(f"{LON0} + (cell_x + 0.5e0) * {CELL} / {M_LON}", "centroid_longitude")} FROM fac WHERE in_box""")
oracle("window_floor", f"SELECT {ROW}, created_at, window_start FROM fac")
oracle("fill_defaults", f"""
SELECT {ROW}, police_station, junction_filled AS junction_name, location, device_id, created_by_id FROM sco""")
LISTED = """unnest(list_transform(CASE WHEN violation_type LIKE '[%' THEN
  CAST(json(CASE WHEN violation_type LIKE '[%' THEN violation_type ELSE '[]' END) AS VARCHAR[])
  ELSE string_split_regex(violation_type, '[,;|]') END,
  lambda t : regexp_replace(upper(trim(t)), '\\s+', ' ', 'g')))"""
WEIGHT_CASE = "CASE offence " + " ".join(f"WHEN '{o}' THEN {w!r}e0" for o, w in OFFENCES.items()) + " END"
OFFENCE_STEPS = {
    "tok": f"SELECT {ROW}, {LISTED} AS offence FROM rec",
    "kno": f"SELECT *, {WEIGHT_CASE} AS offence_weight FROM tok WHERE {WEIGHT_CASE} IS NOT NULL",
    "sev": f"""
SELECT {ROW}, string_agg(offence, '|') AS offences,
  max(offence_weight) + 0.25e0 * (sum(offence_weight) - max(offence_weight)) AS s FROM kno GROUP BY {ROW}""",
}
oracle("offence_explode", f"SELECT {ROW}, offence, {nums('offence_weight')} FROM kno", OFFENCE_STEPS)
oracle("offence_list_severity", f"""
SELECT rec.id, rec.ingest_seq, coalesce(sev.offences, '') AS offences,
  {num("coalesce(sev.s, 0e0)", "list_severity")}
FROM rec LEFT JOIN sev ON sev.id = rec.id AND sev.ingest_seq = rec.ingest_seq""", OFFENCE_STEPS)
oracle("offence_frequency", "SELECT offence, count(*) AS mentions FROM kno GROUP BY offence", OFFENCE_STEPS)
HERE = ("latitude", "longitude")
oracle("haversine", f"""
SELECT {ROW}, {num(haversine(*HERE, f"({LAT0} + (cell_y + 0.5e0) * {CELL} / {M_LAT})", f"({LON0} + (cell_x + 0.5e0) * {CELL} / {M_LON})"), "metres_to_centre")},
  {num(haversine(*HERE, LAT0, LON0), "metres_to_origin")} FROM fac WHERE in_box""")
oracle("clean_records", f"""
SELECT {ROW}, created_at, zone_id, window_start, validation_status, canonical_vehicle_type,
  police_station, {nums("offence_severity", "obstruction_units", "record_confidence")} FROM cln""")

# Aggregations and zone tables
oracle("cleaning_summary", """
SELECT count(*) AS clean_rows, min(created_at) AS date_min, max(created_at) AS date_max,
  count(DISTINCT zone_id) AS zones_before_threshold, count(DISTINCT police_station) AS police_stations,
  count(DISTINCT CASE WHEN is_named_junction = 1 THEN junction_filled END) AS named_junctions,
  (SELECT count(*) FROM rec) AS source_rows, (SELECT count(*) FROM rec) - count(*) AS removed_rows,
  10 AS parking_offence_categories, 'exclude_rejected_duplicate' AS validation_policy FROM cln""")
oracle("zone_window_agg", f"""
SELECT {SLOT}, violation_count, {nums("impact_units", "mean_record_confidence")}, high_severity_count,
  junction_count, junction_offence_count, main_road_count, heavy_vehicle_count, unique_vehicles,
  active_devices, active_officers FROM zw""")
oracle("stream_zone_window_agg", f"""
SELECT {SLOT}, violation_count, {nums("impact_units", "mean_record_confidence")}, high_severity_count,
  junction_count, junction_offence_count, main_road_count, heavy_vehicle_count, unique_vehicles,
  active_devices, active_officers FROM zw""")
oracle("stream_dedupe_last", "SELECT id, CAST(ingest_seq AS BIGINT) AS ingest_seq FROM cln")
oracle("active_zones", "SELECT * FROM act")
oracle("active_zone_semijoin", "SELECT id, zone_id, window_start FROM kept")
REF = f"""zone_id, cell_x, cell_y, police_station, primary_junction, total_records, zone_name,
  {nums("centroid_latitude", "centroid_longitude")}"""
ALL_REF = ref_steps("every", "cln")
oracle("zone_reference", f"SELECT {REF} FROM kept_ref")
oracle("zone_name_join", "SELECT zone_id, police_station, primary_junction, zone_name FROM every_ref", ALL_REF)
oracle("clean_mode", "SELECT zone_id, police_station AS modal_value FROM every_ref", ALL_REF)
oracle("zone_display_name", "SELECT zone_id, zone_name FROM every_ref", ALL_REF)
oracle("station_summary", f"""
SELECT police_station, count(*) AS violation_records, count(DISTINCT zone_id) AS unique_zones,
  {num("avg(obstruction_units)", "mean_obstruction_units")},
  {num("avg(is_high_severity)", "high_severity_share")} FROM cln GROUP BY police_station""")
oracle("zone_neighbours", f"""
SELECT zone_a, zone_b, {nums("metres")} FROM (
  SELECT a.zone_id AS zone_a, b.zone_id AS zone_b, {haversine("a.centroid_latitude",
    "a.centroid_longitude", "b.centroid_latitude", "b.centroid_longitude")} AS metres
  FROM every_ref a JOIN every_ref b ON a.zone_id < b.zone_id) WHERE metres < 2.5e3""", ALL_REF)

# Panel and features
oracle("dense_panel", f"SELECT {SLOT}, {nums(*MEASURES)} FROM pan")
oracle("panel_zone_join", f"""
SELECT {SLOT}, {nums("violation_count", "centroid_latitude", "centroid_longitude")}, cell_x, cell_y,
  police_station, zone_name, primary_junction FROM pan JOIN kept_ref USING (zone_id)""")
oracle("repeat_vehicle_rate", f"SELECT {SLOT}, {nums('repeat_vehicle_rate_window')} FROM rep")
oracle("lag_features", f"SELECT {SLOT}, {nums(*LAG_NAMES)} FROM fea")
oracle("rolling_means", f"SELECT {SLOT}, {nums(*ROLL_NAMES)} FROM fea")
oracle("stored_panel_rolling", f"SELECT {SLOT}, {nums(*ROLL_NAMES)} FROM fea")
oracle("rolling_shares", f"SELECT {SLOT}, {nums(*SHARES)} FROM fea")
oracle("rolling_context_means", f"SELECT {SLOT}, {nums(*CONTEXT)} FROM fea")
oracle("trend_ratios", f"SELECT {SLOT}, {nums('trend_ratio', 'impact_trend_ratio')} FROM fea")
EXPANDING = ["history_observations", "zone_expanding_mean_count", "zone_expanding_mean_impact"]
oracle("expanding_history", f"SELECT {SLOT}, {nums(*EXPANDING)} FROM fea")
oracle("forecast_targets", f"""
SELECT {SLOT}, {W}, {nums("target_violation_count", "target_impact_units")} FROM fea""")
ANGLES = ["target_hour_sin", "target_hour_cos", "target_weekday_sin", "target_weekday_cos"]
oracle("calendar_features", f"SELECT {SLOT}, {nums(*ANGLES)}, target_is_weekend, target_is_peak FROM fea")
oracle("warmup_filter", f"SELECT {SLOT}, {nums('count_lag_84', 'target_violation_count')} FROM war")
oracle("build_features", f"""
SELECT {TGT}, cell_x, cell_y, target_is_weekend, target_is_peak, {nums(
    "centroid_latitude", "centroid_longitude", *ANGLES, *LAG_NAMES, *ROLL_NAMES, "trend_ratio",
    "impact_trend_ratio", *SHARES, *CONTEXT, *EXPANDING)}
FROM war JOIN kept_ref USING (zone_id)""")
oracle("refresh_features", f"""
SELECT {TGT}, target_is_weekend, target_is_peak, {nums(
    *ANGLES, *LAG_NAMES, *ROLL_NAMES, "trend_ratio", "impact_trend_ratio", *SHARES, *CONTEXT, *EXPANDING)}
FROM war""")
oracle("refresh_intermediate", f"""
SELECT CAST(window_start AS DATE) AS window_date, count(*) AS records, {num("sum(obstruction_units)", "units")}
FROM cln GROUP BY 1""")

# Splits and samples
SIDE = f"zone_id, count(*) AS rows, min({W}) AS first_target, max({W}) AS last_target"
oracle("temporal_split", f"""
SELECT 'train' AS side, {SIDE} FROM tra GROUP BY zone_id
UNION ALL SELECT 'test', {SIDE} FROM tes GROUP BY zone_id""")
oracle("validation_split", f"""
SELECT 'fit' AS side, {SIDE} FROM tra WHERE {W} < (SELECT cut FROM vcut) GROUP BY zone_id
UNION ALL SELECT 'validation', {SIDE} FROM val GROUP BY zone_id""")
oracle("negative_sample", f"SELECT {SLOT}, {nums('target_violation_count', 'sample_weight')} FROM smp3")
oracle("union_samples", f"""
SELECT target_impact_units > 0 AS positive, count(*) AS rows, {num("sum(sample_weight)", "total_weight")}
FROM smp1 GROUP BY 1""")
oracle("impact_cap", f"""
SELECT {num("greatest(1e0, quantile_cont(target_impact_units, 0.999) * 1.5e0)", "impact_cap")} FROM smp2""")

# Blending
oracle("blend", f"""
SELECT {TGT}, {num("greatest(zone_expanding_mean_count * 0.5e0 + count_lag_84 * 0.3e0 + count_roll_mean_84 * 0.2e0, 0e0)", "blended")}
FROM tes""")
WEIGHTS = nums("model_weight", "lag_weight", "roll_weight")
oracle("blend_candidates", f"""
SELECT candidate, {WEIGHTS}, (SELECT count(*) FROM val) AS validation_rows FROM cand""")
oracle("weighted_capture", f"""
SELECT {num("sum(CASE WHEN r <= 10 THEN target_impact_units END)", "captured")},
  {num("sum(target_impact_units)", "total")},
  {num("sum(CASE WHEN r <= 10 THEN target_impact_units END) / sum(target_impact_units)", "weighted_capture")}
FROM (SELECT *, row_number() OVER (PARTITION BY {W} ORDER BY predicted_impact_units DESC, zone_id) AS r FROM pre)""")
SCORES = nums("mae", "weighted_capture", "objective")
oracle("blend_objectives", f"SELECT candidate, {WEIGHTS}, {SCORES} FROM obj")
oracle("calibrate_blend", f"""
SELECT candidate, {WEIGHTS}, {SCORES} FROM obj ORDER BY {snap("objective")}, candidate LIMIT 1""")

# Evaluation
oracle("regression_metrics", f"SELECT system, target, metric, {nums('value')} FROM reg")
oracle("spearman_ranks", f"""
SELECT {num("predicted_impact_units", "predicted_impact_units")}, n, {nums("average_rank")} FROM (
  SELECT predicted_impact_units, count(*) AS n, min(r) + (count(*) - 1) / 2e0 AS average_rank
  FROM (SELECT predicted_impact_units, rank() OVER (ORDER BY predicted_impact_units) AS r FROM pre)
  GROUP BY predicted_impact_units)""")
oracle("topk_per_window", f"""
SELECT {TGT}, CAST(r AS INTEGER) AS rank, {nums("predicted_impact_units")} FROM (
  SELECT *, row_number() OVER (PARTITION BY {W} ORDER BY predicted_impact_units DESC, zone_id) AS r FROM pre)
WHERE r <= 10""")
oracle("topk_intersection", f"SELECT system, target, {W}, k, hits, size FROM win WHERE k = 10")
oracle("ranking_metrics", f"SELECT system, target, metric, {nums('value')} FROM rnk")
oracle("evaluate_systems", f"SELECT system, target, metric, {nums('value')} FROM met")
oracle("evaluation_coverage", f"""
SELECT min({W}) AS evaluation_start, max({W}) AS evaluation_end, count(*) AS rows,
  count(DISTINCT {W}) AS windows, count(DISTINCT zone_id) AS zones FROM pre""")
LIFT = {
    "tab": """
SELECT system, max(value) FILTER (WHERE target = 'count' AND metric = 'mae') AS count_mae,
  max(value) FILTER (WHERE target = 'impact' AND metric = 'mae') AS impact_mae,
  100 * max(value) FILTER (WHERE target = 'impact' AND metric = 'weighted_capture_at_10') AS impact_capture_at_10,
  100 * max(value) FILTER (WHERE target = 'impact' AND metric = 'weighted_capture_at_25') AS impact_capture_at_25
FROM met GROUP BY system"""
}
oracle("baseline_lift", f"""
SELECT t.system, {", ".join(num("t." + c, c) for c in ("count_mae", "impact_mae", "impact_capture_at_10", "impact_capture_at_25"))},
  {", ".join(num(f"(b.{c} - t.{c}) / b.{c}", c + "_reduction") for c in ("count_mae", "impact_mae"))},
  {", ".join(num(f"(t.{c} - b.{c}) / b.{c}", c + "_gain") for c in ("impact_capture_at_10", "impact_capture_at_25"))}
FROM tab t CROSS JOIN (SELECT * FROM tab WHERE system = 'same_window_last_week') b""", LIFT)

# Prioritisation
oracle("impact_percentile", f"SELECT {TGT}, {nums('impact_percentile')}, impact_score FROM sc1")
oracle("window_caps", f"SELECT {TGT}, {nums('history_cap', 'recent_cap')} FROM sc0")
oracle("model_confidence", f"SELECT {TGT}, {nums('model_confidence')} FROM sc1")
oracle("priority_score", f"SELECT {TGT}, impact_score, {nums('priority_score')} FROM sco2")
oracle("risk_level", f"SELECT {TGT}, impact_score, risk_level FROM sco2")
oracle("top_reason", f"SELECT {TGT}, top_reason FROM sco2")
oracle("action_for_reason", f"SELECT {TGT}, {ACTION} AS recommended_action FROM sco2")
oracle("rank_candidates", f"""
SELECT {TGT}, CAST(row_number() OVER (PARTITION BY {W} ORDER BY priority_score DESC,
  predicted_impact_units DESC, zone_id) AS INTEGER) AS candidate_rank, {nums("priority_score")} FROM sco2""")
PLAN_SELECT = f"""
SELECT {W}, 'Team ' || rank AS team, rank, zone_id, zone_name, police_station,
  {nums("centroid_latitude", "centroid_longitude", "predicted_violation_count", "predicted_impact_units", "model_confidence")},
  strftime({W}, '%d %b, %I:%M %p') || '–' || strftime({W} + INTERVAL 2 HOUR, '%I:%M %p') AS recommended_window,
  impact_score, risk_level, top_reason, {ACTION} AS recommended_action FROM pln"""
oracle("patrol_plan", PLAN_SELECT, PLAN)
oracle("export_tables", f"""
SELECT 'zone_reference' AS artifact,
  concat_ws('|', zone_id, cell_x, cell_y, police_station, primary_junction, total_records, zone_name) AS content FROM kept_ref
UNION ALL SELECT 'patrol_plan', concat_ws('|', zone_id, team, rank, zone_name, police_station, recommended_window,
  impact_score, risk_level, top_reason, recommended_action) FROM ({PLAN_SELECT})
UNION ALL SELECT 'station_summary', concat_ws('|', police_station, count(*), count(DISTINCT zone_id)) FROM cln
  GROUP BY police_station""", PLAN)
oracle("patrol_plan_wide", PLAN_SELECT, plan_steps("2.5e3"))
oracle("patrol_plan_station", PLAN_SELECT, plan_steps("6e2", "police_station = 'Station 1'"))

# Dashboard tables
oracle("select_window_station", f"""
SELECT {TGT}, police_station, impact_score, {nums("priority_score")} FROM ful
WHERE {W} = TIMESTAMP '2024-01-25 08:00:00' AND police_station = 'Station 1'""")
oracle("risk_level_filter", f"SELECT {TGT}, risk_level FROM sco2 WHERE risk_level IN ('Critical', 'High')")
oracle("top_risk_zones", f"""
SELECT {TGT}, CAST(r AS INTEGER) AS rank, {nums("priority_score")}, risk_level FROM (
  SELECT *, row_number() OVER (PARTITION BY {W} ORDER BY priority_score DESC, zone_id) AS r
  FROM sco2 WHERE risk_level IN ('Critical', 'High')) WHERE r <= 50""")
oracle("map_style", f"""
SELECT {TGT}, CASE WHEN impact_score >= 95 THEN '127,29,29,230' WHEN impact_score >= 85 THEN '220,38,38,220'
  WHEN impact_score >= 70 THEN '234,88,12,210' WHEN impact_score >= 50 THEN '217,119,6,195'
  ELSE '37,99,235,170' END AS color,
  {num("80e0 + sqrt(greatest(predicted_impact_units, 0)) * 32", "radius")} FROM sco2""")
oracle("nearest_window", f"""
SELECT {W} AS nearest_window FROM (SELECT DISTINCT {W} FROM pre)
ORDER BY abs(epoch({W}) - epoch(TIMESTAMP '2024-01-26 09:00:00')), {W} LIMIT 1""")
oracle("distinct_windows", f"SELECT DISTINCT {W} FROM pre")
oracle("distinct_stations", "SELECT DISTINCT police_station FROM every_ref", ALL_REF)
oracle("default_window", f"""
SELECT {W} AS default_window FROM pre GROUP BY {W}
ORDER BY max(target_is_peak) DESC, {snap("sum(predicted_impact_units)")} DESC, {W} LIMIT 1""")
oracle("window_kpis", f"""
SELECT e.{W}, {nums("expected_violations", "expected_obstruction")}, critical_zones,
  {num("CASE WHEN expected_obstruction > 0 THEN covered / expected_obstruction ELSE 0e0 END", "plan_coverage")}
FROM (SELECT {W}, sum(predicted_violation_count) AS expected_violations,
    sum(predicted_impact_units) AS expected_obstruction,
    count(*) FILTER (WHERE risk_level = 'Critical') AS critical_zones FROM ful GROUP BY {W}) e
LEFT JOIN (SELECT {W}, sum(predicted_impact_units) AS covered FROM pln GROUP BY {W}) p ON p.{W} = e.{W}""", PLAN)
oracle("zone_daily_trend", f"""
SELECT d.zone_id, d.day, {num("coalesce(t.n, 0)", "violations")}, {num("coalesce(t.u, 0)", "obstruction_units")}
FROM (SELECT zone_id, CAST(unnest(generate_series(CAST(min(window_start) AS DATE),
    CAST(max(window_start) AS DATE), INTERVAL 1 DAY)) AS DATE) AS day FROM cln GROUP BY zone_id) d
LEFT JOIN (SELECT zone_id, CAST(window_start AS DATE) AS day, count(*) AS n, sum(obstruction_units) AS u
  FROM cln GROUP BY 1, 2) t ON t.zone_id = d.zone_id AND t.day = d.day""")
oracle("run_summary", f"""
SELECT (SELECT count(DISTINCT zone_id) FROM war) AS active_model_zones, (SELECT count(*) FROM tra) AS training_rows,
  (SELECT count(*) FROM tes) AS test_rows, (SELECT count(DISTINCT {W}) FROM tes) AS test_windows,
  (SELECT count(*) FROM smp3) AS model_fit_rows,
  (SELECT {W} FROM pre GROUP BY {W} ORDER BY max(target_is_peak) DESC,
    {snap("sum(predicted_impact_units)")} DESC, {W} LIMIT 1) AS default_demo_window,
  500 AS grid_size_meters, 2 AS window_hours""")

# Fitted forecasts
VECTOR = ["cell_x", "cell_y", "centroid_latitude", "centroid_longitude", *ANGLES, "target_is_weekend",
          "target_is_peak", *LAG_NAMES, *ROLL_NAMES, "trend_ratio", "impact_trend_ratio", *SHARES, *CONTEXT,
          *EXPANDING]
oracle("feature_vector", f"""
SELECT {TGT}, {len(VECTOR)} AS features, {num(f"floor(({' + '.join(VECTOR)}) * 1e3 + 0.5003e0) / 1e3", "feature_sum")}
FROM war JOIN kept_ref USING (zone_id)""")
CAPS = " , ".join(
    f"(SELECT quantile_cont(target_impact_units, 0.999) * 1.5e0 FROM smp{n})" for n in (1, 2))
oracle("impact_ensemble", f"""
SELECT member, {nums("weight")}, fit_rows, {num(f"greatest(1e0, {CAPS})", "impact_cap")} FROM (
  SELECT 'compact_ranker' AS member, 0.3e0 AS weight, (SELECT count(*) FROM smp2) AS fit_rows
  UNION ALL SELECT 'regularized_ranker', 0.7e0, (SELECT count(*) FROM smp1))""")
CAP = f"greatest(1e0, {CAPS})"
ONE_CAP = "greatest(1e0, (SELECT quantile_cont(target_impact_units, 0.999) * 1.5e0 FROM smp2))"
oracle("hotspot_model", f"""
SELECT {W}, count(*) AS rows, CAST(sum(target_violation_count) AS BIGINT) AS actual, CAST(0 AS BIGINT) AS outside,
  (SELECT count(*) FROM smp3) AS fit_rows FROM tes GROUP BY {W}""")
oracle("impact_model", f"""
SELECT {W}, count(*) AS rows, {num(snap("sum(target_impact_units)"), "actual")}, CAST(0 AS BIGINT) AS outside,
  {num(ONE_CAP, "impact_cap")} FROM tes GROUP BY {W}""")
oracle("score_models", f"""
SELECT {W}, count(*) AS rows, CAST(0 AS BIGINT) AS outside_count, CAST(0 AS BIGINT) AS outside_impact,
  {num(CAP, "impact_cap")} FROM tes GROUP BY {W}""")
oracle("train_models", f"""
SELECT system, target, metric, CASE WHEN system = 'forecast' THEN 1e0 ELSE {num("value", "value").rsplit(" AS ", 1)[0]} END AS value
FROM met""")
oracle("feature_importance", f"""
SELECT model, feature, (SELECT count(*) FROM tes) AS rows_scored, true AS finite, 0e0 AS importance_std
FROM (SELECT unnest(['hotspot', 'impact']) AS model) CROSS JOIN (SELECT unnest({VECTOR!r}) AS feature)""")
oracle("importance_topn", """
SELECT CAST(12 AS BIGINT) AS features, true AS largest, 'impact' AS model FROM (SELECT count(*) AS n FROM tes)
WHERE n > 0""")
oracle("model_store", f"SELECT {W}, count(*) AS rows, CAST(0 AS BIGINT) AS different FROM tes GROUP BY {W}")
