"""Obstruction scoring expressions and the lookup values behind them."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbwatch.config import ScoringSettings
from kerbwatch.functions.text import NOT_A_JUNCTION, strip

# Weight of each parking offence.
OFFENCE_WEIGHTS = {
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

# Factor of each vehicle type; any other type counts 1.0.
VEHICLE_FACTORS = {
    "HGV": 1.50,
    "LORRY/GOODS VEHICLE": 1.50,
    "TANKER": 1.50,
    "PRIVATE BUS": 1.50,
    "TOURIST BUS": 1.50,
    "FACTORY BUS": 1.50,
    "BUS (BMTC/KSRTC)": 1.50,
    "SCHOOL VEHICLE": 1.45,
    "MINI LORRY": 1.40,
    "TRACTOR": 1.40,
    "LGV": 1.25,
    "TEMPO": 1.25,
    "VAN": 1.25,
    "MAXI-CAB": 1.20,
    "GOODS AUTO": 1.15,
    "CAR": 1.00,
    "JEEP": 1.00,
    "PASSENGER AUTO": 0.85,
    "MOTOR CYCLE": 0.60,
    "SCOOTER": 0.60,
    "MOPED": 0.55,
    "OTHERS": 1.00,
}

# Trust in a record by validation status; any other status counts 0.70.
STATUS_CONFIDENCE = {"approved": 1.0, "unreviewed": 0.75, "created1": 0.65, "processing": 0.65}
OTHER_STATUS_CONFIDENCE = 0.70

# Words that mark a main road or a sensitive place (any case, whole words).
MAIN_ROAD_WORDS = "main road|highway|ring road|flyover|service road|arterial"
SENSITIVE_PLACE_WORDS = "metro|market|bus stand|bus stop|school|hospital|mall|station|terminal"

# Thresholds and names of the reasons, risk levels, actions and map colours.
HIGH_SEVERITY = 4.0
HEAVY_VEHICLE = 1.4
MAIN_ROAD_OFFENCE = "PARKING IN A MAIN ROAD"
JUNCTION_OFFENCES = ["PARKING NEAR ROAD CROSSING", "PARKING NEAR TRAFFIC LIGHT OR ZEBRA CROSS"]
REASON_ACTIONS = {
    "Recurring hotspot": "Schedule a visible repeat patrol during the full window",
    "Junction obstruction pattern": "Clear the junction approaches and monitor turning lanes",
    "Main-road parking pattern": "Prioritize carriageway clearance and tow-away readiness",
    "Large-vehicle obstruction": "Deploy a heavy-vehicle capable enforcement unit",
    "High recent violation volume": "Deploy an enforcement team before the expected peak",
}
DEFAULT_ACTION = "Deploy a targeted parking-enforcement patrol"
RISK_LEVELS = [(29, "Low"), (59, "Moderate"), (79, "High"), (100, "Critical")]
MAP_COLOURS = [
    (95, [127, 29, 29, 230]),
    (85, [220, 38, 38, 220]),
    (70, [234, 88, 12, 210]),
    (50, [217, 119, 6, 195]),
    (None, [37, 99, 235, 170]),
]


def lookup(values: dict, key: Column, default) -> Column:
    """Constant-map lookup; for tables of a few dozen fixed entries."""
    return F.coalesce(F.try_element_at(constant_map(values), key), F.lit(default))


def constant_map(values: dict) -> Column:
    def literal(v) -> str:
        return f"{v!r}D" if isinstance(v, float) else f"'{v}'"

    return F.expr(f"map({', '.join(f'{literal(k)}, {literal(v)}' for k, v in values.items())})")


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def snapped(c: Column, scale: float = 1e8) -> Column:
    """Drop summation noise below the last decimal that counts, the eighth unless told otherwise.

    For sums of moderate size: above 9e7 a double cannot hold the eighth decimal. Sums of units over
    records and over history are therefore taken in whole steps (`in_steps`) instead.
    """
    return F.rint(c * scale) / scale


def in_steps(c: Column) -> Column:
    """Units as a whole number of 1e-8 steps, in which sums are exact in any order."""
    return F.rint(c * 1e8).cast("bigint")


def from_steps(c: Column) -> Column:
    return c / F.lit(1e8)


def offence_name(offence: str) -> str:
    return "off_" + "".join(ch if ch.isalnum() else "_" for ch in offence.lower())


def offence_flags(upper_text: Column) -> dict[str, Column]:
    """One 0/1 column per known offence: the upper-cased raw text contains its name."""
    return {offence_name(o): upper_text.contains(o).cast("int") for o in OFFENCE_WEIGHTS}


def severity(flags: dict[str, Column], extra_fraction: float) -> Column:
    weighted = [flags[offence_name(o)] * F.lit(w) for o, w in OFFENCE_WEIGHTS.items()]
    top = F.greatest(*weighted)
    return top + F.lit(extra_fraction) * (reduce(add, weighted) - top)


def vehicle_factor(vehicle_type: Column) -> Column:
    return lookup(VEHICLE_FACTORS, F.upper(strip(vehicle_type)), 1.0)


def named_junction(junction: Column) -> Column:
    name = F.upper(strip(F.coalesce(junction, F.lit(""))))
    return flag(~name.isin(NOT_A_JUNCTION))


def _has_word(location: Column, words: str) -> Column:
    return flag(location.rlike(rf"(?iU)\b(?:{words})\b"))


def main_road(location: Column) -> Column:
    return _has_word(location, MAIN_ROAD_WORDS)


def sensitive_place(location: Column) -> Column:
    return _has_word(location, SENSITIVE_PLACE_WORDS)


def location_factor(junction: Column, road: Column, place: Column, s: ScoringSettings) -> Column:
    def factor(mark: Column, value: float) -> Column:
        return F.when(mark == 1, F.lit(value)).otherwise(F.lit(1.0))

    return F.greatest(
        F.lit(1.0),
        factor(junction, s.named_junction_factor),
        factor(road, s.main_road_factor),
        factor(place, s.sensitive_place_factor),
    )


def record_confidence(status: Column) -> Column:
    return lookup(STATUS_CONFIDENCE, status, OTHER_STATUS_CONFIDENCE)


def risk_level(score: Column) -> Column:
    level = F.when(score <= RISK_LEVELS[0][0], RISK_LEVELS[0][1])
    for upper, name in RISK_LEVELS[1:]:
        level = level.when(score <= upper, name)
    return level


def top_reason(trend: Column, junction: Column, road: Column, heavy: Column, volume: Column) -> Column:
    """Name of the largest signal; the order of REASON_ACTIONS breaks ties."""
    zero = F.lit(0.0)
    signals = [
        F.coalesce(trend, zero),
        F.coalesce(junction, zero) * 2,
        F.coalesce(road, zero) * 2,
        F.coalesce(heavy, zero) * 2,
        F.coalesce(volume, zero),
    ]
    largest = F.greatest(*signals)
    names = list(REASON_ACTIONS)
    reason = F.when(signals[0] == largest, names[0])
    for name, signal in zip(names[1:], signals[1:]):
        reason = reason.when(signal == largest, name)
    return reason


def action_for(reason: Column) -> Column:
    return lookup(REASON_ACTIONS, reason, DEFAULT_ACTION)


def map_colour(score: Column) -> Column:
    colour = None
    for floor, rgba in MAP_COLOURS:
        value = F.array(*[F.lit(v) for v in rgba])
        if floor is None:
            return colour.otherwise(value)
        colour = F.when(score >= floor, value) if colour is None else colour.when(score >= floor, value)
    return colour


def map_radius(impact: Column) -> Column:
    return F.lit(80.0) + F.sqrt(F.greatest(impact, F.lit(0.0))) * 32
