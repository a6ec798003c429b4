"""Run settings. Everything here is plain driver-side configuration: small, frozen, hashable."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

# Fixed value: metres per degree of latitude used by the grid.
METRES_PER_DEGREE_LATITUDE = 111_320.0
# Fixed value: sphere radius in metres used by the distance function.
EARTH_RADIUS_METRES = 6_371_000.0


@dataclass(frozen=True)
class DataSettings:
    timezone: str = "Asia/Kolkata"
    validation_policy: str = "exclude_rejected_duplicate"
    latitude_range: tuple[float, float] = (12.70, 13.30)
    longitude_range: tuple[float, float] = (77.30, 77.90)


@dataclass(frozen=True)
class GridSettings:
    origin_latitude: float = 12.97
    origin_longitude: float = 77.59
    cell_metres: int = 500
    min_zone_observations: int = 50

    @property
    def metres_per_degree_longitude(self) -> float:
        return METRES_PER_DEGREE_LATITUDE * math.cos(math.radians(self.origin_latitude))


@dataclass(frozen=True)
class TemporalSettings:
    """Times are local wall-clock text, `yyyy-MM-dd HH:mm:ss`."""

    window_hours: int = 2
    lag_windows: tuple[int, ...] = (1, 2, 3, 12, 84)
    rolling_windows: tuple[int, ...] = (12, 84, 336)
    test_start: str = "2024-04-01 00:00:00"
    test_end: str = "2024-04-09 00:00:00"

    @property
    def lags(self) -> list[int]:
        return sorted(set(self.lag_windows))

    @property
    def rolls(self) -> list[int]:
        return sorted(set(self.rolling_windows))

    @property
    def short_roll(self) -> int:
        return 84 if 84 in self.rolls else self.rolls[0]

    @property
    def long_roll(self) -> int:
        return 336 if 336 in self.rolls else self.rolls[-1]

    @property
    def context_roll(self) -> int:
        return 84 if 84 in self.rolls else self.rolls[-1]


@dataclass(frozen=True)
class ScoringSettings:
    additional_offence_fraction: float = 0.25
    peak_hour_factor: float = 1.20
    named_junction_factor: float = 1.35
    main_road_factor: float = 1.25
    sensitive_place_factor: float = 1.15


@dataclass(frozen=True)
class BoostSettings:
    """Size of one boosted forecast."""

    name: str = "model"
    weight: float = 1.0
    max_iter: int = 35
    learning_rate: float = 0.06
    max_leaf_nodes: int = 15
    min_samples_leaf: int = 30
    l2_regularization: float = 1.0
    zero_to_positive_ratio: float = 2.0


@dataclass(frozen=True)
class ModelSettings:
    random_seed: int = 42
    hotspot: BoostSettings = BoostSettings("hotspot", 1.0, 100, 0.035, 23, 40, 2.0, 3.0)
    impact_base: BoostSettings = BoostSettings("impact")
    impact_members: tuple[BoostSettings, ...] = (
        BoostSettings("compact_ranker", 0.3, 35, 0.06, 15, 30, 1.0, 2.0),
        BoostSettings("regularized_ranker", 0.7, 100, 0.035, 23, 40, 2.0, 1.0),
    )
    early_stopping: bool = True
    validation_fraction: float = 0.1
    rounds_without_gain: int = 12
    calibration_windows: int = 0
    calibration_grid_step: float = 0.1
    calibration_ranking_weight: float = 0.15
    minimum_model_blend_weight: float = 1.0


@dataclass(frozen=True)
class DeploymentSettings:
    teams: int = 8
    minimum_team_metres: float = 400.0
    top_k: tuple[int, ...] = (10, 25, 50)


@dataclass(frozen=True)
class Settings:
    data: DataSettings = field(default_factory=DataSettings)
    grid: GridSettings = field(default_factory=GridSettings)
    temporal: TemporalSettings = field(default_factory=TemporalSettings)
    scoring: ScoringSettings = field(default_factory=ScoringSettings)
    model: ModelSettings = field(default_factory=ModelSettings)
    deployment: DeploymentSettings = field(default_factory=DeploymentSettings)

    def max_zones(self) -> int:
        """Number of grid cells the coordinate box can hold.

        Records outside the box are dropped, so this bounds the zone table whatever the input size;
        it is what allows the zone table to be broadcast.
        """
        lat_lo, lat_hi = self.data.latitude_range
        lon_lo, lon_hi = self.data.longitude_range
        rows = (lat_hi - lat_lo) * METRES_PER_DEGREE_LATITUDE / self.grid.cell_metres
        cols = (lon_hi - lon_lo) * self.grid.metres_per_degree_longitude / self.grid.cell_metres
        return (math.ceil(rows) + 1) * (math.ceil(cols) + 1)
