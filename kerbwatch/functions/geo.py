"""Grid and distance expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbwatch.config import EARTH_RADIUS_METRES, METRES_PER_DEGREE_LATITUDE, GridSettings, Settings


def cell_x(longitude: Column, grid: GridSettings) -> Column:
    metres = (longitude - F.lit(grid.origin_longitude)) * F.lit(grid.metres_per_degree_longitude)
    return F.floor(metres / F.lit(float(grid.cell_metres))).cast("int")


def cell_y(latitude: Column, grid: GridSettings) -> Column:
    metres = (latitude - F.lit(grid.origin_latitude)) * F.lit(METRES_PER_DEGREE_LATITUDE)
    return F.floor(metres / F.lit(float(grid.cell_metres))).cast("int")


def zone_id(x: Column, y: Column) -> Column:
    return F.concat(F.lit("Z"), x.cast("string"), F.lit("_"), y.cast("string"))


def centroid_latitude(y: Column, grid: GridSettings) -> Column:
    offset = (y.cast("double") + 0.5) * F.lit(float(grid.cell_metres))
    return F.lit(grid.origin_latitude) + offset / F.lit(METRES_PER_DEGREE_LATITUDE)


def centroid_longitude(x: Column, grid: GridSettings) -> Column:
    offset = (x.cast("double") + 0.5) * F.lit(float(grid.cell_metres))
    return F.lit(grid.origin_longitude) + offset / F.lit(grid.metres_per_degree_longitude)


def haversine(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    half_lat = F.sin(F.radians(lat_b - lat_a) / 2)
    half_lon = F.sin(F.radians(lon_b - lon_a) / 2)
    chord = half_lat * half_lat + (
        F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * half_lon * half_lon
    )
    return 2 * EARTH_RADIUS_METRES * F.atan2(F.sqrt(chord), F.sqrt(1 - chord))


def cell_reach(settings: Settings, metres: float) -> list[tuple[int, int]]:
    """Cell offsets whose centroids can lie closer than `metres`, the cell itself included.

    The spacing of centroids on the sphere is smallest at the box edge farthest from the equator;
    using that spacing (with half a percent to spare) makes the list complete for the whole box.
    """
    on_sphere = math.radians(1.0) * EARTH_RADIUS_METRES
    edge = max(abs(v) for v in settings.data.latitude_range)
    cell = settings.grid.cell_metres
    dy = cell / METRES_PER_DEGREE_LATITUDE * on_sphere * 0.995
    dx = (
        cell / settings.grid.metres_per_degree_longitude
        * on_sphere * math.cos(math.radians(edge)) * 0.995
    )
    nx, ny = int(metres // dx) + 1, int(metres // dy) + 1
    return [
        (i, j)
        for i in range(-nx, nx + 1)
        for j in range(-ny, ny + 1)
        if math.hypot(i * dx, j * dy) < metres
    ]
