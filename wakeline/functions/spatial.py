"""Distances, envelopes, grid cells and geometry text, as Column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radius (m) and metres per nautical mile.
EARTH_RADIUS_M = 6_371_000.0
METRES_PER_NM = 1_852.0

# Edge of a grid cell in degrees: about 500 km at the equator.
CELL_DEG = 5.0
# Metadata key of the cell_x column of stored positions.
CELL_SIZE = "cell_deg"


def haversine_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(EARTH_RADIUS_M) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)) / METRES_PER_NM


@dataclass(frozen=True)
class Envelope:
    """A lon/lat box. Bounds are kept to six decimals."""

    min_lon: float
    min_lat: float
    max_lon: float
    max_lat: float

    def __post_init__(self) -> None:
        for name in ("min_lon", "min_lat", "max_lon", "max_lat"):
            object.__setattr__(self, name, float(f"{getattr(self, name):f}"))

    @classmethod
    def of(cls, min_lon=None, min_lat=None, max_lon=None, max_lat=None) -> Envelope | None:
        """All four bounds or no box at all."""
        bounds = (min_lon, min_lat, max_lon, max_lat)
        return None if any(b is None for b in bounds) else cls(*bounds)

    def contains_point(self, lon: Column, lat: Column) -> Column:
        """Strictly inside: a point on the border is not *within* the box."""
        return (lon > self.min_lon) & (lon < self.max_lon) & (lat > self.min_lat) & (lat < self.max_lat)

    def overlaps(self, min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
        """Another box touches or overlaps this one: the cheap test before the exact one."""
        return (
            (min_lon <= self.max_lon)
            & (max_lon >= self.min_lon)
            & (min_lat <= self.max_lat)
            & (max_lat >= self.min_lat)
        )

    def covers_cells(self, cell_x: Column, cell_y: Column, cell_deg: float = CELL_DEG) -> Column:
        """Grid cells that can hold a point of the box; bounds are literals, so partitions are pruned."""
        return cell_x.between(cell_index(self.min_lon, 180, cell_deg), cell_index(self.max_lon, 180, cell_deg)) & (
            cell_y.between(cell_index(self.min_lat, 90, cell_deg), cell_index(self.max_lat, 90, cell_deg))
        )

    def touches_path(self, path: Column) -> Column:
        """The line through ``path`` shares at least one point with the closed box."""
        tails = F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0)))
        heads = F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))
        legs = F.zip_with(heads, tails, lambda p, q: self._touches_leg(p["lon"], p["lat"], q["lon"], q["lat"]))
        return F.exists(legs, lambda hit: hit)

    def _touches_leg(self, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        """Separating-axis test of a segment against the box: x axis, y axis, normal of the segment."""
        by_axes = (
            (F.least(x0, x1) <= self.max_lon)
            & (F.greatest(x0, x1) >= self.min_lon)
            & (F.least(y0, y1) <= self.max_lat)
            & (F.greatest(y0, y1) >= self.min_lat)
        )

        # The segment's line separates the box only if all four corners lie strictly on one side.
        def side(x: float, y: float) -> Column:
            return (x1 - x0) * (F.lit(y) - y0) - (y1 - y0) * (F.lit(x) - x0)

        corners = [
            side(self.min_lon, self.min_lat),
            side(self.min_lon, self.max_lat),
            side(self.max_lon, self.min_lat),
            side(self.max_lon, self.max_lat),
        ]
        return by_axes & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)


def cell_index(degrees: float, offset: int, cell_deg: float = CELL_DEG) -> int:
    return math.floor((degrees + offset) / cell_deg)


def cell_x(lon: Column, cell_deg: float = CELL_DEG) -> Column:
    return F.floor((lon + 180) / cell_deg).cast("int")


def cell_y(lat: Column, cell_deg: float = CELL_DEG) -> Column:
    return F.floor((lat + 90) / cell_deg).cast("int")


def point_wkt(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit("POINT ("), _number(lon), F.lit(" "), _number(lat), F.lit(")"))


def _number(value: Column) -> Column:
    """A coordinate in plain decimal notation with all its digits, without trailing zeros."""
    fixed = value.cast("decimal(38,30)").cast("string")
    return F.regexp_replace(F.regexp_replace(fixed, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def line_geojson(path: Column) -> Column:
    """GeoJSON geometry struct of a path; turn it to text with ``to_json``."""
    return F.struct(
        F.lit("LineString").alias("type"),
        F.transform(path, lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"),
    )
