"""Geometry on the sphere and in the plane."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_M = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def boxes_meet(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Whether two closed boxes (south, north, west, east) share a point."""
    return (a[0] <= b[1]) & (b[0] <= a[1]) & (a[2] <= b[3]) & (b[2] <= a[3])


def in_polygon(lat: Column, lon: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a polygon of (lat, lon) corners: an odd number of edges to its east."""
    crossed = F.lit(False)
    for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 != y2:
            at = F.lit(x1) + (lat - y1) * F.lit((x2 - x1) / (y2 - y1))
            crossed = crossed != ((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lon < at)
    return crossed


def degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Decimal degrees from degrees, minutes and seconds; S and W are negative."""
    v = d + m / 60.0 + s / 3600.0
    return F.when(ref.isin("S", "W"), -v).otherwise(v)


def valid_point(lat: Column, lon: Column) -> Column:
    return lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
