"""Geodesy on a sphere, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_M = 6_371_000.0


def wrap_longitude(degrees: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(degrees + 180.0, F.lit(360.0)) - 180.0


def normalize_degrees(degrees: Column) -> Column:
    """Into [0, 360)."""
    return F.pmod(degrees, F.lit(360.0))


def project(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """East and north metres from an origin, equirectangular."""
    per_degree = RADIUS_M * math.pi / 180
    return wrap_longitude(lon - lon0) * per_degree * F.cos(F.radians(lat0)), (lat - lat0) * per_degree


def unproject(east: Column, north: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    per_degree = RADIUS_M * math.pi / 180
    return lat0 + north / per_degree, wrap_longitude(lon0 + east / (F.cos(F.radians(lat0)) * per_degree))


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres by the haversine formula."""
    a = F.sin(F.radians(lat2 - lat1) / 2)
    b = F.sin(F.radians(lon2 - lon1) / 2)
    h = a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b
    return 2 * RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def valid_coordinate(lat: Column, lon: Column) -> Column:
    ok = (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0))
    return F.coalesce(ok & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


def midpoint(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> tuple[Column, Column]:
    """Half way, across the date line where that is shorter."""
    return (lat1 + lat2) / 2, wrap_longitude(lon1 + wrap_longitude(lon2 - lon1) / 2)
