"""Distances and grid coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6373.0  # fixed value: distances must come out on this sphere


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres between points given in degrees."""
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    chord = (F.pow(F.sin(half_dlat), F.lit(2))
             + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_dlon), F.lit(2)))
    chord = F.least(chord, F.lit(1.0))
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(chord), F.sqrt(F.lit(1.0) - chord))


def grid_longitude(longitude: Column) -> Column:
    """-180..180 to the 0..360 range of the grid."""
    return F.pmod(longitude, F.lit(360.0))
