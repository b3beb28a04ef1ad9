"""Great-circle geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.asin(F.least(F.lit(1.0), F.sqrt(chord))) * (2 * EARTH_RADIUS_M)


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in [0, 360), clockwise from north."""
    from_lat, to_lat = F.radians(lat1), F.radians(lat2)
    d_lon = F.radians(lon2 - lon1)
    east = F.sin(d_lon) * F.cos(to_lat)
    north = F.cos(from_lat) * F.sin(to_lat) - F.sin(from_lat) * F.cos(to_lat) * F.cos(d_lon)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def wrap180(deg: Column) -> Column:
    """Angle difference wrapped into [-180, 180).

    Every step rounds as in the SQL: sums of turns meet thresholds such as half a
    circle to the last bit, and ``pmod`` adds the circle to negative remainders only.
    """
    return ((deg + 180.0) % 360.0 + 360.0) % 360.0 - 180.0


def signed_turn(bearing_in: Column, bearing_out: Column) -> Column:
    """Turn between two bearings, positive clockwise."""
    return wrap180(bearing_out - bearing_in)
