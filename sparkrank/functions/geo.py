"""Distances on a sphere, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: mean radius of the earth in metres.
RADIUS = 6_371_008.8


def _column(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def haversine(lat: Column, lon: Column, lat0: Column | float, lon0: Column | float) -> Column:
    """Great-circle metres."""
    lat0, lon0 = _column(lat0), _column(lon0)
    a = F.pow(F.sin(F.radians(lat - lat0) / 2), 2) + F.cos(F.radians(lat0)) * F.cos(F.radians(lat)) * F.pow(F.sin(F.radians(lon - lon0) / 2), 2)
    # least() would pass over a null
    return 2 * RADIUS * F.asin(F.when(a < 1, F.sqrt(a)).when(a >= 1, F.lit(1.0)))


def manhattan(lat: Column, lon: Column, lat0: Column | float, lon0: Column | float) -> Column:
    """Metres along the meridian and then along the origin's parallel."""
    lat0, lon0 = _column(lat0), _column(lon0)
    return RADIUS * (F.abs(F.radians(lat - lat0)) + F.abs(F.radians(lon - lon0)) * F.cos(F.radians(lat0)))
