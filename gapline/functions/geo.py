"""Geography as columns: valid positions, great-circle distance, map tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def valid(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def tile(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Fractional web-mercator tile of a position."""
    n = float(2**zoom)
    x = (lon + 180.0) / 360.0 * n
    t = F.tan(F.radians(lat))
    y = (1.0 - F.ln(t + F.sqrt(t * t + 1.0)) / math.pi) / 2.0 * n
    return x, y


def tile_origin(x: Column, y: Column, zoom: int) -> tuple[Column, Column]:
    """(longitude, latitude) of a tile's corner."""
    n = float(2**zoom)
    return x / n * 360.0 - 180.0, F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * y / n))))
