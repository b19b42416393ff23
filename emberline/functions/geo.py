"""Projections, distances and grids as column expressions (Snyder 1987 for the UTM series)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 and UTM.
SEMI_MAJOR_M = 6378137.0
ECCENTRICITY_SQUARED = 0.0066943799901413165
SCALE = 0.9996
FALSE_EASTING_M = 500000.0
EARTH_RADIUS_KM = 6371.0088

_E2 = ECCENTRICITY_SQUARED
_EP2 = _E2 / (1 - _E2)


def central_meridian(zone: int) -> float:
    return zone * 6.0 - 183.0


def utm_forward(longitude: Column, latitude: Column, zone: int = 17) -> tuple[Column, Column]:
    """Easting and northing (northern hemisphere) of degrees."""
    phi = F.radians(latitude)
    s, c, t = F.sin(phi), F.cos(phi), F.pow(F.tan(phi), F.lit(2.0))
    n = SEMI_MAJOR_M / F.sqrt(1 - _E2 * s * s)
    eta = _EP2 * c * c
    a = c * (F.radians(longitude) - math.radians(central_meridian(zone)))
    a2 = a * a
    arc = SEMI_MAJOR_M * (
        (1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256) * phi
        - (3 * _E2 / 8 + 3 * _E2**2 / 32 + 45 * _E2**3 / 1024) * F.sin(2 * phi)
        + (15 * _E2**2 / 256 + 45 * _E2**3 / 1024) * F.sin(4 * phi)
        - (35 * _E2**3 / 3072) * F.sin(6 * phi)
    )
    x3 = (1 - t + eta) / 6
    x5 = (5 - 18 * t + t * t + 72 * eta - 58 * _EP2) / 120
    y4 = (5 - t + 9 * eta + 4 * eta * eta) / 24
    y6 = (61 - 58 * t + t * t + 600 * eta - 330 * _EP2) / 720
    easting = FALSE_EASTING_M + SCALE * n * a * (1 + a2 * (x3 + a2 * x5))
    northing = SCALE * (arc + n * F.tan(phi) * a2 * (0.5 + a2 * (y4 + a2 * y6)))
    return easting, northing


def utm_inverse(easting: Column, northing: Column, zone: int = 17) -> tuple[Column, Column]:
    """Longitude and latitude of a northern UTM point."""
    e1 = (1 - math.sqrt(1 - _E2)) / (1 + math.sqrt(1 - _E2))
    mu = northing / SCALE / (SEMI_MAJOR_M * (1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256))
    foot = (
        mu
        + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu)
        + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu)
        + (151 * e1**3 / 96) * F.sin(6 * mu)
        + (1097 * e1**4 / 512) * F.sin(8 * mu)
    )
    s, c, tan = F.sin(foot), F.cos(foot), F.tan(foot)
    eta, t = _EP2 * c * c, tan * tan
    w = 1 - _E2 * s * s
    n, r = SEMI_MAJOR_M / F.sqrt(w), SEMI_MAJOR_M * (1 - _E2) / F.pow(w, F.lit(1.5))
    d = (easting - FALSE_EASTING_M) / (n * SCALE)
    d2 = d * d
    latitude = foot - n * tan / r * d2 * (
        0.5 - d2 * (5 + 3 * t + 10 * eta - 4 * eta * eta - 9 * _EP2) / 24 + d2 * d2 * (61 + 90 * t + 298 * eta + 45 * t * t - 252 * _EP2 - 3 * eta * eta) / 720
    )
    longitude = d * (1 - d2 * (1 + 2 * t + eta) / 6 + d2 * d2 * (5 - 2 * eta + 28 * t - 3 * eta * eta + 8 * _EP2 + 24 * t * t) / 120) / c
    return F.degrees(longitude) + central_meridian(zone), F.degrees(latitude)


def mercator_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a Web Mercator point."""
    return F.degrees(x / SEMI_MAJOR_M), F.degrees(2 * F.atan(F.exp(y / SEMI_MAJOR_M)) - math.pi / 2)


def to_degrees(epsg: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Degrees of a point in EPSG 4326, 3857, 32617 or 32618; null for any other."""
    forms = {4326: (x, y), 3857: mercator_inverse(x, y), 32617: utm_inverse(x, y, 17), 32618: utm_inverse(x, y, 18)}
    pick = lambda i: F.coalesce(*[F.when(epsg == code, form[i]) for code, form in forms.items()])
    return pick(0), pick(1)


def planar_m(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x1 - x2, y1 - y2)


def projected_distance_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, zone: int = 17) -> Column:
    return planar_m(*utm_forward(lon1, lat1, zone), *utm_forward(lon2, lat2, zone))


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def equirectangular_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, metres_per_degree: float = 111320.0) -> Column:
    """Flat distance with the longitude scaled at the first point's latitude."""
    return F.hypot((lon2 - lon1) * metres_per_degree * F.cos(F.radians(lat1)), (lat2 - lat1) * metres_per_degree)


def pixel_centre(origin: Column | float, size: float, index: Column) -> Column:
    return F.lit(origin) + (index + 0.5) * size if not isinstance(origin, Column) else origin + (index + 0.5) * size


def snap_down(value: Column, origin: float, size: float) -> Column:
    return F.floor((value - origin) / size) * size + origin


def snap_up(value: Column, origin: float, size: float) -> Column:
    return F.ceil((value - origin) / size) * size + origin


def slippy_tile(longitude: Column, latitude: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of the web map tile that holds a point."""
    n = 2**zoom
    phi = F.radians(latitude)
    x = F.floor((longitude + 180) / 360 * n)
    y = F.floor((1 - F.ln(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * n)
    inside = lambda v: F.least(F.greatest(v, F.lit(0)), F.lit(n - 1)).cast("int")
    return inside(x), inside(y)
