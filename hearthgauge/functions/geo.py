"""Distances, projection and polygons as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .scalars import half_up

# Mean radius of the earth in metres; metres a degree for short distances near Taipei
EARTH_RADIUS, METRES_LAT, METRES_LON = 6371008.8, 111000.0, 101000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2) * F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
    return 2 * EARTH_RADIUS * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def planar(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in metres for thresholds of up to some hundred metres."""
    return F.hypot((lat1 - lat2) * METRES_LAT, (lon1 - lon2) * METRES_LON)


def segment_distance(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in metres from a point to a segment, longitudes scaled at the point's latitude."""
    kx = F.cos(F.radians(lat)) * METRES_LAT
    ax, ay, bx, by = (lon1 - lon) * kx, (lat1 - lat) * METRES_LAT, (lon2 - lon) * kx, (lat2 - lat) * METRES_LAT
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / length2))).otherwise(F.lit(0.0))
    return F.hypot(ax + t * dx, ay + t * dy)


def twd97_to_wgs84(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude (7 places) of TWD97 TM2 zone 121, by the series of the inverse transverse Mercator
    projection in the third flattening to the fourth order; null for what isn't a finite number."""
    a, f, k0, x0, lon0 = 6378137.0, 1 / 298.257222101, 0.9999, 250000.0, 121.0
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    finite = lambda c: F.when((F.abs(c) < 1e12) & ~F.isnan(c), c)
    xi, eta = finite(y) / (k0 * radius), (finite(x) - x0) / (k0 * radius)
    xi1 = xi - sum((b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(beta, 1)), F.lit(0.0))
    eta1 = eta - sum((b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(beta, 1)), F.lit(0.0))
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi + sum((d * F.sin(2 * j * chi) for j, d in enumerate(delta, 1)), F.lit(0.0))
    lon = F.atan2(F.sinh(eta1), F.cos(xi1))
    return half_up(F.degrees(lon) + lon0, 7), half_up(F.degrees(lat), 7)


def wgs84_rings(rings: Column) -> Column:
    """Rings of TWD97 TM2 zone 121 (lon as x, lat as y) in longitude and latitude."""

    def at(p: Column) -> Column:
        lon, lat = twd97_to_wgs84(p["lon"], p["lat"])
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    return F.transform(rings, lambda ring: F.transform(ring, at))


def ring_bounds(rings: Column) -> tuple[Column, Column, Column, Column]:
    """(min lon, min lat, max lon, max lat) of array<ring>, a ring being array<struct<lon, lat>>."""
    points = F.flatten(rings)
    lons, lats = F.transform(points, lambda p: p["lon"]), F.transform(points, lambda p: p["lat"])
    return F.array_min(lons), F.array_min(lats), F.array_max(lons), F.array_max(lats)


def coordinates_valid(rings: Column, west: float, south: float, east: float, north: float) -> Column:
    """Whether every vertex lies in the range."""
    return F.forall(F.flatten(rings), lambda p: p["lon"].between(west, east) & p["lat"].between(south, north))
