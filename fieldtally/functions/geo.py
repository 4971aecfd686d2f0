"""Distances, UTM projection and a 3-D cell grid, all as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldtally.functions.text import col, half_up

EARTH_RADIUS_M = 6371000.0

# WGS84 ellipsoid and the UTM scale factor.
_SEMI_MAJOR = 6378137.0
_FLATTENING = 1 / 298.257223563
_SCALE = 0.9996
_ECC2 = _FLATTENING * (2 - _FLATTENING)
_ECC2_PRIME = _ECC2 / (1 - _ECC2)


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    phi1, phi2 = F.radians(col(lat1)), F.radians(col(lat2))
    dphi = F.radians(col(lat2) - col(lat1))
    dlambda = F.radians(col(lon2) - col(lon1))
    chord = F.pow(F.sin(dphi / 2), 2) + F.cos(phi1) * F.cos(phi2) * F.pow(F.sin(dlambda / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(chord))


def rounded_m(lat1, lon1, lat2, lon2) -> Column:
    """Haversine distance rounded half up to whole metres."""
    return half_up(haversine_m(lat1, lon1, lat2, lon2)).cast("bigint")


def path_length_m(points: Column, lat: str = "lat", lon: str = "lon") -> Column:
    """Rounded length of an ordered array of points; 0 for a single point, null for null."""
    n = F.size(points)
    # Zipping the path with itself shifted by one gives the segments without a fold per row.
    segments = F.arrays_zip(
        F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("a"),
        F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("b"),
    )
    total = F.aggregate(
        segments,
        F.lit(0.0),
        lambda acc, s: acc + haversine_m(s["a"][lat], s["a"][lon], s["b"][lat], s["b"][lon]),
    )
    return F.when(points.isNotNull(), half_up(total).cast("bigint"))


def utm_zone(longitude) -> Column:
    return (F.floor((col(longitude) + 180) / 6) + 1).cast("int")


def _meridian_rad(zone: Column) -> Column:
    return F.radians(zone * 6 - 183)


def _series(phi: Column, terms: list[tuple[float, int]]) -> Column:
    """Sum of coefficient * sin(multiple * phi)."""
    out = F.lit(0.0)
    for coefficient, multiple in terms:
        out = out + F.lit(coefficient) * F.sin(phi * multiple)
    return out


def _poly(x: Column, coefficients: list[Column]) -> Column:
    """x * (c0 + x2 * (c1 + x2 * c2 ...)) in x squared, odd powers."""
    square = x * x
    inner = coefficients[-1]
    for c in reversed(coefficients[:-1]):
        inner = c + square * inner
    return inner


def to_utm(latitude, longitude, zone=None) -> Column:
    """WGS84 to UTM as struct(east, north, zone, hemisphere), rounded to centimetres."""
    lat, lon = col(latitude), col(longitude)
    z = utm_zone(lon) if zone is None else col(zone)
    phi = F.radians(lat)
    e2, ep2 = _ECC2, _ECC2_PRIME
    nu = F.lit(_SEMI_MAJOR) / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    t = F.pow(F.tan(phi), 2)
    c = ep2 * F.pow(F.cos(phi), 2)
    a = F.cos(phi) * (F.radians(lon) - _meridian_rad(z))
    arc = F.lit(_SEMI_MAJOR) * (
        phi * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256)
        + _series(
            phi,
            [
                (-(3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024), 2),
                (15 * e2**2 / 256 + 45 * e2**3 / 1024, 4),
                (-35 * e2**3 / 3072, 6),
            ],
        )
    )
    east = _SCALE * nu * a * _poly(
        a, [F.lit(1.0), (1 - t + c) / 6, (5 - 18 * t + t * t + 72 * c - 58 * ep2) / 120]
    )
    north = _SCALE * (
        arc
        + nu * F.tan(phi) * a * a * _poly(
            a,
            [
                F.lit(0.5),
                (5 - t + 9 * c + 4 * c * c) / 24,
                (61 - 58 * t + t * t + 600 * c - 330 * ep2) / 720,
            ],
        )
    )
    south = lat < 0
    return F.struct(
        half_up(east + 500000, 2).alias("east"),
        half_up(north + F.when(south, F.lit(10000000.0)).otherwise(F.lit(0.0)), 2).alias("north"),
        z.cast("int").alias("zone"),
        F.when(south, F.lit("S")).otherwise(F.lit("N")).alias("hemisphere"),
    )


def from_utm(east, north, zone, hemisphere) -> Column:
    """UTM to WGS84 as struct(lat, lon), not rounded."""
    e2, ep2 = _ECC2, _ECC2_PRIME
    x = col(east) - 500000
    y = F.when(col(hemisphere) == "S", col(north) - 10000000).otherwise(col(north))
    mu = y / _SCALE / (_SEMI_MAJOR * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    foot = mu + _series(
        mu,
        [
            (3 * e1 / 2 - 27 * e1**3 / 32, 2),
            (21 * e1**2 / 16 - 55 * e1**4 / 32, 4),
            (151 * e1**3 / 96, 6),
            (1097 * e1**4 / 512, 8),
        ],
    )
    w = 1 - e2 * F.pow(F.sin(foot), 2)
    nu = F.lit(_SEMI_MAJOR) / F.sqrt(w)
    rho = F.lit(_SEMI_MAJOR * (1 - e2)) / F.pow(w, 1.5)
    t = F.pow(F.tan(foot), 2)
    c = ep2 * F.pow(F.cos(foot), 2)
    d = x / (nu * _SCALE)
    lat = foot - nu * F.tan(foot) / rho * d * d * _poly(
        d,
        [
            F.lit(0.5),
            -(5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) / 24,
            (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) / 720,
        ],
    )
    lon = _meridian_rad(col(zone)) + d * _poly(
        d,
        [
            F.lit(1.0),
            -(1 + 2 * t + c) / 6,
            (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) / 120,
        ],
    ) / F.cos(foot)
    return F.struct(F.degrees(lat).alias("lat"), F.degrees(lon).alias("lon"))


def ensure_latlon(df, zone, hemisphere):
    """Fill ``lat``/``lon`` from UTM only where either is missing and both UTM values exist."""
    zone_col = zone if isinstance(zone, Column) else F.lit(zone)
    hemi_col = hemisphere if isinstance(hemisphere, Column) else F.lit(hemisphere)
    fill = (
        (F.col("lat").isNull() | F.col("lon").isNull())
        & F.col("utm_east").isNotNull()
        & F.col("utm_north").isNotNull()
    )
    point = from_utm("utm_east", "utm_north", zone_col, hemi_col)
    return df.withColumns(
        {
            "lat": F.when(fill, point["lat"]).otherwise(F.col("lat")),
            "lon": F.when(fill, point["lon"]).otherwise(F.col("lon")),
        }
    )


def cell_xyz(latitude, longitude, size_m: float) -> list[Column]:
    """Integer cell of the point on a 3-D grid: no seam at the antimeridian, no pole distortion.

    Two points closer than ``size_m`` always lie in the same or in touching cells.
    """
    phi, lam = F.radians(col(latitude)), F.radians(col(longitude))
    xyz = (F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi))
    return [F.floor(v * EARTH_RADIUS_M / size_m).cast("bigint") for v in xyz]


def with_cell(df, latitude: str, longitude: str, size_m: float):
    """Adds the cell of a point as plain columns cx, cy, cz (cheap join keys)."""
    x, y, z = cell_xyz(latitude, longitude, size_m)
    return df.withColumns({"cx": x, "cy": y, "cz": z})


def neighbour_offsets() -> Column:
    """The 27 steps to a cell and its neighbours, a constant array."""
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    return F.array(
        *[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i, j, k in steps]
    )


def spread_to_neighbours(df, latitude: str, longitude: str, size_m: float, where: Column | None = None):
    """One row per cell around the point; rows outside ``where`` stay as one row without a cell.

    The trigonometry is done once per point, before the rows multiply.
    """
    offsets = neighbour_offsets() if where is None else F.when(where, neighbour_offsets())
    probed = with_cell(df, latitude, longitude, size_m).withColumn("_step", F.explode_outer(offsets))
    return probed.withColumns(
        {c: F.col(c) + F.col("_step")[s] for c, s in (("cx", "i"), ("cy", "j"), ("cz", "k"))}
    ).drop("_step")
