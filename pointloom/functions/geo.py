"""Geometry on the sphere and in the plane as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth radii of the distance variants, in the unit of the result.
EARTH_M = 6_371_008.8
EARTH_KM = 6371.0088
METRES_PER_DEGREE = 111_320.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle distance in the unit of ``radius``."""
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(half)))


def decimals(x: Column, places: int) -> Column:
    """``x`` with so many decimals, rounded as C and Python print it: by its exact binary value, ties to even.

    ``format_string`` rounds the shortest decimal form instead, half up: 8.0005, which
    lies below that in binary, would print as 8.001.
    """
    return F.call_function("format_number", x.cast("double"), F.lit("0." + "0" * places))


def coord5(x: Column) -> Column:
    """Five decimals; a negative zero loses its sign."""
    text = decimals(x, 5)
    return F.when(text == "-0.00000", "0.00000").otherwise(text)


def cell(x: Column, size: float) -> Column:
    """Grid cell of a coordinate."""
    return F.floor(x / size).cast("long")


def region_cell(lat: Column, lon: Column, size: int = 5) -> Column:
    """South-west corner of a region cell as ``+20_+070``."""
    corner = lambda x: (F.floor(x / size) * size).cast("int")
    return F.format_string("%+03d_%+04d", corner(lat), corner(lon))


def context_tile(lat: Column, lon: Column, degrees: float = 0.25) -> Column:
    """Tile id ``+0080_+0280`` of a point."""
    return F.format_string("%+05d_%+05d", cell(lat, degrees), cell(lon, degrees))


def tiles_around(lat: Column, lon: Column, radius_m: float, degrees: float = 0.25) -> Column:
    """Sorted distinct tiles of a 3 x 3 pattern of points at ``radius_m``."""
    dlat = F.lit(radius_m / METRES_PER_DEGREE)
    dlon = radius_m / (METRES_PER_DEGREE * F.greatest(F.cos(F.radians(lat)), F.lit(1e-6)))
    points = [context_tile(lat + a * dlat, lon + b * dlon, degrees) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    return F.array_sort(F.array_distinct(F.array(*points)))


def land_tile(lat: Column, lon: Column, degrees: int = 3) -> Column:
    """Land-cover tile ``N21E078``."""
    south, west = F.floor(lat / degrees) * degrees, F.floor(lon / degrees) * degrees
    return F.concat(
        F.when(south < 0, "S").otherwise("N"),
        F.format_string("%02d", F.abs(south).cast("int")),
        F.when(west < 0, "W").otherwise("E"),
        F.format_string("%03d", F.abs(west).cast("int")),
    )


def diagonal_m(lat_min: Column, lat_max: Column, lon_min: Column, lon_max: Column) -> Column:
    """Diagonal of a bounding box in metres (X38); not the distance to a centroid."""
    middle = F.radians((lat_min + lat_max) / 2)
    return F.hypot(
        (lat_max - lat_min) * METRES_PER_DEGREE, (lon_max - lon_min) * METRES_PER_DEGREE * F.cos(middle)
    )


def offset(lat: Column, lon: Column, north_m: float, east_m: float) -> tuple[Column, Column]:
    """A point moved by metres."""
    per = math.pi * EARTH_M / 180
    return lat + north_m / per, lon + east_m / (per * F.cos(F.radians(lat)))


def planar(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Metres east and north of an origin, equirectangular."""
    per = math.pi * EARTH_M / 180
    return (lon - lon0) * per * F.cos(F.radians(lat0)), (lat - lat0) * per


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment in the plane."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.nullif(length, F.lit(0.0))))
    )
    return F.hypot(px - ax - t * dx, py - ay - t * dy)


def polygon_relation(lat: Column, lon: Column, ring: Column) -> Column:
    """Struct (inside, boundary_m) of a point and a ring of (lat, lon) structs.

    The ring need not repeat its first vertex.  A point within 1e-6 m of the
    boundary counts as inside.
    """
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    edges = F.zip_with(
        ring,
        following,
        lambda a, b: F.struct(
            *[
                value.alias(name)
                for (point, names) in ((a, ("ax", "ay")), (b, ("bx", "by")))
                for value, name in zip(planar(point["lat"], point["lon"], lat, lon), names, strict=True)
            ]
        ),
    )
    zero = F.lit(0.0)
    crossed = F.filter(
        edges,
        lambda e: ((e["ay"] > zero) != (e["by"] > zero))
        & (zero < (e["bx"] - e["ax"]) * (zero - e["ay"]) / F.nullif(e["by"] - e["ay"], zero) + e["ax"]),
    )
    boundary = F.array_min(
        F.transform(edges, lambda e: segment_distance(zero, zero, e["ax"], e["ay"], e["bx"], e["by"]))
    )
    return F.struct(
        ((F.size(crossed) % 2 == 1) | (boundary <= 1e-6)).alias("inside"), boundary.alias("boundary_m")
    )


def ring_problem(ring: Column) -> Column:
    """Why a ring of (lat, lon) structs is unusable, or null."""
    distinct = F.array_distinct(ring)
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    area = F.aggregate(
        F.zip_with(ring, following, lambda a, b: a["lon"] * b["lat"] - b["lon"] * a["lat"]),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    return (
        F.when(ring.isNull(), "POLYGON_MISSING")
        .when(F.size(distinct) < 3, "POLYGON_TOO_FEW_VERTICES")
        .when(F.abs(area) < 1e-14, "POLYGON_ZERO_AREA")
    )
