"""Distance joins that hold under skew: pairs of cells are refined before points meet.

Both sides are reduced to distinct places and counted in a quadtree over grid
cells of the radius.  Pairs of cells start as neighbours on the grid and are held by
the boxes of their points: those further apart than the radius go, and where only
the nearest place counts, those further from a cell than another one is at most.
Pairs whose cells still hold many places are divided on both sides, level by level;
only the rest meets point by point, so a hot spot costs what its surroundings do
and no key holds many rows of either side.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions.geo import EARTH_KM, haversine
from pointloom.plans.joins import broadcast_if_small
from pointloom.plans.scratch import written

KM_PER_DEGREE = math.pi * EARTH_KM / 180
LEVELS = 12
#: Places of a cell that meet those of another, at most, unless the last level is reached.
MOST_LEFT, MOST_RIGHT = 512, 8
#: Keys of one place in an array, about; a place with more has several.
MOST_KEYS = 256
#: The largest radius for which boxes are measured in the plane, with a margin of a thousandth.
MOST_KM = 50.0


@dataclass(frozen=True)
class Grid:
    radius_km: float

    def __post_init__(self):
        if not 0 < self.radius_km <= MOST_KM:
            raise ValueError(f"the radius must be positive and at most {MOST_KM} km")

    @property
    def size(self) -> float:
        return self.radius_km / KM_PER_DEGREE * 1.001

    def width(self, row: Column) -> Column:
        """Degrees of longitude of a row's cells: the radius at the row's edge that is farther from the equator, and beyond."""
        far = F.least(F.lit(89.9), F.abs((row + F.when(row >= 0, 2).otherwise(-1)) * self.size))
        return self.size / F.cos(F.radians(far))

    def placed(self, places: DataFrame) -> DataFrame:
        """Places (lat, lon) with their cell (y, x) and where they are in it, in steps of the last level."""
        steps = 1 << LEVELS
        y = F.floor(F.col("lat") / self.size).cast("long")
        rows = places.withColumn("y", y).withColumn("_w", F.col("lon") / self.width(F.col("y")))
        rows = rows.withColumn("x", F.floor("_w").cast("long"))
        inner = lambda v: F.least(F.lit(steps - 1), F.floor(v * steps)).cast("long")
        return rows.withColumns({"v": inner(F.col("lat") / self.size - F.col("y")), "u": inner(F.col("_w") - F.col("x"))}).drop("_w")


def _cell(level: int) -> list[Column]:
    shift = LEVELS - level
    return [F.col("y"), F.col("x"), F.shiftright("v", shift).alias("v"), F.shiftright("u", shift).alias("u")]


def _cells(placed: DataFrame, level: int, side: str) -> DataFrame:
    """(y, x, v, u of a level; box and number of places), named by side."""
    corner = [f("lat").alias(f"{k}a") for k, f in (("s", F.min), ("n", F.max))] + [f("lon").alias(f"{k}o") for k, f in (("s", F.min), ("n", F.max))]
    cells = placed.groupBy(*_cell(level)).agg(F.struct(*corner).alias("box"), F.count("*").alias("n"))
    return cells.select(F.struct("y", "x", "v", "u").alias(side), F.col("box").alias(f"{side}_box"), F.col("n").alias(f"{side}_n"))


def _bounds() -> tuple[Column, Column]:
    """The least and the greatest distance in km of two places in the boxes."""
    p, q = "l_box", "r_box"
    apart = lambda k: F.greatest(F.lit(0.0), F.col(f"{q}.s{k}") - F.col(f"{p}.n{k}"), F.col(f"{p}.s{k}") - F.col(f"{q}.n{k}"))
    across = lambda k: F.greatest(F.col(f"{q}.n{k}") - F.col(f"{p}.s{k}"), F.col(f"{p}.n{k}") - F.col(f"{q}.s{k}"))
    edges = [F.abs(F.col(f"{b}.{e}a")) for b in (p, q) for e in "sn"]
    crosses = F.least(F.col(f"{p}.sa"), F.col(f"{q}.sa")) * F.greatest(F.col(f"{p}.na"), F.col(f"{q}.na")) <= 0
    high, low = F.greatest(*edges), F.when(crosses, 0.0).otherwise(F.least(*edges))
    cos = lambda v: F.cos(F.radians(F.least(F.lit(90.0), v)))
    least = F.hypot(apart("a"), apart("o") * cos(high)) * KM_PER_DEGREE * 0.999 - 1e-9
    most = F.hypot(across("a"), across("o") * cos(low)) * KM_PER_DEGREE * 1.001 + 1e-9
    return least, most


def _kept(pairs: DataFrame, radius_km: float, nearest: bool) -> DataFrame:
    least, most = _bounds()
    held = pairs.withColumns({"_lo": least, "_hi": most}).where(F.col("_lo") <= radius_km)
    if nearest:
        best = held.groupBy("l").agg(F.min("_hi").alias("_best"))
        held = held.join(best, "l").where(F.col("_lo") <= F.col("_best")).drop("_best")
    return held


def cell_pairs(left: DataFrame, right: DataFrame, grid: Grid, nearest: bool) -> list[tuple[int, DataFrame]]:
    """(level, pairs of cells l and r) that points must meet in; both sides are placed and written."""
    a, b = _cells(left, 0, "l"), _cells(right, 0, "r")
    # a right cell stands for itself and the rows beside it, with the columns that its longitudes have there
    rows = a.select("*", F.explode(F.sequence(F.col("l.y") - 1, F.col("l.y") + 1)).alias("y"))
    width = grid.width(F.col("y"))
    span = F.sequence(F.floor(F.col("l_box.so") / width).cast("long") - 1, F.floor(F.col("l_box.no") / width).cast("long") + 1)
    near = rows.withColumn("x", F.explode(span))
    there = (near["y"] == b["r.y"]) & (near["x"] == b["r.x"])
    open_ = near.join(b, there).drop("y", "x")
    out = []
    for level in range(LEVELS + 1):
        held = written(_kept(open_, grid.radius_km, nearest), "pairs")
        small = (F.col("l_n") <= MOST_LEFT) & (F.col("r_n") <= MOST_RIGHT) if level < LEVELS else F.lit(True)
        out.append((level, held.where(small).select("l", "r")))
        rest = held.where(~small).select("l", "r")
        if rest.isEmpty():
            break
        up = lambda side: F.struct(
            F.col(f"{side}.y").alias("y"), F.col(f"{side}.x").alias("x"), F.shiftright(f"{side}.v", 1).alias("v"), F.shiftright(f"{side}.u", 1).alias("u")
        )
        below = [_cells(placed, level + 1, side).withColumn(f"{side}_up", up(side)) for placed, side in ((left, "l"), (right, "r"))]
        rest = rest.select(F.col("l").alias("l_up"), F.col("r").alias("r_up"))
        open_ = rest.join(below[0], "l_up").join(below[1], "r_up").drop("l_up", "r_up")
    return out


def _places(rows: DataFrame, xy: tuple[str, str], grid: Grid, *extra: Column) -> DataFrame:
    known = rows.where(F.col(xy[0]).isNotNull() & F.col(xy[1]).isNotNull())
    distinct = known.groupBy(F.col(xy[0]).cast("double").alias("lat"), F.col(xy[1]).cast("double").alias("lon")).agg(F.count("*").alias("_rows"), *extra)
    return written(grid.placed(distinct), "places")


def place_pairs(left: DataFrame, right: DataFrame, grid: Grid, nearest: bool) -> DataFrame:
    """(lat, lon, r_lat, r_lon, distance_km, right's other columns) of placed sides within the radius.

    With ``nearest`` only pairs that can be the nearest of a left place are certain to be there.
    """
    found = None
    others = [c for c in right.columns if c not in ("lat", "lon", "y", "x", "v", "u", "_rows")]
    for level, pairs in cell_pairs(left, right, grid, nearest):
        p = left.select("lat", "lon", F.struct(*_cell(level)).alias("l"))
        q = right.select(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), *others, F.struct(*_cell(level)).alias("r"))
        met = pairs.join(p, "l").join(q, "r").drop("l", "r")
        found = met if found is None else found.unionByName(met)
    distance = haversine(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"), EARTH_KM)
    return found.withColumn("distance_km", distance).where(F.col("distance_km") <= grid.radius_km)


def _back(rows: DataFrame, by_place: DataFrame, xy: tuple[str, str]) -> DataFrame:
    named = by_place.withColumnsRenamed({"lat": "_lat", "lon": "_lon"})
    same = (F.col(xy[0]).cast("double") == F.col("_lat")) & (F.col(xy[1]).cast("double") == F.col("_lon"))
    return rows.join(named, same).drop("_lat", "_lon")


def nearest_within(
    left: DataFrame, right: DataFrame, radius_km: float, right_key: str, left_xy=("lat", "lon"), right_xy=("lat", "lon")
) -> DataFrame:
    """Left rows that have a right row within the radius, with the key and distance of the nearest.

    Distances are compared to nine places, a micrometre; ties go to the smaller key.
    """
    grid = Grid(radius_km)
    p = _places(left, left_xy, grid)
    q = _places(right, right_xy, grid, F.min(right_key).alias("_key"))
    best = place_pairs(p, q, grid, True).groupBy("lat", "lon").agg(
        F.min(F.struct(F.round("distance_km", 9).alias("d"), "_key")).alias("_b")
    )
    best = best.select("lat", "lon", F.col("_b._key").alias(right_key), F.col("_b.d").alias("distance_km"))
    return _back(left, best, left_xy)


def least_distance(left: DataFrame, right: DataFrame, radius_km: float, left_xy=("lat", "lon"), right_xy=("lat", "lon")) -> DataFrame:
    """Left rows that have a right row within the radius, with the least distance."""
    grid = Grid(radius_km)
    p, q = _places(left, left_xy, grid), _places(right, right_xy, grid)
    best = place_pairs(p, q, grid, True).groupBy("lat", "lon").agg(F.min("distance_km").alias("distance_km"))
    return _back(left, best, left_xy)


def _chunks(rows: DataFrame, placed: DataFrame, key: str, xy: tuple[str, str]) -> DataFrame:
    """The places (lat, lon, y, x, v, u) with their keys in arrays (keys, chunk) of about ``MOST_KEYS`` at most."""
    at = rows.select(F.col(key).alias("_k"), F.col(xy[0]).cast("double").alias("_lat"), F.col(xy[1]).cast("double").alias("_lon"))
    many = placed.where(F.col("_rows") > MOST_KEYS).select("lat", "lon", F.ceil(F.col("_rows") / MOST_KEYS).alias("_parts"))
    same = (F.col("_lat") == F.col("lat")) & (F.col("_lon") == F.col("lon"))
    part = F.coalesce(F.pmod(F.xxhash64("_k"), F.col("_parts")), F.lit(0))
    dealt = at.join(broadcast_if_small(many), same, "left").select("_k", "_lat", "_lon", part.alias("chunk"))
    held = dealt.groupBy("_lat", "_lon", "chunk").agg(F.collect_list("_k").alias("keys"))
    return written(placed.drop("_rows").join(held, same).drop("_lat", "_lon"), "chunks")


def pairs_within(rows: DataFrame, key: str, radius_km: float, xy=("lat", "lon"), decimals: int | None = None) -> DataFrame:
    """(a, b, distance_km), a < b, of all rows within the radius of each other (J01); distances to ``decimals`` if given.

    Places meet, each two of them once, and bring their keys along in arrays of
    bounded size; a distance is computed and rounded once for two places.  Only the
    result itself has a row for each pair of rows, and nothing that long is shuffled.
    """
    grid = Grid(radius_km)
    p = _places(rows, xy, grid)
    held = _chunks(rows, p, key, xy)
    out = None
    for level, pairs in cell_pairs(p, p, grid, False):
        left = held.select("lat", "lon", "chunk", "keys", F.struct(*_cell(level)).alias("l"))
        right = held.select(*[F.col(c).alias(f"r_{c}") for c in ("lat", "lon", "chunk", "keys")], F.struct(*_cell(level)).alias("r"))
        # of two chunks either can be the left one
        once = F.struct("lat", "lon", "chunk") <= F.struct(F.col("r_lat").alias("lat"), F.col("r_lon").alias("lon"), F.col("r_chunk").alias("chunk"))
        met = pairs.join(left, "l").join(right, "r").where(once)
        out = met if out is None else out.unionByName(met)
    distance = haversine(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"), EARTH_KM)
    near = out.withColumn("distance_km", distance).where(F.col("distance_km") <= radius_km)
    own = (F.col("lat") == F.col("r_lat")) & (F.col("lon") == F.col("r_lon")) & (F.col("chunk") == F.col("r_chunk"))
    shown = F.col("distance_km") if decimals is None else F.round("distance_km", decimals)
    near = near.select("keys", "r_keys", own.alias("_own"), shown.alias("distance_km"))
    each = near.select(F.explode("keys").alias("_x"), "r_keys", "_own", "distance_km").select("_x", F.explode("r_keys").alias("_y"), "_own", "distance_km")
    each = each.where(F.when(F.col("_own"), F.col("_x") < F.col("_y")).otherwise(F.col("_x") != F.col("_y")))
    return each.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), "distance_km")
