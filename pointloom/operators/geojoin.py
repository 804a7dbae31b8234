"""Distance joins on a grid.

Spark has no range join: the nearby cells of one side are exploded into an
equality key, and the exact distance is tested on the candidates.  The grid is
as coarse as the radius, so a point has at most nine cells (more near the
poles), and the cheap latitude test comes before the trigonometry.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.geo import EARTH_KM, haversine
from pointloom.operators.celljoin import least_distance

KM_PER_DEGREE = math.pi * EARTH_KM / 180


def grid_join(
    left: DataFrame, right: DataFrame, radius_km: float, left_xy=("lat", "lon"), right_xy=("lat", "lon"),
    extra: Column | None = None,
) -> DataFrame:
    """Pairs within ``radius_km`` with their ``distance_km``; columns of both sides must differ.

    ``extra`` is a further condition on the pair, e.g. a key order for a self-join.
    """
    size = radius_km / KM_PER_DEGREE * 1.001
    (llat, llon), (rlat, rlon) = left_xy, right_xy
    band = F.floor(F.col(rlat) / size).cast("long")
    # a row of cells is as wide in longitude as the radius needs at the row's far edge
    far = F.least(F.lit(89.9), F.abs((band + F.when(F.col(rlat) >= 0, 2).otherwise(-1)) * size))
    width = size / F.cos(F.radians(far))
    rights = right.withColumn("_gy", band).withColumn("_gx", F.floor(F.col(rlon) / width).cast("long"))
    near = left.withColumn("_gy", F.explode(F.expr(f"sequence(bigint(floor({llat}/{size!r}))-1, bigint(floor({llat}/{size!r}))+1)")))
    edge = F.least(F.lit(89.9), F.abs((F.col("_gy") + F.when(F.col("_gy") >= 0, 2).otherwise(-1)) * size))
    cell = F.floor(F.col(llon) / (size / F.cos(F.radians(edge)))).cast("long")
    near = near.withColumn("_gx", F.explode(F.sequence(cell - 1, cell + 1)))
    distance = haversine(F.col(llat), F.col(llon), F.col(rlat), F.col(rlon), EARTH_KM)
    test = (F.abs(F.col(llat) - F.col(rlat)) <= size) & (distance <= radius_km)
    if extra is not None:
        test = test & extra
    joined = near.alias("a").join(rights.alias("b"), (F.col("a._gy") == F.col("b._gy")) & (F.col("a._gx") == F.col("b._gx")) & test)
    return joined.withColumn("distance_km", distance).drop("_gy", "_gx")


def nearest(pairs: DataFrame, left_key: str, right_key: str, k: int = 1) -> DataFrame:
    """The ``k`` nearest right rows of each left row; ties go to the smaller key."""
    order = Window.partitionBy(left_key).orderBy("distance_km", right_key)
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def near_any(points: DataFrame, others: DataFrame, key: str, radius_km: float, left_xy, right_xy) -> DataFrame:
    """Keys of points with at least one partner (J25); no pair beyond the nearest is looked for."""
    return least_distance(points, others, radius_km, left_xy, right_xy).select(key).distinct()


def match_rates(
    points: DataFrame, others: DataFrame, key: str, radii_km: list[float], left_xy, right_xy
) -> DataFrame:
    """(radius_km, matched, total): points with a partner within each radius."""
    near = least_distance(points.select(key, *left_xy), others.select(*right_xy), max(radii_km), left_xy, right_xy)
    least = near.groupBy(key).agg(F.min("distance_km").alias("d"))
    spark = points.sparkSession
    radii = spark.createDataFrame([(float(r),) for r in radii_km], "radius_km double")
    hits = least.join(F.broadcast(radii), F.col("d") <= F.col("radius_km")).groupBy("radius_km").agg(F.count("*").alias("matched"))
    totals = points.agg(F.count("*").alias("total"))
    return radii.join(hits, "radius_km", "left").join(F.broadcast(totals)).select(
        "radius_km", F.coalesce("matched", F.lit(0)).alias("matched"), "total"
    )


def band_join(left: DataFrame, right: DataFrame, left_xy, right_xy, dlat: float, dlon: float) -> DataFrame:
    """Pairs within a latitude and a longitude band (J06), by cells of the band's size."""
    (llat, llon), (rlat, rlon) = left_xy, right_xy
    rights = right.withColumn("_gy", F.floor(F.col(rlat) / dlat)).withColumn("_gx", F.floor(F.col(rlon) / dlon))
    near = left.withColumn(
        "_gy", F.explode(F.sequence(F.floor(F.col(llat) / dlat) - 1, F.floor(F.col(llat) / dlat) + 1))
    ).withColumn("_gx", F.explode(F.sequence(F.floor(F.col(llon) / dlon) - 1, F.floor(F.col(llon) / dlon) + 1)))
    test = (F.abs(F.col(llat) - F.col(rlat)) < dlat) & (F.abs(F.col(llon) - F.col(rlon)) < dlon)
    return near.join(rights, ["_gy", "_gx"]).where(test).drop("_gy", "_gx")


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Inside a bounding box, its edges included."""
    return lat.between(south, north) & lon.between(west, east)


def consistency(
    ours: DataFrame, theirs: DataFrame, box: tuple[float, float, float, float], radii_km: list[float]
) -> DataFrame:
    """(direction, radius_km, matched, total) between two point tables, theirs cut to a box.

    ours: o_id, o_lat, o_lon.  theirs: t_id, t_lat, t_lon.  A consistency check, not accuracy.
    """
    kept = theirs.where(in_box(F.col("t_lat"), F.col("t_lon"), *box))
    o, t = ("o_lat", "o_lon"), ("t_lat", "t_lon")
    there = match_rates(ours, kept, "o_id", radii_km, o, t).withColumn("direction", F.lit("ours_near_theirs"))
    back = match_rates(kept, ours, "t_id", radii_km, t, o).withColumn("direction", F.lit("theirs_near_ours"))
    return there.unionByName(back)
