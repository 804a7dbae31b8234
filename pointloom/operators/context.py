"""Map and land-cover context of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.geo import METRES_PER_DEGREE, land_tile, tiles_around
from pointloom.operators.geojoin import grid_join
from pointloom.sources import rasters

#: Context categories by map tags.
CATEGORIES = {
    "industrial_landuse": [("landuse", "industrial")],
    "works": [("man_made", "works")],
    "power_plant": [("power", "plant"), ("power", "generator")],
    "chimney_or_flare": [("man_made", "chimney"), ("man_made", "flare")],
    "mine_or_quarry": [("landuse", "quarry"), ("industrial", "mine"), ("man_made", "mineshaft")],
    "oil_gas": [
        ("industrial", "refinery"), ("industrial", "oil"), ("man_made", "petroleum_well"),
        ("man_made", "storage_tank"), ("pipeline", "substation"),
    ],
    "steel_metal": [("industrial", "steelmaker"), ("industrial", "metal_works"), ("product", "steel")],
    "landfill": [("landuse", "landfill")],
    "residential": [("landuse", "residential")],
    "farmland": [("landuse", "farmland")],
    "forest": [("landuse", "forest"), ("natural", "wood")],
}
BACKGROUND = ("residential", "farmland", "forest")
#: Fixed value: version of the question put to the map server.
QUESTION = "osm-context-q1"


def categories_of(tags: Column) -> Column:
    """Sorted categories of a map of tags."""
    tests = []
    for name, tags_of in sorted(CATEGORIES.items()):
        hit = F.lit(False)
        for key, value in tags_of:
            hit = hit | F.coalesce(F.element_at(tags, key) == value, F.lit(False))
        tests.append(F.when(hit, name))
    return F.array_compact(F.array(*tests))


def point_features(points: DataFrame, elements: DataFrame, fetched: DataFrame, key: str, radii_m=(1000, 5000)) -> DataFrame:
    """Counts by category and radius and nearest distances of each point.

    points: key, lat, lon.  elements: ref, e_lat, e_lon, categories.  fetched: tile.
    All tiles of the largest radius must be fetched, else every feature is null
    with status MISSING_NOT_FETCHED; with them, absences are real zeros.
    """
    far = max(radii_m)
    # places, not points, meet elements, which are merged where they are at one place, too
    places = points.select("lat", "lon").distinct()
    needed = places.select("lat", "lon", F.explode(tiles_around(F.col("lat"), F.col("lon"), far)).alias("tile"))
    missing = needed.join(fetched.select("tile").distinct(), "tile", "left_anti").select("lat", "lon").distinct()
    merged = elements.dropDuplicates(["ref"]).groupBy("e_lat", "e_lon", "categories").agg(F.count("*").alias("_n"), F.min("ref").alias("ref"))
    pairs = grid_join(places, merged, far / 1000, ("lat", "lon"), ("e_lat", "e_lon"))
    one = pairs.select("lat", "lon", "ref", "_n", (F.col("distance_km") * 1000).alias("d"), F.explode("categories").alias("category"))
    aggs = []
    for name in sorted(CATEGORIES):
        own = F.col("category") == name
        aggs += [F.sum(F.when(own & (F.col("d") <= r), F.col("_n")).otherwise(0)).alias(f"n_{name}_{r}m") for r in radii_m]
        aggs.append(F.min(F.when(own, F.col("d"))).alias(f"nearest_{name}_m"))
    counts = one.groupBy("lat", "lon").agg(
        *aggs,
        F.min_by("ref", F.when(~F.col("category").isin(*BACKGROUND), F.struct("d", "ref"))).alias("nearest_ref"),
    )
    by_place = places.join(counts, ["lat", "lon"], "left").join(missing.withColumn("_missing", F.lit(True)), ["lat", "lon"], "left")
    out = points.select(key, "lat", "lon").join(by_place, ["lat", "lon"], "left")
    cols = [
        F.when(F.col("_missing").isNull(), F.coalesce(F.col(c), F.lit(0)) if c.startswith("n_") else F.col(c)).alias(c)
        for c in counts.columns
        if c not in ("lat", "lon")
    ]
    status = F.when(F.col("_missing").isNull(), "OK").otherwise("MISSING_NOT_FETCHED")
    return out.select(key, status.alias("context_status"), *cols)


def land_cover(points: DataFrame, pixels: DataFrame, key: str, radius_m: float = 500.0) -> DataFrame:
    """Class shares, nodata share and dominant class (ties to the smaller code) within a radius.

    pixels: p_lat, p_lon, class (0: no data).
    """
    pairs = grid_join(points.select(key, "lat", "lon"), pixels, radius_m / 1000, ("lat", "lon"), ("p_lat", "p_lon"))
    by_class = pairs.groupBy(key, "class").agg(F.count("*").alias("n"))
    known = F.sum(F.when(F.col("class") != 0, F.col("n"))).over(Window.partitionBy(key))
    total = F.sum("n").over(Window.partitionBy(key))
    shares = by_class.withColumns({"share": F.when(F.col("class") != 0, F.col("n") / known), "_total": total})
    return shares.groupBy(key).agg(
        F.max("_total").alias("n_pixels"),
        (F.sum(F.when(F.col("class") == 0, F.col("n")).otherwise(0)) / F.max("_total")).alias("nodata_share"),
        F.max_by("class", F.when(F.col("class") != 0, F.struct("n", (-F.col("class")).alias("c")))).alias("dominant"),
        F.sort_array(F.collect_list(F.when(F.col("class") != 0, F.struct("class", F.round("share", 6).alias("share"))))).alias("shares"),
    )


def tile_plan(points: DataFrame, radius_m: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(tile, n_points): the distinct tiles that the points need."""
    each = points.select(F.explode(tiles_around(F.col(lat), F.col(lon), radius_m)).alias("tile"))
    return each.groupBy("tile").agg(F.count("*").alias("n_points"))


def tile_question(tile: Column, degrees: float = 0.25, timeout_s: int = 90) -> Column:
    """What a fetcher asks the map server for a tile: elements of any category inside its box."""
    corner = lambda part, more: (F.split(tile, "_")[part].cast("int") + more) * degrees
    box = F.format_string("(%.4f,%.4f,%.4f,%.4f)", corner(0, 0), corner(1, 0), corner(0, 1), corner(1, 1))
    wanted = [pair for pairs in CATEGORIES.values() for pair in pairs]
    lines = [F.concat(F.lit(f'nwr["{key}"="{value}"]'), box, F.lit(";")) for key, value in wanted]
    return F.concat(F.lit(f"[out:json][timeout:{timeout_s}];("), *lines, F.lit(");out center tags;"))


def question_hash(question: Column) -> Column:
    """Sixteen hex digits of a question and its version; names the cached answer."""
    return F.substring(F.sha2(F.concat(F.lit(QUESTION + "\n"), question), 256), 1, 16)


#: Names of the land-cover classes.
COVER = {
    10: "tree_cover", 20: "shrubland", 30: "grassland", 40: "cropland", 50: "built_up", 60: "bare_sparse",
    70: "snow_ice", 80: "water", 90: "herbaceous_wetland", 95: "mangroves", 100: "moss_lichen",
}


def _cover_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(v) for pair in COVER.items() for v in pair])
    return F.when(code.isNotNull(), F.coalesce(F.element_at(names, code), F.concat(F.lit("unknown_"), code.cast("string"))))


def raster_cover(points: DataFrame, blocks: DataFrame, key: str, radius_m: float = 500.0) -> DataFrame:
    """Land cover around points from rasters.

    points: key, lat, lon.  blocks: as from ``rasters.raster_blocks``; a raster's tile is
    part of its file's name.  Status OK, PARTIAL_TILE_MISSING, MISSING_NOT_FETCHED where
    the point's own tile is not there, or READ_ERROR; with the last two every feature is
    null.  Code 0 is no data: it counts as a pixel, never as a class.  ``shares`` maps
    the names of classes to shares of the known pixels; ties of the dominant class go to
    the smaller code.
    """
    tile = lambda a, b: land_tile(F.col("lat") + a, F.col("lon") + b)
    dlat = F.lit(radius_m / METRES_PER_DEGREE)
    dlon = radius_m / (METRES_PER_DEGREE * F.greatest(F.cos(F.radians("lat")), F.lit(1e-6)))
    p = points.select(key, "lat", "lon").dropDuplicates([key])
    corners = F.array_distinct(F.array(*[tile(a * dlat, b * dlon) for a in (-1, 1) for b in (-1, 1)]))
    wanted = p.select(key, tile(F.lit(0), F.lit(0)).alias("_own"), F.explode(corners).alias("_tile"))
    there = blocks.groupBy(F.regexp_extract("file", "_([NS][0-9]{2}[EW][0-9]{3})_", 1).alias("_tile")).agg(F.max("problem").alias("_file_problem"))
    tiles = wanted.join(there.withColumn("_there", F.lit(True)), "_tile", "left").groupBy(key).agg(
        F.array_join(F.sort_array(F.collect_set("_tile")), ";").alias("tiles"),
        F.bool_and(F.col("_there").isNotNull()).alias("_all"),
        F.coalesce(F.bool_or(F.when(F.col("_tile") == F.col("_own"), F.col("_there"))), F.lit(False)).alias("_has_own"),
        F.max("_file_problem").alias("_file_problem"),
    )
    by_class = rasters.class_counts(p, blocks, key, radius_m).groupBy(key, "class").agg(
        F.sum("n").alias("n"), F.bool_or("here").alias("here"), F.max("problem").alias("problem")
    )
    known = (F.col("class") != 0) & (F.col("n") > 0)
    counts = by_class.groupBy(key).agg(
        F.sum("n").alias("n_pixels"), F.sum(F.when(F.col("class") == 0, F.col("n")).otherwise(0)).alias("_none"),
        F.sum(F.when(known, F.col("n"))).alias("_known"), F.max("problem").alias("_problem"),
        F.max(F.when(F.col("here") & (F.col("class") != 0), F.col("class"))).alias("class_at_point"),
        F.max_by("class", F.when(known, F.struct("n", (-F.col("class")).alias("c")))).alias("dominant"),
        F.sort_array(F.collect_list(F.when(known, F.struct("class", "n")))).alias("_classes"),  # as many as there are classes
    )
    shares = F.map_from_entries(F.transform("_classes", lambda x: F.struct(_cover_name(x["class"]), F.round(x["n"] / F.col("_known"), 4))))
    problem = F.coalesce("_file_problem", "_problem")
    status = (
        F.when(~F.col("_has_own"), "MISSING_NOT_FETCHED").when(problem.isNotNull(), F.concat(F.lit("READ_ERROR: "), problem))
        .when(~F.col("_all"), "PARTIAL_TILE_MISSING").otherwise("OK")
    )
    out = p.select(key).join(tiles, key, "left").join(counts, key, "left").withColumn("status", F.coalesce(status, F.lit("MISSING_NOT_FETCHED")))
    shown = F.col("status").isin("OK", "PARTIAL_TILE_MISSING")
    n = F.coalesce("n_pixels", F.lit(0))
    return out.select(
        key, "status", "tiles", F.when(shown, F.col("class_at_point")).alias("class_at_point"),
        F.when(shown, _cover_name(F.col("class_at_point"))).alias("name_at_point"), F.when(shown, n).alias("n_pixels"),
        F.when(shown & (n > 0), F.round(F.col("_none") / n, 4)).alias("nodata_share"),
        F.when(shown, _cover_name(F.col("dominant"))).alias("dominant"), F.when(shown & (F.size("_classes") > 0), shares).alias("shares"),
    )
