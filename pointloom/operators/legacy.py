"""The older rules: cell clusters, rolling means, classes and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.geojoin import grid_join, nearest


def confidence_fraction(raw: Column) -> Column:
    """l .3, n .6, h .9; numbers above 1 are percents."""
    text = F.lower(F.trim(raw))
    value = text.try_cast("double")
    return (
        F.when(text.isin("l", "low"), 0.3).when(text.isin("n", "nominal"), 0.6).when(text.isin("h", "high"), 0.9)
        .when(value > 1, value / 100).otherwise(value)
    )


def confidence_score(raw: Column) -> Column:
    """30, 70, 95 for the letters, else the number, else 50."""
    text = F.lower(F.trim(raw))
    return F.when(text == "l", 30.0).when(text == "n", 70.0).when(text == "h", 95.0).otherwise(
        F.coalesce(text.try_cast("double"), F.lit(50.0))
    )


def round_half_even(x: Column, places: int = 2) -> Column:
    """``x`` to so many decimals, a tie to the even digit, judged on the double's exact binary value.

    ``2.675`` is a little less than its decimal and goes down.  The product with
    twice the scale is split into parts that doubles hold exactly, so the sign of
    the distance from the middle of two neighbours is exact.
    """
    scale = 10.0**places
    low = F.floor(x * scale).cast("double")
    high = 134217729.0 * x - (134217729.0 * x - x)  # the upper 26 bits
    beyond = (high * (2 * scale) - (2 * low + 1)) + (x - high) * (2 * scale)
    up = (beyond > 0) | ((beyond == 0) & (F.pmod(low, F.lit(2.0)) == 1))
    return (low + F.when(up, 1.0).otherwise(0.0)) / scale


def cell_key(lat: Column, lon: Column) -> Column:
    """Two-decimal cell of a point."""
    two = lambda x: F.format_string("%.2f", round_half_even(x))
    return F.concat(two(lat), F.lit("_"), two(lon))


def valid_rows(df: DataFrame, lat: str, lon: str, ts: str) -> tuple[DataFrame, DataFrame]:
    """(rows on the globe with a readable moment, one row with n_dropped)."""
    there = F.col(lat).cast("double").between(-90, 90) & F.col(lon).cast("double").between(-180, 180)
    good = F.coalesce(there & F.col(ts).try_cast("timestamp").isNotNull(), F.lit(False))
    return df.where(good), df.agg(F.count_if(~good).alias("n_dropped"))


def detection_id(source: Column, number: Column) -> Column:
    """``{source}-{number:06d}``."""
    return F.format_string("%s-%06d", source, number)


def enriched(detections: DataFrame, sites: DataFrame, woods: DataFrame, key: str, site_km: float = 3.0, wood_km: float = 1.0) -> DataFrame:
    """Detections with their nearest site and wood within reach; null where there is none.

    detections: key, lat, lon.  sites: site_id, site_type, s_lat, s_lon.  woods: wood_id, w_lat, w_lon.
    """
    near = nearest(grid_join(detections.select(key, "lat", "lon"), sites, site_km, ("lat", "lon"), ("s_lat", "s_lon")), key, "site_id")
    wood = nearest(grid_join(detections.select(key, "lat", "lon"), woods, wood_km, ("lat", "lon"), ("w_lat", "w_lon")), key, "wood_id")
    sited = near.select(key, "site_id", "site_type", F.round("distance_km", 3).alias("site_km"))
    return detections.join(sited, key, "left").join(wood.select(key, F.round("distance_km", 3).alias("wood_km")), key, "left")


def trailing_mean(df: DataFrame, key: str, ts: str, value: str, days: int = 60) -> DataFrame:
    """Mean of the ``days`` before each row in its cell, without the row itself, else the overall mean."""
    seconds = F.unix_micros(ts)
    before = Window.partitionBy(key).orderBy(seconds).rangeBetween(-days * 86_400_000_000, -1)
    overall = df.agg(F.avg(value).alias("_all"))
    return df.crossJoin(F.broadcast(overall)).withColumn(
        "baseline", F.coalesce(F.avg(value).over(before), F.col("_all"), F.lit(10.0))
    ).drop("_all")


def deviation(value: Column, baseline: Column) -> Column:
    return F.when(baseline > 0, (value - baseline) / baseline)


def classify(cover: Column, confidence: Column, dev: Column) -> Column:
    """Class of a detection from land cover, confidence and deviation (X44); the branch order matters."""
    conf = F.coalesce(confidence, F.lit(0.0))
    industrial = F.coalesce(cover == "Industrial Area", F.lit(False))
    forest = F.coalesce(cover == "Forest", F.lit(False))
    return (
        F.when(conf < 0.3, "UNKNOWN")
        .when(industrial & (dev >= 0.4), "INDUSTRIAL_FIRE")
        .when(industrial, "PERSISTENT_THERMAL_SOURCE")
        .when(forest & (conf >= 0.5), "NATURAL_FIRE")
        .when(~industrial & ~forest & (dev >= 0.3), "AGRICULTURAL_BURNING")
        .otherwise("UNKNOWN")
    )


def risk(klass: Column, dev: Column) -> Column:
    d = F.coalesce(dev, F.lit(0.0))
    return (
        F.when(klass == "INDUSTRIAL_FIRE", F.when(d >= 0.7, "HIGH").otherwise("WARNING"))
        .when(klass == "NATURAL_FIRE", F.when(d >= 0.6, "HIGH").otherwise("WARNING"))
        .when(klass == "AGRICULTURAL_BURNING", F.when(d >= 0.5, "WARNING").otherwise("LOW"))
        .otherwise("LOW")
    )


def filled_days(df: DataFrame, key: str, day: str, value: str, last: Column, days: int = 14) -> DataFrame:
    """The last ``days`` days of each key; days without rows are 0, as this older rule has it."""
    keys = df.select(key).distinct()
    calendar = keys.select(key, F.explode(F.sequence(F.date_sub(last, days - 1), last, F.expr("interval 1 day"))).alias(day))
    sums = df.groupBy(key, day).agg(F.max(value).alias("_v"))
    return calendar.join(sums, [key, day], "left").select(key, day, F.coalesce("_v", F.lit(0.0)).alias("value"))


def two_hour_buckets(df: DataFrame, ts: str, value: str, day: Column) -> DataFrame:
    """Twelve buckets of one day, with count and maximum."""
    spark = df.sparkSession
    own = df.where(F.to_date(ts) == day).groupBy((F.floor(F.hour(ts) / 2) * 2).cast("int").alias("hour")).agg(
        F.count("*").alias("n"), F.max(value).alias("peak")
    )
    return spark.range(12).select((F.col("id") * 2).cast("int").alias("hour")).join(own, "hour", "left").select(
        "hour", F.coalesce("n", F.lit(0)).alias("n"), "peak"
    )


def assessed(df: DataFrame, key: str, ts: str, value: str, cover: Column, confidence: Column) -> DataFrame:
    """The older chain in one: cell, baseline, deviation, class and risk of each detection."""
    celled = df.withColumns({"cell": cell_key(F.col("lat"), F.col("lon")), "_cover": cover, "_confidence": confidence})
    based = trailing_mean(celled, "cell", ts, value)
    dev = based.withColumn("deviation", deviation(F.col(value), F.col("baseline")))
    named = dev.withColumn("class", classify(F.col("_cover"), F.col("_confidence"), F.col("deviation")))
    return named.withColumn("risk", risk(F.col("class"), F.col("deviation"))).select(key, "cell", "baseline", "deviation", "class", "risk")
