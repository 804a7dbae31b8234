"""Distance-weighted attribution of sources to nearby sites."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Category of each kind of site.
CATEGORIES = {"STEEL": "STEEL_METAL", "COAL": "THERMAL_POWER", "OILGAS": "LNG_GAS"}


@dataclass(frozen=True)
class AttributionParams:
    softening_km: float = 0.1
    reach_km: float = 5.0
    background_km: float = 2.0
    persistent_factor: float = 1.2
    single_factor: float = 0.8
    persistent_days: int = 20
    persistent_night: float = 0.8
    medium_km: float = 0.5


def pull(distance_km: Column, p: AttributionParams = AttributionParams()) -> Column:
    return 1 / F.pow(distance_km + p.softening_km, F.lit(2))


def modifier(active_days: Column, night_frac: Column, n_obs: Column, p: AttributionParams = AttributionParams()) -> Column:
    persistent = (active_days >= p.persistent_days) & (night_frac >= p.persistent_night)
    return F.when(persistent, p.persistent_factor).when(n_obs == 1, p.single_factor).otherwise(1.0)


def weights(pairs: DataFrame, source: str, kind: str, factor: str | None = None, p: AttributionParams = AttributionParams(), count: str | None = None) -> DataFrame:
    """(source, category, weight): summed pulls of sites by category, and the background.

    ``pairs`` are sources and sites within reach with distance_km; a source
    without any has no weights at all.  ``count`` says how many sites of one place a
    row stands for.
    """
    table = F.create_map(*[F.lit(v) for pair in CATEGORIES.items() for v in pair])
    near = pairs.where(F.col("distance_km") <= p.reach_km)
    scale = F.col(factor) if factor else F.lit(1.0)
    scale = scale * F.col(count) if count else scale
    found = near.groupBy(source, F.coalesce(F.element_at(table, F.col(kind)), F.col(kind)).alias("category")).agg(
        F.sum(pull(F.col("distance_km"), p) * scale).alias("weight")
    )
    background = near.select(source).distinct().select(
        source, F.lit("OTHER_UNKNOWN").alias("category"), pull(F.lit(p.background_km), p).alias("weight")
    )
    return found.unionByName(background)


def percents(weighted: DataFrame, key: str, category: str = "category", weight: str = "weight") -> DataFrame:
    """Whole percents that sum to 100 by largest remainder; ties to the smaller category."""
    total = F.sum(weight).over(Window.partitionBy(key))
    share = weighted.withColumn("_x", F.col(weight) / total * 100).withColumn("_b", F.floor("_x").cast("long"))
    # remainders are compared at nine decimals, so that equal shares tie on every engine
    order = Window.partitionBy(key).orderBy(F.desc(F.round(F.col("_x") - F.col("_b"), 9)), category)
    missing = 100 - F.sum("_b").over(Window.partitionBy(key))
    extra = F.when(F.row_number().over(order) <= missing, 1).otherwise(0)
    return share.withColumn("percent", F.col("_b") + extra).drop("_x", "_b")


def attribution(pairs: DataFrame, source: str, site: str, kind: str, factor: str | None = None, p: AttributionParams = AttributionParams(), count: str | None = None) -> DataFrame:
    """Top category, its percent, the nearest site and confidence of each source with a site in reach.

    MEDIUM confidence needs context evidence that this table does not carry, so it is LOW.
    """
    shares = percents(weights(pairs, source, kind, factor, p, count), source)
    order = Window.partitionBy(source).orderBy(F.desc("percent"), "category")
    top = shares.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(
        source, F.col("category").alias("top"), F.col("percent").alias("top_percent")
    )
    near = pairs.groupBy(source).agg(
        F.min_by(site, F.struct(F.round("distance_km", 9), site)).alias("nearest_site"), F.min("distance_km").alias("nearest_km")
    )
    return top.join(near, source).withColumn("confidence", F.lit("LOW"))
