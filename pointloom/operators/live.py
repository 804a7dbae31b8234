"""Live association of new observations with known sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators.celljoin import nearest_within
from pointloom.operators.dedup import keep_first
from pointloom.operators.formation import lead_clusters


LEADERS = "physical_key string, ts timestamp, lat double, lon double"


def known_sources(obs: DataFrame, registry: DataFrame, radius_km: float = 0.375) -> DataFrame:
    """(physical_key, source_id) of observations within the radius of a known source: the nearest, ties to the smaller id."""
    near = nearest_within(
        obs.select("physical_key", "lat", "lon"), registry.select("source_id", "r_lat", "r_lon"), radius_km, "source_id", ("lat", "lon"), ("r_lat", "r_lon")
    )
    return near.select("physical_key", "source_id")


def provisional_sources(fresh: DataFrame, radius_km: float = 0.375, leaders: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(physical_key, source_id) of observations without a known source, and the leaders that they founded.

    ``leaders`` are those of earlier observations, which lead again.
    """
    rows = fresh.select("physical_key", "ts", "lat", "lon")
    if leaders is not None:
        rows = rows.unionByName(leaders.select("physical_key", "ts", "lat", "lon"))
    led = lead_clusters(rows, "physical_key", "ts", radius_km)
    if leaders is not None:
        led = led.join(leaders.select("physical_key"), "physical_key", "left_anti")
    named = led.select("physical_key", F.concat(F.lit("LIVE-"), F.substring(F.sha2("leader", 256), 1, 10)).alias("source_id"))
    founded = fresh.join(led.where("physical_key = leader").select("physical_key"), "physical_key", "left_semi")
    return named, founded.select("physical_key", "ts", "lat", "lon")


def associate(obs: DataFrame, registry: DataFrame, radius_km: float = 0.375) -> DataFrame:
    """Every distinct observation with its source and kind, EXISTING or PROVISIONAL.

    obs: physical_key, ts, lat, lon.  registry: source_id, r_lat, r_lon.  Known
    sources come first, nearest with ties to the smaller id; the rest found or
    join provisional clusters, which never match the registry later.
    """
    distinct = keep_first(obs, ["physical_key"], ["ts"])
    known = known_sources(distinct, registry, radius_km)
    provisional, _ = provisional_sources(distinct.join(known, "physical_key", "left_anti"), radius_km)
    return distinct.join(kinds_of(known, provisional), "physical_key")


def kinds_of(known: DataFrame, provisional: DataFrame) -> DataFrame:
    return known.withColumn("kind", F.lit("EXISTING")).unionByName(provisional.withColumn("kind", F.lit("PROVISIONAL")))


def live_sources(associated: DataFrame, flagged: DataFrame) -> DataFrame:
    """Live sources, flagged known ones first, then by detections and id."""
    by = associated.groupBy("source_id", "kind").agg(F.count("*").alias("n_live"), F.max("ts").alias("last_seen"))
    joined = by.join(flagged.select("source_id").withColumn("flagged", F.lit(True)), "source_id", "left")
    first = (F.col("kind") == "EXISTING") & F.coalesce("flagged", F.lit(False))
    return joined.withColumn("flagged", first).orderBy(F.desc("flagged"), F.desc("n_live"), "source_id")
