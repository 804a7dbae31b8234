"""Association of events with facilities by staged evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions.geo import METRES_PER_DEGREE, polygon_relation
from pointloom.operators.geojoin import grid_join

#: Degrees of the cells in which polygons are looked up.
CELL = 0.1


@dataclass(frozen=True)
class FacilityParams:
    radius_m: float = 1000.0
    #: Set only to let a clear distance margin decide.
    margin_m: float | None = None


def candidates(events: DataFrame, sites: DataFrame, event: str, site: str, p: FacilityParams = FacilityParams()) -> DataFrame:
    """Sites within the radius of each event with distance and polygon evidence.

    events: event id, e_lat, e_lon.  sites: site id, s_lat, s_lon and ring (array
    of lat, lon structs, null where there is no polygon).  With a polygon the
    distance is to its boundary, 0 inside, however large the polygon is: sites with
    one are found by the cells of its bounding box.
    """
    pairs = grid_join(events, sites.where("ring IS NULL"), p.radius_m / 1000, ("e_lat", "e_lon"), ("s_lat", "s_lon"))
    plain = pairs.select(event, site, (F.col("distance_km") * 1000).alias("exact_m"), F.lit(None).cast("boolean").alias("in_polygon"))
    reach = p.radius_m / METRES_PER_DEGREE * 1.01
    along = lambda k: F.transform("ring", lambda x: x[k])
    ends = {f"_{f}_{k}": g(along(k)) for k in ("lat", "lon") for f, g in (("min", F.array_min), ("max", F.array_max))}
    boxed = sites.where("ring IS NOT NULL").withColumns(ends)
    far = F.least(F.lit(89.0), F.greatest(F.abs("_min_lat"), F.abs("_max_lat")) + reach)
    boxed = boxed.withColumns(
        {"_min_lat": F.col("_min_lat") - reach, "_max_lat": F.col("_max_lat") + reach,
         "_min_lon": F.col("_min_lon") - reach / F.cos(F.radians(far)), "_max_lon": F.col("_max_lon") + reach / F.cos(F.radians(far))}
    )
    cells = lambda k: F.sequence(F.floor(F.col(f"_min_{k}") / CELL).cast("long"), F.floor(F.col(f"_max_{k}") / CELL).cast("long"))
    boxed = boxed.withColumn("_gy", F.explode(cells("lat"))).withColumn("_gx", F.explode(cells("lon")))
    placed = events.withColumns({"_gy": F.floor(F.col("e_lat") / CELL).cast("long"), "_gx": F.floor(F.col("e_lon") / CELL).cast("long")})
    inside_box = F.col("e_lat").between(F.col("_min_lat"), F.col("_max_lat")) & F.col("e_lon").between(F.col("_min_lon"), F.col("_max_lon"))
    met = placed.join(boxed, ["_gy", "_gx"]).where(inside_box)
    met = met.withColumn("_rel", polygon_relation(F.col("e_lat"), F.col("e_lon"), F.col("ring")))
    exact = F.when(F.col("_rel.inside"), 0.0).otherwise(F.col("_rel.boundary_m"))
    shaped = met.select(event, site, exact.alias("exact_m"), F.col("_rel.inside").alias("in_polygon"))
    near = plain.unionByName(shaped).where(F.col("exact_m") <= p.radius_m)
    return near.select(event, site, F.round("exact_m", 1).alias("candidate_m"), "in_polygon")


def decide(cands: DataFrame, events: DataFrame, event: str, site: str, p: FacilityParams = FacilityParams()) -> DataFrame:
    """Status, basis and selected site of each event.

    None in the radius: UNRESOLVED.  One: ASSOCIATED.  Several: unique containment
    if every candidate has a polygon, then the margin if one is set, else
    MULTIPLE_CANDIDATES; the nearest is never just taken.
    """
    ordered = cands.groupBy(event).agg(
        F.sort_array(F.collect_list(F.struct("candidate_m", site, "in_polygon"))).alias("c")
    )
    joined = events.select(event).distinct().join(ordered, event, "left")
    n = F.coalesce(F.size("c"), F.lit(0))
    inside = F.filter("c", lambda x: F.coalesce(x["in_polygon"], F.lit(False)))
    unknown = F.exists("c", lambda x: x["in_polygon"].isNull())
    first = lambda a: F.get(a, F.lit(0))[site]
    unique = (F.size(inside) == 1) & ~unknown
    clear = F.lit(False)
    if p.margin_m is not None:
        clear = F.get("c", F.lit(1))["candidate_m"] - F.get("c", F.lit(0))["candidate_m"] >= p.margin_m
    basis = (
        F.when(n == 0, F.lit(None).cast("string"))
        .when(n == 1, "SOLE_CANDIDATE_WITHIN_RADIUS")
        .when(unique, "POLYGON_CONTAINMENT")
        .when(clear, "SEPARATION_MARGIN")
    )
    status = F.when(n == 0, "UNRESOLVED").when(basis.isNotNull(), "ASSOCIATED").otherwise("MULTIPLE_CANDIDATES")
    chosen = F.when(unique & (n > 1), first(inside)).when(basis.isNotNull(), first(F.col("c")))
    return joined.select(event, n.alias("n_candidates"), status.alias("status"), basis.alias("basis"), chosen.alias("selected"))


FORBIDDEN = ("status", "basis", "selected", "association", "decision")


def refuse_decision_fields(df: DataFrame) -> None:
    """Raise if a feature table carries decision fields."""
    leaked = [c for c in df.columns if any(c == f or c.startswith(f"{f}_") for f in FORBIDDEN)]
    if leaked:
        raise ValueError(f"decision fields among the features: {leaked}")


def raw_context(cands: DataFrame, events: DataFrame, event: str) -> DataFrame:
    """Facility counts and nearest distance without any decision; absence is a status, not a zero."""
    found = cands.groupBy(event).agg(F.count("*").alias("n_sites"), F.min("candidate_m").alias("nearest_m"))
    status = F.when(F.col("n_sites").isNull(), "NO_FACILITY_WITHIN_RADIUS").otherwise("OK")
    return events.select(event).distinct().join(found, event, "left").withColumn("context_status", status)


def usable(column: Column) -> Column:
    """A point's coordinates are usable."""
    return column["lat"].between(-90, 90) & column["lon"].between(-180, 180)
