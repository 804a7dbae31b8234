"""Formation of sources and events from observations.

The rule is sequential: in order of time each observation joins the nearest
source that has a member within the radius and a running centroid within the
extent, else it founds one.  Sources never reach across components of the graph
of observations within the radius, so the rule runs once per component, which is
exact.

Components come from grid cells whose points are all within the radius of each
other, so a hot spot is a few cells however many rows it has; only neighbouring
cells are compared, by their boxes, then by one point of each, and by all of their
distinct points only where they are not connected by then.  Spark deals the
components to tasks, sorted by time, and each task streams them: it holds the
distinct members of one component, not its rows.  The rows of one component are
read by one task, as the rule demands; that is the bound on a hot spot.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.geo import EARTH_M, haversine
from pointloom.operators.graph import connected_components
from pointloom.operators.sessions import sessionize
from pointloom.plans.joins import join_sized
from pointloom.plans.scratch import Leftovers, drop, written

METRES = EARTH_M * math.pi / 180  # of a degree of latitude


@dataclass(frozen=True)
class FormationParams:
    radius_m: float = 375.0
    extent_m: float = 2000.0
    gap_hours: float = 36.0
    #: With it two observations may be ``pixel_factor`` of the larger pixel apart, if that is more.
    pixel_aware: bool = False
    pixel_factor: float = 1.0


def _cos(lat: Column) -> Column:
    return F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.lit(90.0), F.abs(lat)))))


def _cells(radius_m: float, lat: Column, lon: Column) -> tuple[Column, Column]:
    """Row and column of a cell with a diagonal below the radius."""
    size = radius_m / math.sqrt(2) * 0.999 / METRES
    y = F.floor(lat / size).cast("long")
    return y, F.floor(lon / _width(y, size)).cast("long")


def _width(y: Column, size: float) -> Column:
    """Degrees of longitude of a row's cells; the row is widest in metres at its edge nearest to the equator."""
    return size / _cos(F.when(y >= 0, y).otherwise(y + 1) * size)


def cell_links(points: DataFrame, radius_m: float) -> tuple[DataFrame, DataFrame]:
    """(y, x, cell, n) of the cells of distinct ``points`` (lat, lon, n), and links (src, dst) between their numbers.

    With a column ``within`` cells hold points of one value of it, and only these are
    linked; their numbers are hashes then, and two cells that share one count as linked.
    """
    by = ["within"] if "within" in points.columns else []
    number = F.xxhash64("within", "y", "x") if by else F.col("y") * (1 << 32) + F.col("x")
    size = radius_m / math.sqrt(2) * 0.999 / METRES
    reach = radius_m / METRES * 1.001
    y, x = _cells(radius_m, F.col("lat"), F.col("lon"))
    points = written(
        points.select(*by, "lat", "lon", "n").withColumns({"y": y, "x": x}).withColumn("cell", number), "points"
    )
    box = [F.struct(*[f("lat").alias(f"{k}a") for k, f in (("s", F.min), ("n", F.max))], *[f("lon").alias(f"{k}o") for k, f in (("s", F.min), ("n", F.max))]).alias("box")]
    cells = written(points.groupBy(*by, "y", "x", "cell").agg(*box, F.sum("n").alias("n")), "cells")
    # cells that can hold a point within the radius: two rows up and down, columns by the box
    rows = cells.select(*by, "cell", "box", F.col("y").alias("_y"), F.col("x").alias("_x"), F.explode(F.sequence(F.col("y"), F.col("y") + 2)).alias("y"))
    edge = F.greatest(F.abs(F.col("y")), F.abs(F.col("y") + 1)) * size
    far = F.lit(reach) / _cos(F.greatest(edge, F.abs(F.col("box.sa")), F.abs(F.col("box.na"))))
    width = _width(F.col("y"), size)
    span = F.sequence(F.floor((F.col("box.so") - far) / width).cast("long"), F.floor((F.col("box.no") + far) / width).cast("long"))
    near = rows.select(*by, "_y", "_x", F.col("cell").alias("a"), F.col("box").alias("p"), "y", F.explode(span).alias("x"))
    other = cells.select(*by, "y", "x", F.col("cell").alias("b"), F.col("box").alias("q"))
    pairs = near.join(other, [*by, "y", "x"]).where("y > _y or x > _x").drop(*by, "y", "x", "_y", "_x")
    apart = lambda k: F.greatest(F.lit(0.0), F.col(f"q.s{k}") - F.col(f"p.n{k}"), F.col(f"p.s{k}") - F.col(f"q.n{k}"))
    across = lambda k: F.greatest(F.col(f"q.n{k}") - F.col(f"p.s{k}"), F.col(f"p.n{k}") - F.col(f"q.s{k}"))
    low = F.least(*[F.abs(F.col(f"{side}.{e}a")) for side in "pq" for e in "sn"])
    high = F.greatest(*[F.abs(F.col(f"{side}.{e}a")) for side in "pq" for e in "sn"])
    crosses = F.least(F.col("p.sa"), F.col("q.sa")) * F.greatest(F.col("p.na"), F.col("q.na")) <= 0
    least = F.hypot(apart("a"), apart("o") * _cos(high)) * METRES * 0.999
    most = F.hypot(across("a"), across("o") * _cos(F.when(crosses, 0.0).otherwise(low))) * METRES * 1.001
    pairs = written(pairs.where(least <= radius_m).select("a", "b", "p", "q", (most <= radius_m).alias("sure")), "pairs")
    # of the others: the point of each cell that is nearest to the middle of the other's box
    open_ = pairs.where("not sure")
    ends = {}
    for own, opposite in (("a", "q"), ("b", "p")):
        middle = [(F.col(f"{opposite}.s{k}") + F.col(f"{opposite}.n{k}")) / 2 for k in "ao"]
        away = haversine(F.col("lat"), F.col("lon"), *middle)
        there = open_.join(points.select(F.col("cell").alias(own), "lat", "lon"), own)
        ends[own] = there.groupBy("a", "b").agg(F.min_by(F.struct("lat", "lon"), away).alias(f"at_{own}"))
    tried = ends["a"].join(ends["b"], ["a", "b"])
    close = haversine(F.col("at_a.lat"), F.col("at_a.lon"), F.col("at_b.lat"), F.col("at_b.lon")) <= radius_m
    links = written(pairs.where("sure").select("a", "b").union(tried.where(close).select("a", "b")), "links")
    named = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    named = written(named, "named")
    of = lambda c: named.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    rest = open_.join(of("a"), "a", "left").join(of("b"), "b", "left")
    rest = rest.where(~F.coalesce(F.col("of_a"), F.col("a")).eqNullSafe(F.coalesce(F.col("of_b"), F.col("b")))).select("a", "b", "p", "q")
    side = lambda c: points.select(F.col("cell").alias(c), F.col("lat").alias(f"{c}_lat"), F.col("lon").alias(f"{c}_lon"))
    exact = haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")) <= radius_m
    in_reach = lambda c, o: (
        F.col(f"{c}_lat").between(F.col(f"{o}.sa") - reach, F.col(f"{o}.na") + reach)
    )
    more = (
        rest.join(side("a"), "a").where(in_reach("a", "q")).join(side("b"), "b").where(in_reach("b", "p")).where(exact)
        .select("a", "b").distinct()
    )
    links = links.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(written(more, "links").select("a", "b"))
    return cells.select(*by, "y", "x", "cell", "n"), links


def components(obs: DataFrame, key: str, radius_km: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(key, component) of points linked within a radius; a lone point has one of its own."""
    return _with_components(obs.select(key, lat, lon), radius_km * 1000, lat, lon).select(key, "component")


def _with_components(obs: DataFrame, radius_m: float, lat: str, lon: str, within: str | None = None) -> DataFrame:
    """``obs`` with the number of each row's component; only rows of one value of ``within`` are linked."""
    apart = [F.col(within).alias("within")] if within else []
    points = obs.select(*apart, F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    points = points.groupBy(*points.columns).agg(F.count("*").alias("n"))
    with Leftovers() as scratch:
        cells, links = cell_links(points, radius_m)
        parts = connected_components(links)
        named = cells.join(parts.withColumnRenamed("node", "cell"), "cell", "left").select(
            F.struct(*[c for c in cells.columns if c not in ("cell", "n")]).alias("_cell"), F.coalesce("component", "cell").alias("component"), "n"
        )
        named = written(named, "cells")
    scratch.release(named)
    y, x = _cells(radius_m, F.col(lat), F.col(lon))
    rows = obs.withColumns({"_y": y, "_x": x})
    rows = rows.withColumn("_cell", F.struct(*apart, F.col("_y").alias("y"), F.col("_x").alias("x"))).drop("_y", "_x")
    return join_sized(rows, named, "_cell", "n").drop("_cell", "n")


class Places:
    """Members of one component by grid cell: distinct (lat, lon, owner) with the largest pixel of each."""

    def __init__(self, radius_m: float):
        self.step = radius_m / METRES * 1.001
        self.cells: dict[tuple[int, int], dict[tuple[float, float, int], float]] = {}
        self.arrays: dict[tuple[int, int], np.ndarray] = {}

    def add(self, lat: float, lon: float, owner: int, pixel: float) -> None:
        at = math.floor(lat / self.step), math.floor(lon / self.step)
        held = self.cells.setdefault(at, {})
        if held.get((lat, lon, owner), -1.0) < pixel:
            held[lat, lon, owner] = pixel
            self.arrays.pop(at, None)

    def around(self, lat: float, lon: float) -> np.ndarray:
        """(lat, lon, owner, pixel) of the members that can be within the radius."""
        y, x = math.floor(lat / self.step), math.floor(lon / self.step)
        wide = math.ceil(1 / max(0.05, math.cos(math.radians(min(90.0, abs(lat) + 2 * self.step)))))
        found = []
        for at in ((y + dy, x + dx) for dy in (-1, 0, 1) for dx in range(-wide, wide + 1)):
            if at in self.cells:
                if at not in self.arrays:
                    held = self.cells[at]
                    self.arrays[at] = np.array([(*k, v) for k, v in held.items()])
                found.append(self.arrays[at])
        return np.concatenate(found) if found else np.zeros((0, 4))


def _metres(lat: float, lon: float, lats, lons):
    half = (
        np.sin(np.radians(lats - lat) / 2) ** 2
        + math.cos(math.radians(lat)) * np.cos(np.radians(lats)) * np.sin(np.radians(lons - lon) / 2) ** 2
    )
    return 2 * EARTH_M * np.arcsin(np.minimum(1.0, np.sqrt(half)))


class Former:
    """The sequential rule over one component; rows come in order of (us, key)."""

    def __init__(self, p: FormationParams, search_m: float):
        self.p = p
        self.places = Places(search_m)
        self.anchors: list[str] = []
        self.numbers: dict[str, int] = {}
        self.names: list[str] = []
        self.sums: list[list[float]] = []

    def source(self, anchor: str) -> int:
        if anchor not in self.numbers:
            self.numbers[anchor] = len(self.anchors)
            self.anchors.append(anchor)
            self.names.append(hashlib.sha1(anchor.encode()).hexdigest())
            self.sums.append([0.0, 0.0, 0])
        return self.numbers[anchor]

    def seed(self, anchor: str, lat: float, lon: float, pixel: float, sums: tuple[float, float, int]) -> None:
        """A member of a source that was formed before, with the sums of its source."""
        source = self.source(anchor)
        self.sums[source] = list(sums)
        self.places.add(lat, lon, source, pixel)

    def place(self, key: str, lat: float, lon: float, pixel: float) -> tuple[str, list[tuple[str, float]], int]:
        """(anchor of the source, sources it could have joined with their distances, rejections by extent)."""
        p = self.p
        near = self.places.around(lat, lon)
        d = _metres(lat, lon, near[:, 0], near[:, 1])
        reach = np.maximum(p.radius_m, p.pixel_factor * np.maximum(pixel, near[:, 3])) if p.pixel_aware else p.radius_m
        hit = d <= reach
        owners, d = near[hit, 2].astype(int), d[hit]
        valid, rejected = [], 0
        for source in np.unique(owners).tolist():
            a, o, n = self.sums[source]
            if _metres(lat, lon, a / n, o / n) <= p.extent_m:
                valid.append((float(d[owners == source].min()), self.names[source][:10], source))
            else:
                rejected += 1
        source = min(valid)[2] if valid else self.source(key)
        total = self.sums[source]
        total[0] += lat
        total[1] += lon
        total[2] += 1
        self.places.add(lat, lon, source, pixel)
        return self.anchors[source], [(self.anchors[x], m) for m, _, x in sorted(valid)], rejected


FORMED = pa.schema(
    [
        ("key", pa.string()), ("us", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("pixel", pa.float64()),
        ("anchor", pa.string()), ("valid", pa.list_(pa.struct([("anchor", pa.string()), ("metres", pa.float64())]))),
        ("extent_rejections", pa.int32()),
    ]
)
FORMED_SQL = (
    "key string, us long, lat double, lon double, pixel double, anchor string, "
    "valid array<struct<anchor: string, metres: double>>, extent_rejections int"
)


def assign_in_order(rows: Iterable[dict], p: FormationParams, search_m: float):
    """The rule over rows of (component, within if there, seeds first, us, key); yields rows of ``FORMED``."""
    part, former = None, None
    for r in rows:
        if (r["component"], r.get("within")) != part:
            part, former = (r["component"], r.get("within")), Former(p, search_m)
        if r["seed"] is not None:
            s = r["seed"]
            former.seed(s["anchor"], r["lat"], r["lon"], r["pixel"], (s["lat_sum"], s["lon_sum"], s["n"]))
            continue
        anchor, valid, rejected = former.place(r["key"], r["lat"], r["lon"], r["pixel"])
        yield {
            "key": r["key"], "us": r["us"], "lat": r["lat"], "lon": r["lon"], "pixel": r["pixel"], "anchor": anchor,
            "valid": [{"anchor": a, "metres": m} for a, m in valid] if len(valid) > 1 else [], "extent_rejections": rejected,
            "within": r.get("within"),
        }


SEED = "struct<anchor: string, lat_sum: double, lon_sum: double, n: bigint>"


def assign(obs: DataFrame, key: str, ts: str, p: FormationParams = FormationParams(), lat: str = "lat", lon: str = "lon", pixel: str | None = None, state: DataFrame | None = None, within: str | None = None) -> DataFrame:
    """Rows of ``FORMED`` for every observation: its source by the key of the first member.

    ``key`` is a string, unique per observation (the physical key).  ``pixel`` is
    the larger side of its pixel in metres.  ``state`` is what :func:`state_of` kept
    of earlier observations, which come before all of ``obs``.  ``within`` names a
    string column without nulls, given back, whose values form sources of their own.
    """
    apart = [F.col(within).alias("within")] if within else []
    rows = obs.select(
        *apart,
        F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(lat).alias("lat"), F.col(lon).alias("lon"),
        F.coalesce(F.col(pixel), F.lit(0.0)).cast("double").alias("pixel") if pixel else F.lit(0.0).alias("pixel"),
        F.lit(None).cast(SEED).alias("seed"),
    )
    if state is not None:
        seeds = state.select(
            *(["within"] if within else []),
            F.lit("").alias("key"), F.lit(-(1 << 62)).cast("long").alias("us"), "lat", "lon", "pixel",
            F.struct("anchor", "lat_sum", "lon_sum", "n").alias("seed"),
        )
        rows = rows.unionByName(seeds)
    search = p.radius_m
    if p.pixel_aware:
        search = max(search, p.pixel_factor * (rows.agg(F.max("pixel")).first()[0] or 0.0))
    dealt = (
        _with_components(rows, search, "lat", "lon", "within" if within else None)
        .repartition("component")
        .sortWithinPartitions("component", *(["within"] if within else []), F.col("seed").isNull(), "us", "key")
        .select("component", *(["within"] if within else []), "seed", "key", "us", "lat", "lon", "pixel")
    )
    schema = FORMED.append(pa.field("within", pa.string())) if within else FORMED

    def run(batches):
        stream = (r for batch in batches for r in batch.to_pylist())
        held = []
        for r in assign_in_order(stream, p, search):
            held.append(r)
            if len(held) == 4096:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return dealt.mapInArrow(run, FORMED_SQL + (", within string" if within else ""))


def state_of(formed: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """What a later call of :func:`assign` needs: distinct members with their source's sums and last time."""
    apart = ["within"] if "within" in formed.columns else []
    members = formed.groupBy(*apart, "anchor", "lat", "lon").agg(F.max("pixel").alias("pixel"))
    sums = formed.groupBy("anchor").agg(
        F.sum("lat").alias("lat_sum"), F.sum("lon").alias("lon_sum"), F.count("*").alias("n"), F.max("us").alias("last_us")
    )
    if before is not None:
        members = members.unionByName(before.select(*apart, "anchor", "lat", "lon", "pixel")).groupBy(*apart, "anchor", "lat", "lon").agg(F.max("pixel").alias("pixel"))
        old = before.select("anchor", "lat_sum", "lon_sum", "n", "last_us").distinct()
        sums = sums.unionByName(old).groupBy("anchor").agg(
            F.sum("lat_sum").alias("lat_sum"), F.sum("lon_sum").alias("lon_sum"), F.sum("n").alias("n"), F.max("last_us").alias("last_us")
        )
    return members.join(sums, "anchor")


def form_sources(obs: DataFrame, key: str, ts: str, p: FormationParams = FormationParams(), lat: str = "lat", lon: str = "lon", pixel: str | None = None, within: str | None = None) -> DataFrame:
    """(key, source_id, ambiguous, extent_rejections) of every observation.

    A source's id is ``SRC-`` and ten hex digits of its first member's key, more
    where two sources would share them (X28).
    """
    formed = written(assign(obs, key, ts, p, lat, lon, pixel, within=within), "formed")
    return named_sources(formed).select(F.col("key").alias(key), "source_id", "ambiguous", "extent_rejections")


def named_sources(formed: DataFrame) -> DataFrame:
    """``formed``, a written table, with source_id and ambiguous (several sources could have been joined)."""
    ids = source_ids(formed.where("key = anchor").select("anchor", "us"), "us")
    sizes = formed.groupBy("anchor").agg(F.count("*").alias("_n"))
    named = written(ids.join(sizes, "anchor"), "ids")
    return join_sized(formed, named, "anchor", "_n").drop("_n").withColumn("ambiguous", F.size("valid") > 1)


def source_ids(anchors: DataFrame, *order: str) -> DataFrame:
    """(anchor, source_id): ten hex digits; an anchor whose digits an earlier one has gets four more, and again.

    Earlier is by ``order`` and then the anchor.
    """
    rest = written(anchors.select("anchor", *order, F.sha1("anchor").alias("_h")), "anchors")
    found = []
    for digits in range(10, 41, 4):
        digest = F.substring("_h", 1, digits)
        first = F.row_number().over(Window.partitionBy(digest).orderBy(*order, "anchor")) == 1
        ranked = written(rest.withColumns({"_id": F.concat(F.lit("SRC-"), digest), "_first": first}), "ids")
        found.append(ranked.where("_first").select("anchor", F.col("_id").alias("source_id")))
        drop(rest)
        rest = ranked.where("not _first").drop("_id", "_first")
        if rest.isEmpty():
            break
    else:
        raise ValueError("two sources share all digits of their keys")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def ambiguities(named: DataFrame) -> DataFrame:
    """(key, assigned, source_id, metres): every source that an ambiguous observation could have joined."""
    ids = named.where("key = anchor").select("anchor", "source_id")
    each = named.where("ambiguous").select("key", F.col("source_id").alias("assigned"), F.explode("valid").alias("c"))
    each = each.select("key", "assigned", F.col("c.anchor").alias("anchor"), F.round("c.metres", 1).alias("metres"))
    return each.join(ids, "anchor").select("key", "assigned", "source_id", "metres")


def diagnostics(named: DataFrame, p: FormationParams = FormationParams()) -> DataFrame:
    """One row of counts over a formation (A41): observations, sources, events, singletons, ambiguity, rejections."""
    timed = named.select("source_id", "key", "ambiguous", "extent_rejections", F.timestamp_micros("us").alias("ts"))
    by_source = sessionize(timed, "source_id", "ts", ["key"], p.gap_hours).groupBy("source_id").agg(
        F.count("*").alias("n"), F.max("session").alias("events"), F.count_if("ambiguous").alias("ambiguous"),
        F.sum("extent_rejections").alias("rejections"),
    )
    return by_source.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_observations"),
        F.count("*").alias("n_sources"),
        F.coalesce(F.sum("events"), F.lit(0)).cast("long").alias("n_events"),
        F.try_divide(F.count_if(F.col("n") == 1), F.count("*")).alias("singleton_source_fraction"),
        F.coalesce(F.max("events"), F.lit(0)).cast("long").alias("events_per_source_max"),
        F.coalesce(F.sum("ambiguous"), F.lit(0)).alias("n_ambiguous_assignments"),
        F.coalesce(F.sum("rejections"), F.lit(0)).alias("extent_cap_rejections"),
        F.count_if(F.length("source_id") > 14).alias("n_source_id_collisions"),
    )


def source_table(obs: DataFrame, source: str = "source_id", lat: str = "lat", lon: str = "lon", ts: str = "ts") -> DataFrame:
    """n, centroid, bounding box, extent (farthest member from the centroid), first and last."""
    base = obs.groupBy(source).agg(
        F.count("*").alias("n"),
        F.avg(lat).alias("centroid_lat"),
        F.avg(lon).alias("centroid_lon"),
        F.min(lat).alias("lat_min"), F.max(lat).alias("lat_max"),
        F.min(lon).alias("lon_min"), F.max(lon).alias("lon_max"),
        F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"),
    )
    far = obs.join(base.select(source, "centroid_lat", "centroid_lon"), source).groupBy(source).agg(
        F.max(haversine(F.col(lat), F.col(lon), F.col("centroid_lat"), F.col("centroid_lon"))).alias("extent_m")
    )
    return base.join(far, source)


def lead_clusters(obs: DataFrame, key: str, ts: str, radius_km: float = 0.375, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(key, leader): each point joins the first earlier leader within the radius of it.

    Leaders keep their place, so a component is not one cluster, and all rows of one
    place have one leader: that of the first.  So the rule runs over places in order of
    their first rows, per component, in a stream that holds its leaders, found by cell.
    """
    rows = obs.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    first = rows.groupBy("lat", "lon").agg(F.min(F.struct("us", "key")).alias("_f"))
    first = written(first.select(F.col("_f.key").alias("key"), F.col("_f.us").alias("us"), "lat", "lon"), "places")
    dealt = (
        _with_components(first, radius_km * 1000, "lat", "lon")
        .repartition("component").sortWithinPartitions("component", "us", "key").select("component", "key", "lat", "lon")
    )

    def run(batches):
        part, places, leaders = None, None, []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["component"] != part:
                    part, places, leaders = r["component"], Places(radius_km * 1000), []
                near = places.around(r["lat"], r["lon"])
                hit = near[_metres(r["lat"], r["lon"], near[:, 0], near[:, 1]) <= radius_km * 1000, 2]
                if not len(hit):
                    places.add(r["lat"], r["lon"], len(leaders), 0.0)
                    leaders.append(r["key"])
                out.append({"lat": r["lat"], "lon": r["lon"], "leader": leaders[int(hit.min())] if len(hit) else r["key"]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("lat", pa.float64()), ("lon", pa.float64()), ("leader", pa.string())]))

    led = written(dealt.mapInArrow(run, "lat double, lon double, leader string"), "led")
    return rows.join(led, ["lat", "lon"]).select(F.col("key").alias(key), "leader")
