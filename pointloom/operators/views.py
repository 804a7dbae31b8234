"""Parameterised views of ranked sources."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layers:
    classes: tuple[str, ...] = ("industrial", "agricultural", "natural", "unknown")
    severities: tuple[str, ...] = ("high", "medium")
    types: tuple[str, ...] = ("refinery", "petrochemical", "thermal_power", "steel", "mining", "lng_gas", "other")
    behaviours: tuple[str, ...] = field(default_factory=tuple)


def layer_test(klass: Column, severity: Column, kind: Column, behaviour: Column, persistent: Column, f: Layers) -> Column:
    """OR within a group, AND across groups; an unknown severity counts as low."""
    cls = F.coalesce(klass, F.lit("unknown"))
    test = cls.isin(*f.classes) & F.coalesce(severity, F.lit("low")).isin(*f.severities)
    test = test & ((cls != "industrial") | F.coalesce(kind, F.lit("other")).isin(*f.types))
    if f.behaviours:
        named = [b for b in f.behaviours if b != "persistent"]
        any_of = F.coalesce(behaviour.isin(*named), F.lit(False)) if named else F.lit(False)
        if "persistent" in f.behaviours:
            any_of = any_of | F.coalesce(persistent, F.lit(False))
        test = test & any_of
    return test


def time_test(times: Column, mode: str, start: Column | None = None, end: Column | None = None, since: Column | None = None) -> Column:
    """A source matches if any of its times lies in range; one without times only if no range is set."""
    empty = F.coalesce(F.size(times), F.lit(0)) == 0
    if mode == "historical":
        low = (lambda t: t >= start) if start is not None else (lambda t: F.lit(True))
        high = (lambda t: t <= end) if end is not None else (lambda t: F.lit(True))
        hit = F.exists(times, lambda t: low(t) & high(t))
        if start is not None and end is not None:
            hit = hit & (start <= end)
        return ~empty & hit
    if since is None:
        return F.lit(True)
    return ~empty & F.exists(times, lambda t: t >= since)


def count_by(df: DataFrame, key: str) -> DataFrame:
    """Rows by key; null keys are not counted."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))


def alert_queue(df: DataFrame) -> DataFrame:
    """New first, then priority, severity and rank, nulls last (O12); columns is_new, priority, severity, rank."""
    order = {"high": 3, "medium": 2, "low": 1}
    rank_of = lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for p in order.items() for v in p]), c), F.lit(0))
    return df.orderBy(F.desc("is_new"), F.desc(rank_of(F.col("priority"))), F.desc(rank_of(F.col("severity"))), F.asc_nulls_last("rank"), "id")


def search(sources: DataFrame, sites: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """Exact id, then sites, then sources by rank, ``limit`` in all.

    sources: id, rank, hay.  sites: id, hay.  At least three places are kept for
    sites if there are so many; more if sources leave room.
    """
    q = query.strip().lower()
    exact = sources.where(F.lower("id") == q).select("id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("at"))
    found = sources.where((F.lower("id") != q) & F.lower("hay").contains(q))
    hits = found.orderBy("rank", "id").limit(limit).select(
        "id", F.lit(2).alias("part"), F.row_number().over(Window.orderBy("rank", "id")).cast("long").alias("at")
    )
    places = sites.where(F.lower("hay").contains(q)).orderBy("id").limit(limit).select(
        "id", F.lit(1).alias("part"), F.row_number().over(Window.orderBy("id")).cast("long").alias("at")
    )
    # at most ``limit`` rows of each part come this far
    every = exact.unionByName(places).unionByName(hits)
    counts = every.agg(F.count_if(F.col("part") == 0).alias("n0"), F.count_if(F.col("part") == 2).alias("n2"))
    room = F.greatest(F.lit(3), limit - F.col("n0") - F.col("n2"))
    kept = every.crossJoin(F.broadcast(counts)).where((F.col("part") != 1) | (F.col("at") <= room))
    order = Window.orderBy("part", "at")
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("place", "part", "id")


def feed_by_day(df: DataFrame, ts: str, key: str, most: int = 100) -> DataFrame:
    """Newest first, one row per key, ``most`` in all, grouped by day."""
    newest = df.groupBy(key).agg(F.max(ts).alias("_t"))
    top = newest.orderBy(F.desc("_t"), key).limit(most)
    return top.groupBy(F.to_date("_t").alias("day")).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct(F.col("_t"), (-F.col(key)).alias("k"))), asc=False), lambda s: -s["k"]
        ).alias("keys")
    )


def event_summary(events: DataFrame, source: str) -> DataFrame:
    """Total, longest and upper median of a source's events."""
    return events.groupBy(source).agg(
        F.count("*").alias("n_events"),
        F.sum("n").alias("n_obs"),
        F.max("hours").alias("longest_h"),
        F.expr("-percentile_disc(0.5) WITHIN GROUP (ORDER BY -n)").cast("long").alias("upper_median_n"),
    )


def latest_by(df: DataFrame, group: str, ts: str, key: str) -> DataFrame:
    """The latest row of each group; ties to the larger key."""
    return df.groupBy(group).agg(F.max_by(key, F.struct(ts, key)).alias("latest_id"), F.max(ts).alias("latest"))


def marker_union(parts: list[DataFrame], key: str) -> DataFrame:
    """Union of marker tables; the first table that has a key wins."""
    tagged = [p.withColumn("_priority", F.lit(k)) for k, p in enumerate(parts)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("_priority")
    return every.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_priority")


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page of an ordered table."""
    return df.orderBy(*order).offset(number * size).limit(size)


def live_state(status: Column, generated: Column, now: Column, stale_hours: float = 6.0) -> Column:
    """unavailable, invalid, stale or on."""
    age = (F.unix_micros(now) - F.unix_micros(generated)) / 3.6e9
    return (
        F.when(~F.coalesce(status == "OK", F.lit(False)), "unavailable")
        .when(generated.isNull(), "invalid")
        .when(age > stale_hours, "stale")
        .otherwise("on")
    )


def coordinate_query(text: Column) -> Column:
    """Struct (lat, lon) of a query like ``21.5, 78.25``, null otherwise."""
    pattern = r"^\s*(-?\d+(?:\.\d+)?)\s*[, ]\s*(-?\d+(?:\.\d+)?)\s*$"
    lat = F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("double")
    lon = F.nullif(F.regexp_extract(text, pattern, 2), F.lit("")).try_cast("double")
    good = lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(good, F.struct(lat.alias("lat"), lon.alias("lon")))
