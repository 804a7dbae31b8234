"""Rows of the client: projections, filters, re-checks and formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.geo import decimals
from pointloom.operators.activity import POINTS, ScoreParams
from pointloom.operators.geojoin import grid_join

#: Names of satellites, of streams, and of tiers.
SATELLITE_LABELS = {"VIIRS N": "Suomi NPP", "VIIRS N20": "NOAA-20", "VIIRS N21": "NOAA-21"}
STREAM_LABELS = {"VIIRS:N": "S-NPP (VIIRS:N)", "VIIRS:N20": "NOAA-20 (VIIRS:N20)", "VIIRS:N21": "NOAA-21 (VIIRS:N21)"}
TIERS = {"HIGH": "high", "MEDIUM": "medium", "LOW": "low"}
CATEGORY_TYPES = {"STEEL_METAL": "steel", "THERMAL_POWER": "thermal_power", "LNG_GAS": "lng_gas"}
def named(value: Column, names: dict[str, str]) -> Column:
    """The name of a key, or the key itself."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.element_at(table, value), value)


def pretty(key: Column) -> Column:
    """A key in lower case with spaces."""
    return F.lower(F.replace(F.coalesce(key, F.lit("")), F.lit("_"), F.lit(" ")))


def valid_point(lat: Column, lon: Column) -> Column:
    """On the globe, a number, and not exactly (0, 0)."""
    number = ~F.isnan(lat) & ~F.isnan(lon)
    return F.coalesce(number & lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0)), F.lit(False))


def ranked(points: Column) -> Column:
    """Map points as (rank, point) rows: the rank is the place in the list, from 1."""
    return F.inline(F.transform(points, lambda p, i: F.struct((i + 1).alias("rank"), p.alias("point"))))


def ui_events(points: DataFrame, sources: DataFrame, facilities: DataFrame) -> DataFrame:
    """One row for each valid map point: id, rank, place, class, severity, facility.

    points: source_id, rank, lat, lon, tier, pihs.  sources: source_id and what is
    known of it: s_lat, s_lon, first_seen, last_seen, nearest_facility,
    facility_category, facility_km.  facilities: facility_id, facility_name; of
    equal names (trimmed, any case) the one with the largest id counts.
    """
    named_once = facilities.groupBy(F.lower(F.trim("facility_name")).alias("_name")).agg(F.max("facility_id").alias("facility_id"))
    joined = points.join(sources, "source_id", "left").withColumn("_name", F.lower(F.trim("nearest_facility")))
    joined = joined.join(named_once, "_name", "left")
    lat, lon = F.coalesce("s_lat", "lat"), F.coalesce("s_lon", "lon")
    kind = F.element_at(F.create_map(*[F.lit(x) for p in CATEGORY_TYPES.items() for x in p]), F.col("facility_category"))
    tier = F.element_at(F.create_map(*[F.lit(x) for p in TIERS.items() for x in p]), F.upper("tier"))
    place = F.when(F.col("nearest_facility").isNotNull(), F.concat(F.lit("Near "), "nearest_facility")).otherwise(coordinate(lat, lon))
    return joined.where(F.col("source_id").isNotNull() & valid_point(lat, lon)).select(
        F.col("source_id").alias("id"), "rank", lat.alias("latitude"), lon.alias("longitude"), place.alias("location_name"),
        F.col("first_seen").alias("start_utc"), F.col("last_seen").alias("end_utc"),
        F.when(kind.isNotNull(), "industrial").otherwise("unknown").alias("class_key"), kind.alias("industrial_type"),
        pretty(F.col("facility_category")).alias("category_label"), tier.alias("severity"),
        "facility_id", F.col("facility_km").alias("facility_distance_km"), (F.col("pihs") == F.lit(True)).alias("persistent"),
        F.when(F.col("s_lat").isNotNull(), "real_detailed").otherwise("real_ranked").alias("kind"),
    )


def ui_facilities(facilities: DataFrame, type_key: Column) -> DataFrame:
    """Facilities with an id and a valid place; a blank name is the id, a blank type is Other Industrial."""
    full = lambda c: F.nullif(F.col(c), F.lit(""))
    return facilities.where(full("id").isNotNull() & valid_point(F.col("lat"), F.col("lon"))).select(
        "id", F.coalesce(full("name"), F.col("id")).alias("name"), F.coalesce(full("type"), F.lit("Other Industrial")).alias("type"),
        F.coalesce(type_key, F.lit("other")).alias("type_key"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
    )


def alerts(events: DataFrame, tiers: Sequence[str] = ("high", "medium")) -> DataFrame:
    """Events whose severity raises an alert."""
    return events.where(F.col("severity").isin(*tiers))


def in_state(rows: DataFrame, state: str | None, column: str = "state") -> DataFrame:
    """Rows of one state, or all."""
    return rows if state is None else rows.where(F.col(column) == state)


def facility_list(facilities: DataFrame, types: Sequence[str], text: str) -> DataFrame:
    """Facilities of the given types (all if none is given) whose name or type holds ``text`` in any case (P25)."""
    hay = F.lower(F.concat_ws(" ", "name", "type"))
    kept = facilities.where(F.contains(hay, F.lit(text.strip().lower())))
    return kept.where(F.col("type_key").isin(*types)) if types else kept


def out_of_time(events: DataFrame, in_time: DataFrame, layers: Column, key: str = "id") -> DataFrame:
    """Events that match the layers and not the time."""
    return events.where(layers).join(in_time.select(key), key, "left_anti")


def nearby_sources(facilities: DataFrame, events: DataFrame, radius_km: float = 5.0) -> DataFrame:
    """Each facility with its events within the radius, by rank.

    A facility has as many as lie around it; (rank, event, km) stay numbers.
    """
    f = facilities.select("facility_id", F.col("lat").alias("_flat"), F.col("lon").alias("_flon"))
    e = events.select(F.col("id").alias("event"), "rank", F.col("latitude").alias("_elat"), F.col("longitude").alias("_elon"))
    pairs = grid_join(f, e, radius_km, ("_flat", "_flon"), ("_elat", "_elon"))
    near = F.struct("rank", "event", F.round("distance_km", 4).alias("km"))
    lists = pairs.groupBy("facility_id").agg(F.sort_array(F.collect_list(near)).alias("near"))
    return facilities.join(lists, "facility_id", "left").withColumn("near", F.coalesce("near", F.array().cast(lists.schema["near"].dataType)))


def rule_checks(sources: DataFrame, key: str = "source_id", p: ScoreParams = ScoreParams()) -> DataFrame:
    """(key, code, value, met, points) of each rule, from the source's own values."""
    enough = F.col("detection_count") >= p.least_detections
    tests = [
        ("PERSISTENT_ACTIVITY", "active_days", lambda v: v >= p.persistent_days),
        ("MULTI_DAY_ACTIVITY", "active_days", lambda v: v >= p.multi_days),
        ("NIGHT_DOMINANT", "night_frac", lambda v: (v >= p.night_share) & enough),
        ("REPEATED_EVENTS", "event_count", lambda v: v >= p.least_events),
        ("SPATIALLY_COMPACT", "extent_m", lambda v: (v <= p.compact_m) & enough),
    ]
    each = []
    for code, name, test in tests:
        value = F.col(name).cast("double")
        met = F.coalesce(test(value), F.lit(False))
        each.append(F.struct(F.lit(code).alias("code"), value.alias("value"), met.alias("met"), F.lit(POINTS[code]).alias("points")))
    return sources.select(key, F.inline(F.array(*each)))


def rules_agree(sources: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, score, flag, agrees): recomputed rules against the stored rule_score and rule_flag."""
    needed = ("PERSISTENT_ACTIVITY", "NIGHT_DOMINANT", "SPATIALLY_COMPACT")
    again = rule_checks(sources, key).groupBy(key).agg(
        F.coalesce(F.sum(F.when(F.col("met"), F.col("points"))), F.lit(0)).alias("score"),
        (F.count_if(F.col("met") & F.col("code").isin(*needed)) == len(needed)).alias("flag"),
    )
    return sources.join(again, key).select(
        key, "score", "flag", ((F.col("score") == F.col("rule_score")) & (F.col("flag") == F.col("rule_flag"))).alias("agrees")
    )


def alert_sum(p: ScoreParams = ScoreParams()) -> tuple[Column, Column]:
    """(sum of the weighted components ``part_*``, whether it is the stored alert_score within 0.0006)."""
    total = F.lit(0.0)
    for name, weight in p.weights.items():
        total = total + F.coalesce(F.col(f"part_{name}"), F.lit(0.0)) * weight
    return total, F.abs(total - F.col("alert_score")) < 0.0006


def thermal_ratios(frp_max: Column, frp_mean: Column, night: Column) -> dict[str, Column]:
    """Peak over mean (null without a mean) and the share by day."""
    return {"frp_ratio": F.try_divide(frp_max, frp_mean), "day_share": 1 - night}


def coordinate(lat: Column, lon: Column) -> Column:
    """``21.1234°N, 78.5000°E``."""
    half = lambda x, plus, minus: F.concat(decimals(F.abs(x), 4), F.when(x < 0, f"°{minus}").otherwise(f"°{plus}"))
    return F.concat_ws(", ", half(lat, "N", "S"), half(lon, "E", "W"))


def utc_text(ts: Column) -> Column:
    """``2024-01-31 07:05 UTC``, or a dash."""
    return F.coalesce(F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit(" UTC")), F.lit("—"))


def age_text(ts: Column, now: Column) -> Column:
    """How long ago in the largest whole unit: minutes, hours, days."""
    minutes = F.floor((F.unix_micros(now) - F.unix_micros(ts)) / 60_000_000).cast("long")
    return (
        F.when(ts.isNull(), "—").when(minutes < 1, "just now")
        .when(minutes < 60, F.format_string("%d min ago", minutes))
        .when(minutes < 1440, F.format_string("%d h ago", F.floor(minutes / 60).cast("long")))
        .otherwise(F.format_string("%d d ago", F.floor(minutes / 1440).cast("long")))
    )


def utc_input(text: Column) -> Column:
    """A moment typed as ``YYYY-MM-DD``, with ``HH:MM`` or ``HH:MM:SS`` after a space or T, and Z or nothing; else null."""
    clean = F.regexp_replace(F.upper(F.trim(text)), r"\s*Z$", "")
    plain = F.when(clean.rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2})?)?$"), F.replace(clean, F.lit("T"), F.lit(" ")))
    return plain.try_cast("timestamp")


def in_order_of_offer(candidates: DataFrame, key: str) -> DataFrame:
    """Candidates with ``place``: those with a reference first, then competing ones, then near ones, then by id."""
    blank = F.coalesce(F.trim("reference"), F.lit("")) == ""
    order = Window.partitionBy("group").orderBy(blank, F.desc("competing"), "distance_km", key)
    return candidates.withColumn("place", F.row_number().over(order))


def best_items(items: DataFrame, source: str, independent: str, key: str, most: int = 4) -> DataFrame:
    """The first ``most`` evidence items of each source, independent ones first."""
    order = Window.partitionBy(source).orderBy(F.desc(independent), key)
    return items.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


