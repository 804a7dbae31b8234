"""Parsing and keys of raw observation fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pointloom.functions import geo

#: Satellite spellings and their canonical token.
SATELLITES = {
    "NOAA-21": "N21", "NOAA21": "N21", "NOAA-20": "N20", "NOAA20": "N20",
    "SUOMI-NPP": "N", "SNPP": "N", "NPP": "N",
}
#: Confidence letters and words, and the scores that stand for them.
CONFIDENCE_WORDS = {
    "l": "low", "low": "low", "n": "nominal", "nominal": "nominal", "h": "high", "high": "high",
}
CONFIDENCE_SCORES = {30.0: "low", 70.0: "nominal", 95.0: "high"}


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for pair in table.items() for v in pair]), key)


def number(raw: Column) -> Column:
    """Struct (value, bad): blank is neither; NaN, infinities and non-numbers are bad."""
    parsed = blank_to_null(raw).try_cast("double")
    finite = parsed.isNotNull() & ~F.isnan(parsed) & (F.abs(parsed) != float("inf"))
    return F.struct(
        F.when(finite, parsed).alias("value"), (blank_to_null(raw).isNotNull() & ~finite).alias("bad")
    )


def acquired(date: Column, time: Column) -> Column:
    """Timestamp of a date and an unpadded HHMM time, null if unreadable (X11)."""
    padded = F.when(F.length(time) < 4, F.lpad(time, 4, "0")).otherwise(time)
    return F.try_to_timestamp(F.concat_ws(" ", date, padded), F.lit("yyyy-MM-dd HHmm"))


def satellite(raw: Column) -> Column:
    """Canonical satellite token, else the trimmed original, null if blank."""
    return F.coalesce(lookup(SATELLITES, F.upper(F.trim(raw))), blank_to_null(raw))


def instrument(raw: Column, name: Column, has_ti4: Column, has_t31: Column, has_brightness: Column) -> Column:
    """The instrument given, or inferred from which columns the file has."""
    return (
        F.when(blank_to_null(raw).isNotNull(), F.upper(F.trim(raw)))
        .when(has_ti4, "VIIRS")
        .when(has_t31 | (has_brightness & ~has_ti4 & name.isin("Terra", "Aqua")), "MODIS")
    )


def confidence(raw: Column, sensor: Column) -> Column:
    """Struct (class, pct, status, semantics) of a raw confidence by instrument."""
    text = F.lower(F.trim(raw))
    word = lookup(CONFIDENCE_WORDS, text)
    value = number(raw)["value"]
    kind = F.upper(F.trim(sensor))
    modis, viirs = F.coalesce(kind == "MODIS", F.lit(False)), F.coalesce(kind == "VIIRS", F.lit(False))
    scored = lookup(CONFIDENCE_SCORES, value)
    usable = value.isNotNull() & value.between(0, 100)
    band = F.when(value < 30, "low").when(value < 80, "nominal").otherwise("high")

    def as_struct(klass, pct, status, semantics) -> Column:
        return F.struct(
            (F.lit(klass) if not isinstance(klass, Column) else klass).cast("string").alias("class"),
            (F.lit(pct) if not isinstance(pct, Column) else pct).cast("double").alias("pct"),
            F.lit(status).alias("status"),
            (F.lit(semantics) if not isinstance(semantics, Column) else semantics).cast("string").alias("semantics"),
        )

    named = F.when(viirs, "VIIRS_CATEGORICAL_LNH").otherwise("CATEGORICAL_LNH_INSTRUMENT_UNSPECIFIED")
    return (
        F.when(blank_to_null(raw).isNull(), as_struct(None, None, "missing", None))
        .when(word.isNotNull() & modis, as_struct(None, None, "semantics_mismatch", "MODIS_UNEXPECTED_CATEGORICAL"))
        .when(word.isNotNull(), as_struct(word, None, "ok", named))
        .when(~F.coalesce(usable, F.lit(False)), as_struct(None, None, "invalid", None))
        .when(viirs & scored.isNotNull(), as_struct(scored, None, "ok", "VIIRS_CATEGORICAL_ENCODED_30_70_95"))
        .when(viirs, as_struct(None, None, "semantics_mismatch", "VIIRS_UNEXPECTED_NUMERIC"))
        .when(modis, as_struct(band, value, "ok", "MODIS_NATIVE_PCT"))
        .otherwise(as_struct(None, None, "semantics_unknown", None))
    )


def observation_id(mode, sensor, sat, date, time, lat, lon) -> Column:
    """``mode:instrument:satellite:date:time:lat5:lon5`` with NA for nulls."""
    or_na = lambda x: F.coalesce(x, F.lit("NA"))
    return F.concat_ws(
        ":", mode, or_na(sensor), or_na(sat), date, time, geo.decimals(lat, 5), geo.decimals(lon, 5)
    )


def physical_key(sensor: Column, sat: Column, ts: Column, lat: Column, lon: Column) -> Column:
    """Identity of a detection whatever file it came in: minute and five decimals."""
    from pointloom.functions.geo import coord5

    return F.concat_ws(
        "|",
        F.lit("PHYS"),
        F.upper(F.coalesce(sensor, F.lit("NA"))),
        F.coalesce(satellite(sat), F.lit("NA")),
        F.date_format(ts, "yyyyMMdd'T'HHmm"),
        coord5(lat),
        coord5(lon),
    )


def sensor_label(sensor: Column, sat: Column) -> Column:
    """Instrument and satellite, null if both are missing."""
    return F.nullif(F.concat_ws(" ", sensor, sat), F.lit(""))


def season(month: Column) -> Column:
    """Season of a month."""
    return (
        F.when(month.isin(1, 2), "winter")
        .when(month.isin(3, 4, 5), "pre-monsoon")
        .when(month.isin(6, 7, 8, 9), "monsoon")
        .otherwise("post-monsoon")
    )


def tier(n_events: Column, span_days: Column) -> Column:
    """EPISODIC, RECURRENT, PERSISTENT or OTHER from events and whole days of span."""
    return (
        F.when(n_events == 1, "EPISODIC")
        .when(n_events < 10, "RECURRENT")
        .when(F.floor(span_days) >= 90, "PERSISTENT")
        .otherwise("OTHER")
    )


def recurrence(active_days: Column, span_days: Column, least_days=5, least_span=14, transient=2) -> Column:
    """Recurrence class of a profile."""
    return (
        F.when((active_days <= transient) & (span_days <= transient + 1), "TRANSIENT")
        .when((active_days >= least_days) & (span_days >= least_span), "RECURRENT_DETECTIONS")
        .otherwise("INSUFFICIENT_TIME_BASE")
    )


def event_state(end: Column, as_of: Column, hours: float = 36.0) -> Column:
    """active while at most ``hours`` have passed since the end."""
    passed = (F.unix_micros(as_of) - F.unix_micros(end)) / 3.6e9
    return F.when(passed <= hours, "active").otherwise("archived")


def richness(*fields: Column) -> Column:
    """How many of the fields are known."""
    total = F.lit(0)
    for f in fields:
        total = total + f.isNotNull().cast("int")
    return total


def severity_key(label: Column) -> Column:
    text = F.lower(F.trim(label))
    return (
        F.when(text.isin("high", "critical"), "high")
        .when(text.isin("medium", "warning", "moderate"), "medium")
        .when(text == "low", "low")
    )


def type_key(label: Column) -> Column:
    """Industrial type of a label: the alias table first, then parts of words."""
    aliases = {
        "refinery": ["refinery", "oil refinery"],
        "petrochemical": ["petrochemical", "petrochemical facility"],
        "thermal_power": ["thermal power", "thermal power plant", "power plant", "coal power"],
        "steel": ["steel", "iron & steel", "iron and steel", "steel industry", "steel plant"],
        "mining": ["mining", "mining area", "mine", "coalfield"],
        "lng_gas": ["lng", "lng / gas", "lng/gas", "lng terminal", "gas", "gas processing"],
        "other": ["other", "other industrial", "other/unknown industrial", "industrial facility"],
    }
    parts = [
        ("refin", "refinery"), ("petro", "petrochemical"), ("power", "thermal_power"), ("steel", "steel"),
        ("min", "mining"), ("coal", "mining"), ("lng", "lng_gas"), ("gas", "lng_gas"),
    ]
    text = F.lower(F.trim(label))
    found = F.when(F.coalesce(text, F.lit("")) == "", F.lit(None).cast("string"))
    for key, names in aliases.items():
        found = found.when(text.isin(names), key)
    for part, key in parts:
        found = found.when(text.contains(part), key)
    return found.otherwise("other")


def point_problem(lat: Column, lon: Column) -> Column:
    """Why two raw coordinates are not a point, or null (P07): a word, NaN or an infinity is invalid, a blank is missing.

    ``true`` and ``false`` are no numbers, whatever the type that held them.
    """
    a, o = number(lat.cast("string")), number(lon.cast("string"))
    blank = blank_to_null(lat.cast("string")).isNull() | blank_to_null(lon.cast("string")).isNull()
    off = ~a["value"].between(-90, 90) | ~o["value"].between(-180, 180)
    return F.when(a["bad"] | o["bad"], "INVALID_COORDINATES").when(blank, "MISSING_COORDINATES").when(off, "INVALID_COORDINATES")


def available(columns: list[str], wanted: list[str]) -> list[str]:
    """The wanted columns that there are, in their order."""
    return [c for c in wanted if c in columns]


def site_name(url: Column) -> Column:
    """Host of a link without ``www.``."""
    return F.regexp_replace(F.lower(F.parse_url(url, F.lit("HOST"))), r"^www\.", "")
