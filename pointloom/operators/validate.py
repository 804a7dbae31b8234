"""Validation of raw observations into typed ones and two ledgers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions import fields


@dataclass(frozen=True)
class ValidationParams:
    most_future_hours: float = 1.0
    earliest: str = "2000-01-01 00:00:00"
    suspicious_frp: float = 5000.0
    least_brightness: float = 150.0
    most_brightness: float = 550.0
    most_excluded: float = 0.02


def fatal_reason(
    malformed: Column, lat_raw: Column, lon_raw: Column, date: Column, ts: Column, reference: Column,
    p: ValidationParams = ValidationParams(),
) -> Column:
    """The first fatal reason of a row in the fixed order, or null (P02); repeats come later."""
    lat, lon = fields.number(lat_raw), fields.number(lon_raw)
    blank = fields.blank_to_null(lat_raw).isNull() | fields.blank_to_null(lon_raw).isNull()
    off = lat["bad"] | lon["bad"] | ~lat["value"].between(-90, 90) | ~lon["value"].between(-180, 180)
    latest = F.unix_micros(reference) + int(p.most_future_hours * 3.6e9)
    return (
        F.when(F.coalesce(malformed, F.lit(False)), "MALFORMED_ROW")
        .when(blank, "MISSING_COORDINATES")
        .when(off, "INVALID_COORDINATES")
        .when(fields.blank_to_null(date).isNull(), "MISSING_DATE")
        .when(ts.isNull(), "UNPARSEABLE_TIMESTAMP")
        .when(F.unix_micros(ts) > latest, "TIMESTAMP_IN_FUTURE")
        .when(ts < F.lit(p.earliest).cast("timestamp"), "TIMESTAMP_BEFORE_MISSION")
    )


def mark_repeats(df: DataFrame, id_col: str, order_col: str, reason_col: str = "reason") -> DataFrame:
    """Rows without a reason that repeat an earlier id get DUPLICATE_EXACT."""
    same = Window.partitionBy(id_col, F.col(reason_col).isNull()).orderBy(order_col)
    repeat = F.col(reason_col).isNull() & (F.row_number().over(same) > 1)
    return df.withColumn("_first", F.first(order_col).over(same)).withColumns(
        {
            "duplicate_of": F.when(repeat, F.col("_first")),
            reason_col: F.when(repeat, "DUPLICATE_EXACT").otherwise(F.col(reason_col)),
        }
    ).drop("_first")


def field_flags(
    frp_raw: Column, brightness_raw: Column, confidence: Column, daynight: Column, instrument: Column,
    p: ValidationParams = ValidationParams(),
) -> Column:
    """Array of flag names of one row; values that a flag voids are nulled by the projections."""
    frp, bright = fields.number(frp_raw), fields.number(brightness_raw)
    outside = ~bright["value"].between(p.least_brightness, p.most_brightness)
    status = confidence["status"]
    flags = [
        (frp["bad"], "FRP_INVALID"),
        (frp["value"] < 0, "FRP_NEGATIVE"),
        (frp["value"] == 0, "FRP_ZERO"),
        (frp["value"] > p.suspicious_frp, "FRP_SUSPICIOUS"),
        (bright["bad"], "BRIGHTNESS_INVALID"),
        (outside, "BRIGHTNESS_OUT_OF_RANGE"),
        (status == "invalid", "CONFIDENCE_INVALID"),
        (status == "semantics_mismatch", "CONFIDENCE_SEMANTICS_MISMATCH"),
        (status == "semantics_unknown", "CONFIDENCE_SEMANTICS_UNKNOWN"),
        (~F.upper(fields.blank_to_null(daynight)).isin("D", "N"), "DAYNIGHT_INVALID"),
        (instrument.isNull(), "SENSOR_UNKNOWN"),
    ]
    return F.array_compact(F.array(*[F.when(test, name) for test, name in flags]))


def kept_frp(frp_raw: Column) -> Column:
    """FRP after the field rules: bad and negative values are unknown, zero stays zero."""
    frp = fields.number(frp_raw)
    return F.when(frp["value"] >= 0, frp["value"])


def kept_brightness(raw: Column, p: ValidationParams = ValidationParams()) -> Column:
    value = fields.number(raw)["value"]
    return F.when(value.between(p.least_brightness, p.most_brightness), value)


def validate(raw: DataFrame, reference: Column, p: ValidationParams = ValidationParams()) -> DataFrame:
    """Typed rows of a raw CSV scan with ``reason`` (null: valid) and ``flags``.

    ``raw`` is what :mod:`pointloom.sources.observations` reads: string columns,
    row_number, malformed, has_ti4, has_t31, has_brightness, data_mode, source_file.
    """
    lat, lon = fields.number(F.col("latitude"))["value"], fields.number(F.col("longitude"))["value"]
    sensor = fields.instrument(
        F.col("instrument"), F.col("satellite"), F.col("has_ti4"), F.col("has_t31"), F.col("has_brightness")
    )
    bright = F.when(F.col("has_ti4"), F.col("bright_ti4")).otherwise(F.col("brightness"))
    second = F.when(F.col("has_ti4"), F.col("bright_ti5")).otherwise(F.col("bright_t31"))
    typed = raw.withColumns(
        {
            "timestamp_utc": fields.acquired(F.col("acq_date"), F.col("acq_time")),
            "instrument": sensor,
            "brightness_raw": bright,
            "secondary_raw": second,
        }
    )
    conf = fields.confidence(F.col("confidence"), F.col("instrument"))
    typed = typed.withColumns({"_conf": conf, "lat": lat, "lon": lon}).withColumns(
        {
            "reason": fatal_reason(
                F.col("malformed"), F.col("latitude"), F.col("longitude"), F.col("acq_date"),
                F.col("timestamp_utc"), reference, p,
            ),
            "observation_id": fields.observation_id(
                F.col("data_mode"), F.col("instrument"), fields.blank_to_null(F.col("satellite")),
                F.col("acq_date"), F.lpad("acq_time", 4, "0"), F.col("lat"), F.col("lon"),
            ),
        }
    )
    typed = mark_repeats(typed, "observation_id", "row_number")
    dn = F.upper(fields.blank_to_null(F.col("daynight")))
    return typed.select(
        "row_number", "source_file", "reason", "duplicate_of", "observation_id",
        "lat", "lon", "timestamp_utc", "data_mode",
        fields.blank_to_null(F.col("satellite")).alias("satellite"), "instrument",
        kept_frp(F.col("frp")).alias("frp_mw"),
        kept_brightness(F.col("brightness_raw"), p).alias("brightness_k"),
        kept_brightness(F.col("secondary_raw"), p).alias("brightness_k_secondary"),
        F.col("_conf.class").alias("confidence_class"), F.col("_conf.pct").alias("confidence_pct"),
        F.col("_conf.semantics").alias("confidence_semantics"),
        F.when(dn.isin("D", "N"), dn).alias("day_night"),
        fields.number(F.col("scan"))["value"].alias("scan_km"),
        fields.number(F.col("track"))["value"].alias("track_km"),
        fields.blank_to_null(F.col("version")).alias("version_raw"),
        field_flags(
            F.col("frp"), F.col("brightness_raw"), F.col("_conf"), F.col("daynight"), F.col("instrument"), p
        ).alias("flags"),
        fields.physical_key(F.col("instrument"), F.col("satellite"), F.col("timestamp_utc"), F.col("lat"), F.col("lon")).alias("physical_key"),
    )


def exclusion_counts(validated: DataFrame) -> DataFrame:
    """Rows by fatal reason."""
    return validated.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def review_status(validated: DataFrame, p: ValidationParams = ValidationParams()) -> DataFrame:
    """EMPTY, REVIEW_EXCLUSIONS or OK per source file with the conserved counts."""
    by_file = validated.groupBy("source_file").agg(
        F.count("*").alias("n_input"), F.count_if(F.col("reason").isNotNull()).alias("n_excluded")
    )
    share = F.col("n_excluded") / F.col("n_input")
    status = F.when(F.col("n_input") == 0, "EMPTY").when(share > p.most_excluded, "REVIEW_EXCLUSIONS").otherwise("OK")
    return by_file.withColumns({"n_valid": F.col("n_input") - F.col("n_excluded"), "status": status})


def flag_rows(validated: DataFrame) -> DataFrame:
    """One row per flag of a valid observation."""
    return validated.where("reason IS NULL").select("observation_id", F.explode("flags").alias("flag"))
