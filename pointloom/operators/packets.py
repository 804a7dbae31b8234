"""Evidence packets, their checks and the feature table of sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions.geo import decimals, haversine
from pointloom.operators import relate
from pointloom.operators.research import blind_ids

#: The brightness at which a detector saturates, and how satellites are named in a mix.
SATURATION_K = 367.0
SATELLITES = (("SNPP", "N"), ("N20", "N20"), ("N21", "N21"))
METRES_PER_DEGREE = 111_320


def evidence(obs: DataFrame, source: str, ts: str, ties: Sequence[str] = ()) -> DataFrame:
    """The measures of each source's packet.

    obs: ``source``, ``ts``, sat, lat, lon, frp, ti4, conf, dn.  Gaps are between
    consecutive observations, in days; the span counts started days.
    """
    from pointloom.operators.sessions import observation_gaps

    day = F.to_date(ts)
    gaps = observation_gaps(obs, source, ts, list(ties)).groupBy(source).agg(
        F.max("gap_days").alias("max_gap_d"), F.median("gap_days").alias("median_gap_d")
    )
    months = obs.groupBy(source, F.month(ts).alias("_month")).agg(F.count("*").alias("_n"))
    modal = months.groupBy(source).agg(F.max("_n").alias("_modal"))
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    base = obs.groupBy(source).agg(
        F.count("*").alias("observation_count"),
        F.countDistinct(day).alias("active_days"),
        F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"),
        ((F.max(seconds) - F.min(seconds)) / 86400).alias("duration_days"),
        F.avg("lat").alias("centroid_lat"), F.avg("lon").alias("centroid_lon"),
        F.median("frp").alias("frp_median"), F.max("frp").alias("frp_max"),
        F.median("ti4").alias("ti4_median"), F.max("ti4").alias("ti4_max"),
        (F.count_if(F.col("ti4") >= SATURATION_K) / F.count("*")).alias("ti4_sat_frac"),
        (F.count_if(F.col("dn") == "N") / F.count("*")).alias("night_frac"),
        (F.count_if(F.col("conf") == "h") / F.count("*")).alias("conf_high_frac"),
        *[F.count_if(F.col("sat") == code).alias(f"n_obs_{name}") for name, code in SATELLITES],
    )
    centre = base.select(source, "centroid_lat", "centroid_lon")
    far = obs.join(centre, source).groupBy(source).agg(
        F.max(haversine(F.col("centroid_lat"), F.col("centroid_lon"), F.col("lat"), F.col("lon"))).alias("spatial_extent_m")
    )
    mix = F.concat_ws("+", *[F.when(F.col(f"n_obs_{name}") > 0, name) for name, _ in SATELLITES])
    return (
        base.join(modal, source).join(far, source).join(gaps, source, "left")
        .withColumns(
            {
                "span_frac": F.col("active_days") / (F.ceil("duration_days") + 1),
                "modal_month_frac": F.col("_modal") / F.col("observation_count"),
                "sat_mix": mix,
            }
        )
        .drop("_modal")
    )


def graded_counts(obs: DataFrame, source: str, product: str) -> DataFrame:
    """(source, n_sp, n_nrt): members by the grade in their product's name."""
    sp = F.col(product).endswith("_SP")
    return obs.groupBy(source).agg(F.count_if(sp).alias("n_sp"), F.count_if(~sp).alias("n_nrt"))


def registry_features(registry: DataFrame) -> DataFrame:
    """Features of a source from its registry row alone: span, observations an event, bounding box."""
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    dy = (F.col("bbox_lat_max") - F.col("bbox_lat_min")) * METRES_PER_DEGREE
    dx = (F.col("bbox_lon_max") - F.col("bbox_lon_min")) * METRES_PER_DEGREE * F.cos(F.radians("centroid_lat"))
    return registry.select(
        "source_id", "centroid_lat", "centroid_lon", "first_seen", "last_seen",
        F.round((at("last_seen") - at("first_seen")) / 8.64e10, 3).alias("reg_span_days"),
        F.col("n_obs").alias("reg_n_obs"), F.col("n_events").alias("reg_n_events"),
        F.round(F.try_divide("n_obs", "n_events"), 4).alias("reg_obs_per_event"),
        F.round(F.hypot(dx, dy), 1).alias("reg_bbox_diag_m"),
    )


def packet(measures: DataFrame, registry: DataFrame, source: str, salt: bytes) -> DataFrame:
    """Measures beside the registry's counts and a blind id; a count that disagrees raises."""
    joined = relate.complete(measures, registry.select(source, F.col("n_obs").alias("_n"), "n_events"), source)
    said = F.concat(F.lit("member count disagrees with the registry: "), F.col(source).cast("string"))
    checked = F.when(F.col("observation_count") == F.col("_n"), F.col("observation_count")).otherwise(F.raise_error(said))
    return blind_ids(joined.withColumn("observation_count", checked).drop("_n"), source, salt, "annotation_id")


def blinded(packets: DataFrame, source: str, private: Sequence[str] = ("first_seen", "last_seen")) -> tuple[DataFrame, DataFrame]:
    """(what annotators get, the private key): the packet without and with the source's id.

    Coordinates are cut to three decimals.
    """
    cut = {c: decimals(F.col(c), 3) for c in ("centroid_lat", "centroid_lon") if c in packets.columns}
    shown = packets.withColumns(cut).drop(source, *private)
    return shown, packets.select("annotation_id", source)


def check_counts(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, n_bad, ok) of boolean row checks (D24, D25); a null counts as bad."""
    bad = [F.count_if(~F.coalesce(test, F.lit(False))).alias(name) for name, test in checks.items()]
    pairs = ", ".join(f"'{name}', `{name}`" for name in checks)
    return rows.agg(*bad).select(F.expr(f"stack({len(checks)}, {pairs}) AS (check, n_bad)")).withColumn("ok", F.col("n_bad") == 0)


#: Words that would tell an annotator what the pipeline thinks.
LEAKS = r"(?i)\b(?:pihs|alert_priority|attribution|top_class|SRC-[0-9a-f]{10})\b"


def packet_checks(shown: DataFrame, first: DataFrame, second: DataFrame, key: str = "annotation_id") -> DataFrame:
    """(check, n_bad, ok): ids, ranges and leaks of a packet and of the two annotators' copies."""
    share = lambda c: F.col(c).between(0, 1)
    text = F.concat_ws(" ", *[F.col(c).cast("string") for c in shown.columns if c != key])
    rows = check_counts(
        shown,
        {
            "id_format": F.col(key).rlike("^ANN-[0-9a-f]{12}$"),
            "no_leak": ~text.rlike(LEAKS),
            "night_share": share("night_frac"), "high_share": share("conf_high_frac"),
            "saturated_share": share("ti4_sat_frac"), "span_share": share("span_frac"), "month_share": share("modal_month_frac"),
            "days_within_observations": F.col("active_days") <= F.col("observation_count"),
            "gap_within_duration": F.coalesce(F.col("max_gap_d"), F.lit(0.0)) <= F.col("duration_days") + 1e-9,
            "median_below_max": F.coalesce(F.col("frp_median") <= F.col("frp_max"), F.lit(True)),
        },
    )
    twice = shown.groupBy(key).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_bad")).select(F.lit("unique_ids").alias("check"), "n_bad")
    sides = []
    for name, other in (("first_has_all_ids", first), ("second_has_all_ids", second)):
        parts = relate.set_parts(shown, other, key).where("part LIKE '%only'")
        sides.append(parts.agg(F.sum("n").alias("n_bad")).select(F.lit(name).alias("check"), "n_bad"))
    more = twice.union(sides[0]).union(sides[1]).withColumn("ok", F.col("n_bad") == 0)
    return rows.unionByName(more)


def context_checks(features: DataFrame, nearest: str, count: str, status: str, reach_m: float) -> DataFrame:
    """(check, n_bad, ok): a context row is in range, and absence is a status and never a zero."""
    known = F.col(status) == "OK"
    return check_counts(
        features,
        {
            "nearest_in_reach": F.coalesce(F.col(nearest).between(0, reach_m), F.lit(True)),
            "count_not_negative": F.coalesce(F.col(count) >= 0, F.lit(True)),
            "status_given": F.col(status).isNotNull(),
            "found_means_counted": known == (F.coalesce(F.col(count), F.lit(0)) > 0),
            "absent_means_null": known | F.col(nearest).isNull(),
        },
    )


def feature_table(registry: DataFrame, key: str, **parts: DataFrame) -> DataFrame:
    """Registry features with the columns of each part and whether it was there, ``has_<part>``."""
    out = registry_features(registry)
    for name, part in parts.items():
        mine = [c for c in part.columns if c != key]
        out = relate.with_context(out, key, **{name: part}).withColumn(f"has_{name}", F.col(name).isNotNull())
        out = out.select("*", *[F.col(f"{name}.{c}").alias(c) for c in mine]).drop(name)
    return out


def training_rows(features: DataFrame, labels: DataFrame, key: str, label: str, skip: Sequence[str] = ("UNKNOWN", "")) -> DataFrame:
    """Features with their label, for labels that say something."""
    known = labels.where(F.col(label).isNotNull() & ~F.col(label).isin(*skip)).select(key, label)
    return features.join(known, key)
