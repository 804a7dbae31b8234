"""Activity of sources, rule scores, alerts and ranking."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points of the persistence rules.
POINTS = {
    "PERSISTENT_ACTIVITY": 3, "MULTI_DAY_ACTIVITY": 1, "NIGHT_DOMINANT": 2, "REPEATED_EVENTS": 1, "SPATIALLY_COMPACT": 1,
}
#: Weights of the alert components and the tiers' bounds.
WEIGHTS = {"pihs": 0.35, "recency": 0.25, "intensity_jump": 0.15, "persistence": 0.15, "facility_context": 0.10}


@dataclass(frozen=True)
class ScoreParams:
    persistent_days: int = 20
    multi_days: int = 5
    night_share: float = 0.6
    least_detections: int = 3
    least_events: int = 3
    compact_m: float = 750.0
    high: float = 0.6
    medium: float = 0.4
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    facility_categories: tuple[str, ...] = ("STEEL_METAL", "THERMAL_POWER", "LNG_GAS")


def activity(df: DataFrame, source: str, ts: str, value: str, night: Column, end: Column, recent_days: int = 30) -> DataFrame:
    """Counts, distinct days, night share, value maximum and mean, first, last and recent rows."""
    recent = F.unix_micros(ts) >= F.unix_micros(end) - recent_days * 86_400_000_000
    return df.groupBy(source).agg(
        F.count("*").alias("detection_count"),
        F.count_distinct(F.to_date(ts)).alias("active_days"),
        (F.count_if(night) / F.count("*")).alias("night_frac"),
        F.max(value).alias("frp_max"),
        F.avg(value).alias("frp_mean"),
        F.min(ts).alias("first_seen"),
        F.max(ts).alias("last_seen"),
        F.count_if(recent).alias("recent_detections"),
    )


def modal_month(df: DataFrame, source: str, ts: str) -> DataFrame:
    """The commonest month of each source and its share; ties to the earlier month."""
    counts = df.groupBy(source, F.month(ts).alias("month")).agg(F.count("*").alias("n"))
    order = Window.partitionBy(source).orderBy(F.desc("n"), "month")
    total = F.sum("n").over(Window.partitionBy(source))
    ranked = counts.withColumns({"_r": F.row_number().over(order), "share": F.col("n") / total})
    return ranked.where("_r = 1").select(source, "month", "share")


def variation(df: DataFrame, source: str, ts: str, value: str) -> DataFrame:
    """Coefficient of variation (0 for a mean of at most 0) and rows per active day."""
    mean = F.avg(value)
    return df.groupBy(source).agg(
        F.when(mean <= 0, 0.0).otherwise(F.stddev_pop(value) / mean).alias("cv"),
        (F.count("*") / F.count_distinct(F.to_date(ts))).alias("per_active_day"),
    )


def rule_names(p: ScoreParams = ScoreParams()) -> Column:
    """The rules that hold, in order, from active_days, night_frac, detection_count, event_count and extent_m."""
    n = F.col("detection_count") >= p.least_detections
    rules = [
        (F.col("active_days") >= p.persistent_days, "PERSISTENT_ACTIVITY"),
        (F.col("active_days") >= p.multi_days, "MULTI_DAY_ACTIVITY"),
        ((F.col("night_frac") >= p.night_share) & n, "NIGHT_DOMINANT"),
        (F.col("event_count") >= p.least_events, "REPEATED_EVENTS"),
        ((F.col("extent_m") <= p.compact_m) & n, "SPATIALLY_COMPACT"),
    ]
    return F.array_compact(F.array(*[F.when(test, name) for test, name in rules]))


def with_rules(df: DataFrame, p: ScoreParams = ScoreParams()) -> DataFrame:
    """rule_reasons, rule_score (0-8) and rule_flag; a missing input means no score and no flag."""
    inputs = [F.col(c) for c in ("active_days", "night_frac", "detection_count", "event_count", "extent_m")]
    known = inputs[0].isNotNull()
    for c in inputs[1:]:
        known = known & c.isNotNull()
    reasons = F.when(known, rule_names(p)).otherwise(F.array(F.lit("INSUFFICIENT_DATA")))
    points = F.lit(0)
    for name, value in POINTS.items():
        points = points + F.when(F.array_contains("rule_reasons", name), value).otherwise(0)
    needed = F.array(*map(F.lit, ("PERSISTENT_ACTIVITY", "NIGHT_DOMINANT", "SPATIALLY_COMPACT")))
    return df.withColumn("rule_reasons", reasons).withColumns(
        {
            "rule_score": F.when(known, points),
            "rule_flag": known & (F.size(F.array_except(needed, F.col("rule_reasons"))) == 0),
        }
    )


def with_alert(df: DataFrame, top_category: Column | None = None, top_percent: Column | None = None, p: ScoreParams = ScoreParams()) -> DataFrame:
    """Alert components, score rounded to four decimals before tiering, tier and reasons.

    Missing numbers count as zero here, and only here.
    """
    zero = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    fmax, fmean = zero("frp_max"), zero("frp_mean")
    jump = F.when(
        (zero("detection_count") >= 3) & (fmean > 0),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.try_divide(fmax, fmean) - 1) / 4)),
    ).otherwise(0.0)
    context = F.lit(0.0)
    if top_category is not None:
        context = F.when(top_category.isin(*p.facility_categories), top_percent / 100).otherwise(0.0)
    parts = {
        "pihs": F.coalesce(F.col("rule_score"), F.lit(0)) / 8,
        "recency": F.least(F.lit(1.0), zero("recent_detections") / 5),
        "intensity_jump": jump,
        "persistence": F.least(F.lit(1.0), zero("active_days") / 60),
        "facility_context": F.coalesce(context, F.lit(0.0)),
    }
    out = df.withColumns({f"part_{k}": v for k, v in parts.items()})
    total = F.lit(0.0)
    for name, weight in p.weights.items():
        total = total + weight * F.col(f"part_{name}")
    out = out.withColumn("alert_score", F.round(total, 4))
    tier = F.when(F.col("alert_score") >= p.high, "HIGH").when(F.col("alert_score") >= p.medium, "MEDIUM").otherwise("LOW")
    codes = [
        (F.col("rule_flag"), "PIHS_CANDIDATE"),
        (zero("recent_detections") > 0, "RECENT_ACTIVITY"),
        (F.col("part_intensity_jump") >= 0.5, "INTENSITY_ABOVE_OWN_BASELINE"),
        (zero("active_days") >= p.persistent_days, "LONG_RUNNING"),
        (F.col("part_facility_context") > 0, "FACILITY_CONTEXT"),
    ]
    return out.withColumns(
        {
            "alert_tier": tier,
            "alert_reasons": F.array_compact(F.array(*[F.when(test, name) for test, name in codes])),
        }
    )


def top_ranked(df: DataFrame, score: str, key: str, n: int) -> DataFrame:
    """The ``n`` best rows with their rank; ties to the smaller key.

    The limit comes before the rank, so the ranking task holds ``n`` rows.
    """
    best = df.orderBy(F.desc(score), key).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))


def why_card(df: DataFrame) -> DataFrame:
    """Facts and an explanation of a ranked source as text columns."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    percent = F.round(F.col("night_frac") * 100).cast("int")
    facts = F.array(
        F.format_string("%d detections on %d days between %s and %s", "detection_count", "active_days", day("first_seen"), day("last_seen")),
        F.format_string("%d%% of detections at night", percent),
        F.format_string("%d detections in the recent part of the record", "recent_detections"),
    )
    first = F.when(F.get("rule_reasons", F.lit(0)) == "INSUFFICIENT_DATA", "Insufficient data for persistence assessment").otherwise(
        F.coalesce(F.initcap(F.replace(F.get("rule_reasons", F.lit(0)), F.lit("_"), F.lit(" "))), F.lit("No rule holds"))
    )
    text = F.concat_ws(
        " ",
        F.concat(first, F.lit(".")),
        F.when(F.array_contains("rule_reasons", "NIGHT_DOMINANT"), "Night-dominant."),
        F.lit("Cause not confirmed."),
    )
    return df.withColumns({"facts": facts, "explanation": text})


def tier_counts(df: DataFrame) -> DataFrame:
    """Sources and flagged sources by alert tier."""
    return df.groupBy("alert_tier").agg(F.count("*").alias("n"), F.count_if("rule_flag").alias("n_flagged"))
