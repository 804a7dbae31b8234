"""Assessment objects of sources' latest events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators import stats


@dataclass(frozen=True)
class AssessParams:
    elevated: float | None = None
    abnormal: float | None = None
    least_windows: int = 10
    most_listed: int = 500


def latest_events(events: DataFrame, source: str, end: str, event: str) -> DataFrame:
    """The latest event of each source (D12); ties to the larger id."""
    order = Window.partitionBy(source).orderBy(F.desc(end), F.desc(event))
    return events.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def persistence_deviation(df: DataFrame, current: str, history: str, p: AssessParams = AssessParams()) -> DataFrame:
    """z of the current recurrence rate against earlier windows and its share of leave-one-out scores."""
    enough = F.col(current).isNotNull() & (F.size(history) >= p.least_windows)
    out = df.withColumn("p_z", F.when(enough, stats.array_robust_score(F.col(current), F.col(history))))
    loo = F.when(F.col("p_z").isNotNull(), stats.leave_one_out(F.col(history)))
    out = out.withColumn("_loo", loo)
    norm = F.when(F.size("_loo") >= p.least_windows, stats.empirical_cdf(F.greatest(F.lit(0.0), F.col("p_z")), F.col("_loo")))
    status = (
        F.when(F.col(current).isNull(), "OBSERVATION_OPPORTUNITY_UNKNOWN")
        .when(F.size(history) < p.least_windows, "INSUFFICIENT_HISTORY")
        .when(F.col("p_z").isNull(), "DEGENERATE_BASELINE")
        .otherwise("OK")
    )
    return out.withColumns({"p_status": status, "p_norm": norm}).drop("_loo")


def persistence(sources: DataFrame, rates: DataFrame, source: str, p: AssessParams = AssessParams()) -> DataFrame:
    """(source, onrr, n_windows, p_status, p_z, p_norm) of every source of ``sources``.

    rates: as from ``coverage.window_rates``; a source holds at most as many as there are windows.
    """
    own = rates.groupBy(source).agg(
        F.max(F.when(F.col("k") == 0, F.col("onrr"))).alias("onrr"),
        F.array_sort(F.collect_list(F.when(F.col("k") > 0, F.col("onrr")))).alias("_past"),
    )
    out = sources.select(source).distinct().join(own, source, "left").withColumn("_past", F.coalesce("_past", F.array().cast("array<double>")))
    scored = persistence_deviation(out, "onrr", "_past", p)
    return scored.select(source, "onrr", F.size("_past").alias("n_windows"), "p_status", "p_z", "p_norm")


def fused(parts: dict[str, tuple[Column, float]]) -> Column:
    """Weighted mean of the components that exist, null without any."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for value, w in parts.values():
        total = total + F.coalesce(value * w, F.lit(0.0))
        weight = weight + F.when(value.isNotNull(), w).otherwise(0.0)
    return F.when(weight > 0, total / weight)


def decision(gate: Column, history_short: Column, score: Column, p: AssessParams = AssessParams()) -> Column:
    """Decision status; it abstains wherever evidence or calibration is missing."""
    ready = F.lit(p.elevated is not None and p.abnormal is not None)
    return (
        F.when(~gate, "Insufficient Evidence")
        .when(history_short & score.isNull(), "Insufficient History")
        .when(score.isNull(), "Insufficient Evidence")
        .when(~ready, "Insufficient Evidence (thresholds not calibrated)")
        .when(score >= F.lit(p.abnormal).cast("double"), "Abnormal")
        .when(score >= F.lit(p.elevated).cast("double"), "Elevated")
        .otherwise("Normal")
    )


def detection_confidence(obs: DataFrame, event: str, confidence: str) -> DataFrame:
    """Counts by confidence class and the lowest class of an event."""
    rank = F.element_at(F.create_map(*[F.lit(v) for k, n in (("low", 0), ("nominal", 1), ("high", 2)) for v in (k, n)]), F.col(confidence))
    return obs.groupBy(event).agg(
        F.min_by(confidence, rank).alias("lowest_confidence"),
        *[F.count_if(F.col(confidence) == c).alias(f"n_{c}") for c in ("low", "nominal", "high")],
        F.count_if(F.col(confidence).isNull()).alias("n_unknown"),
    )


def listed(obs: DataFrame, event: str, ts: str, key: str, p: AssessParams = AssessParams()) -> DataFrame:
    """The last ``most_listed`` observations of each event and whether there were more."""
    order = Window.partitionBy(event).orderBy(F.desc(ts), F.desc(key))
    ranked = obs.withColumn("_r", F.row_number().over(order)).withColumn("truncated", F.count("*").over(Window.partitionBy(event)) > p.most_listed)
    return ranked.where(F.col("_r") <= p.most_listed).drop("_r")


def assessment(events: DataFrame, baseline: DataFrame, association: DataFrame, source: str, event: str, p: AssessParams = AssessParams()) -> DataFrame:
    """One nested object per event: identity, baseline, association, decision.

    baseline: source, status, robust_z, t_anom, n_eligible.  association: event,
    status, basis, selected.
    """
    b = baseline.select(source, F.struct("status", "robust_z", "t_anom", "n_eligible").alias("baseline"))
    a = association.select(event, F.struct("status", "basis", "selected", "n_candidates").alias("association"))
    joined = events.join(b, source, "left").join(a, event, "left")
    score = fused({"t_anom": (F.col("baseline.t_anom"), 1.0)})
    gate = F.coalesce(F.col("association.status") == "ASSOCIATED", F.lit(False))
    short = F.coalesce(F.col("baseline.status") == "INSUFFICIENT_HISTORY", F.lit(True))
    return joined.select(
        event, source,
        F.struct("n", "start", "end", "state").alias("event"),
        "baseline", "association", score.alias("fused_score"), decision(gate, short, score, p).alias("decision"),
    )
