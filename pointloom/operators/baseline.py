"""Own-history baselines and profiles of sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.fields import recurrence, season
from pointloom.operators import stats
from pointloom.operators.sessions import day_gaps


@dataclass(frozen=True)
class BaselineParams:
    least_history: int = 10
    daily: str = "max"
    least_reference: int = 10
    #: Whether a history of one day at least that is shorter than ``least_history`` is scored too; its status says so, and it has no t_anom.
    score_short: bool = False


def targets(df: DataFrame, source: str, day: str, sensor: str) -> DataFrame:
    """The last day of each source with its most frequent sensor; ties to the smaller name."""
    last = df.groupBy(source).agg(F.max(day).alias("target_day"))
    on_day = df.join(last, source).where(F.col(day) == F.col("target_day"))
    counts = on_day.groupBy(source, "target_day", sensor).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(source).orderBy(F.desc("_n"), sensor)
    top = counts.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    return top.select(source, "target_day", F.col(sensor).alias("target_sensor"))


def daily_records(df: DataFrame, source: str, day: str, sensor: str, value: str, excluded: str | None, p: BaselineParams) -> DataFrame:
    """Records by source, day and sensor with the first exclusion reason against the target."""
    records = stats.daily(df, [source, sensor], day, value, p.daily)
    if excluded:
        out = df.where(F.col(excluded)).select(source, day, sensor).distinct().withColumn("_out", F.lit(True))
        records = records.join(out, [source, day, sensor], "left")
    else:
        records = records.withColumn("_out", F.lit(None).cast("boolean"))
    joined = records.join(targets(df, source, day, sensor), source)
    reason = (
        F.when(F.col(day) >= F.col("target_day"), "SAME_OR_LATER_DAY")
        .when(F.col(sensor) != F.col("target_sensor"), "DIFFERENT_SENSOR")
        .when(season(F.month(day)) != season(F.month("target_day")), "DIFFERENT_SEASON")
        .when(F.coalesce("_out", F.lit(False)), "EXTERNALLY_EXCLUDED")
        .when(F.col("daily").isNull(), "FRP_MISSING")
    )
    return joined.withColumn("reason", reason).drop("_out")


def baseline(df: DataFrame, source: str, day: str, sensor: str, value: str, excluded: str | None = None, p: BaselineParams = BaselineParams()) -> DataFrame:
    """Status, robust z and t_anom of each source's last day against its own earlier days."""
    records = daily_records(df, source, day, sensor, value, excluded, p)
    history = records.where("reason IS NULL").groupBy(source).agg(
        F.array_sort(F.collect_list("daily")).alias("history")
    )
    fold = {"max": F.max, "mean": F.avg, "median": F.median}[p.daily]
    target = targets(df, source, day, sensor)
    on_day = df.join(target, source).where(F.col(day) == F.col("target_day"))
    current = on_day.groupBy(source, "target_day", "target_sensor").agg(fold(value).alias("target_value"))
    out = current.join(history, source, "left").withColumn(
        "history", F.coalesce("history", F.array().cast("array<double>"))
    )
    n = F.size("history")
    enough = F.col("target_value").isNotNull() & (n >= (1 if p.score_short else p.least_history))
    z = F.when(enough, stats.array_robust_score(F.col("target_value"), F.col("history")))
    out = out.withColumns({"n_eligible": n, "robust_z": z})
    status = (
        F.when(F.col("target_value").isNull(), "TARGET_FRP_MISSING")
        .when(n < p.least_history, "INSUFFICIENT_HISTORY")
        .when(F.col("robust_z").isNull(), "DEGENERATE_BASELINE")
        .otherwise("OK")
    )
    out = out.withColumn("status", status)
    loo = F.when(F.col("status") == "OK", stats.leave_one_out(F.col("history")))
    out = out.withColumn("_loo", loo)
    share = F.when(
        F.size("_loo") >= p.least_reference,
        stats.empirical_cdf(F.greatest(F.lit(0.0), F.col("robust_z")), F.col("_loo")),
    )
    return out.withColumn("t_anom", F.when(F.col("status") == "OK", share)).drop("_loo", "history")


def profile(df: DataFrame, source: str, day: str, value: str) -> DataFrame:
    """Active days, span, gap and value summaries and recurrence class of each source."""
    base = df.groupBy(source).agg(
        F.count("*").alias("n_obs"),
        F.count_distinct(day).alias("active_days"),
        (F.date_diff(F.max(day), F.min(day)) + 1).alias("span_days"),
        F.median(value).alias("value_median"),
        F.max(value).alias("value_max"),
    )
    gap = day_gaps(df, source, day).groupBy(source).agg(
        F.median("gap_days").alias("gap_median"),
        F.percentile("gap_days", 0.9).alias("gap_p90"),
        F.max("gap_days").alias("gap_max"),
    )
    return base.join(gap, source, "left").withColumn(
        "recurrence", recurrence(F.col("active_days"), F.col("span_days"))
    )
