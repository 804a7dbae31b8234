"""Coverage of streams, as-of features and opportunity-normalised recurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(df: DataFrame, ts: str, moment: Column) -> DataFrame:
    """Rows that were known at ``moment``."""
    return df.where(F.col(ts) <= moment)


def ledger(df: DataFrame, stream: str, day: str, least: int = 1) -> DataFrame:
    """(stream, day, n_obs, status) for each day of each stream's span.

    A day without enough rows is NO_ROWS_UNVERIFIED, never zero activity.
    """
    counts = df.groupBy(stream, day).agg(F.count("*").alias("n_obs"))
    spans = counts.groupBy(stream).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    calendar = spans.select(stream, F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias(day))
    status = F.when(F.col("n_obs") >= least, "OBSERVED").otherwise("NO_ROWS_UNVERIFIED")
    return calendar.join(counts, [stream, day], "left").withColumn("status", status)


def status_on(day: Column, first: Column, last: Column, n_obs: Column, least: int = 1) -> Column:
    """Status of any day against a stream's span."""
    return (
        F.when(n_obs >= least, "OBSERVED")
        .when(day.between(first, last), "NO_ROWS_UNVERIFIED")
        .otherwise("OUTSIDE_STREAM_SPAN")
    )


def gaps(ledger_df: DataFrame, stream: str, day: str) -> DataFrame:
    """Maximal runs of unobserved days: (stream, first, last, n_days)."""
    missing = ledger_df.where("status <> 'OBSERVED'")
    order = Window.partitionBy(stream).orderBy(day)
    island = F.date_sub(F.col(day), F.row_number().over(order))
    return missing.withColumn("_island", island).groupBy(stream, "_island").agg(
        F.min(day).alias("first"), F.max(day).alias("last"), F.count("*").alias("n_days")
    ).drop("_island")


def coverage_summary(ledger_df: DataFrame, stream: str) -> DataFrame:
    """span, observed and gap days per stream."""
    return ledger_df.groupBy(stream).agg(
        F.count("*").alias("span_days"),
        F.count_if(F.col("status") == "OBSERVED").alias("observed_days"),
        F.count_if(F.col("status") != "OBSERVED").alias("gap_days"),
    )


def window_coverage(windows: DataFrame, ledger_df: DataFrame, first: str, last: str, day: str, key: list[str]) -> DataFrame:
    """covered and unverified days of each window; a day counts if any stream saw it."""
    days = windows.select(*key, F.explode(F.sequence(first, last, F.expr("interval 1 day"))).alias(day))
    seen = ledger_df.where("status = 'OBSERVED'").select(day).distinct().withColumn("_seen", F.lit(1))
    return days.join(seen, day, "left").groupBy(*key).agg(
        F.count_if(F.col("_seen").isNotNull()).alias("covered_days"),
        F.count_if(F.col("_seen").isNull()).alias("unverified_days"),
    )


def recurrence_rate(detected: DataFrame, possible: DataFrame, source: str, day: str, end: str, days: int = 30) -> DataFrame:
    """Detection days over possible days in the ``days`` up to and including each source's ``end``.

    A detection makes its day a possible one.  Sources with no table of
    opportunities are OBSERVATION_OPPORTUNITY_UNKNOWN, with none in the window
    NO_VALID_OPPORTUNITIES.  ``detected`` carries ``end``.
    """
    ends = detected.select(source, end).distinct()
    hits = detected.select(source, day).distinct().withColumn("_hit", F.lit(1))
    chances = possible.select(source, day).distinct().withColumn("_chance", F.lit(1))
    known = possible.select(source).distinct().withColumn("_known", F.lit(True))
    union = hits.join(chances, [source, day], "full_outer").join(ends, source)
    inside = F.col(day).between(F.date_sub(F.col(end), days - 1), F.col(end))
    counts = union.where(inside).groupBy(source).agg(
        F.count("_hit").alias("detect_days"), F.count("*").alias("possible_days")
    )
    out = ends.join(counts, source, "left").join(known, source, "left")
    status = (
        F.when(F.col("_known").isNull(), "OBSERVATION_OPPORTUNITY_UNKNOWN")
        .when(F.coalesce("possible_days", F.lit(0)) == 0, "NO_VALID_OPPORTUNITIES")
        .otherwise("OK")
    )
    rate = F.when(status == "OK", F.col("detect_days") / F.col("possible_days"))
    return out.withColumns({"status": status, "onrr": rate}).drop("_known")


def past_windows(ends: DataFrame, source: str, end: str, first: str, days: int = 30, most: int = 24) -> DataFrame:
    """(source, k, from, to): disjoint earlier windows; the last is the one that holds the first detection."""
    k = F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k")
    spread = ends.select(source, end, first, k)
    to = F.date_sub(F.col(end), F.col("k") * days)
    out = spread.select(source, "k", F.date_sub(to, days - 1).alias("window_from"), to.alias("window_to"), first)
    return out.where(F.col("window_to") >= F.col(first)).drop(first)


def window_rates(detected: DataFrame, possible: DataFrame, source: str, day: str, days: int = 30, most: int = 24) -> DataFrame:
    """(source, k, detect_days, possible_days, onrr): the window up to a source's last detection (k = 0) and earlier ones.

    Windows are disjoint and go back to the one that holds the first detection.  A detection makes its day a possible one.  A window
    without a possible day, and a source without any day in ``possible``, has no
    rate and no row.  A day's window is arithmetic, so each day is shuffled once,
    however many windows there are.
    """
    hits = detected.select(source, day).distinct().withColumn("_hit", F.lit(1))
    chances = possible.select(source, day).distinct().withColumn("_chance", F.lit(1))
    ends = hits.groupBy(source).agg(F.max(day).alias("_end"), F.min(day).alias("_first"))
    known = chances.select(source).distinct()
    union = hits.join(chances, [source, day], "full_outer").join(ends.join(known, source), source)
    k = F.floor(F.date_diff(F.col("_end"), F.col(day)) / days).cast("int")
    reached = F.date_sub(F.col("_end"), F.col("k") * days) >= F.col("_first")
    counted = union.where(F.col(day) <= F.col("_end")).withColumn("k", k).where((F.col("k") <= most) & reached).groupBy(source, "k").agg(
        F.count("_hit").alias("detect_days"), F.count("*").alias("possible_days")
    )
    return counted.withColumn("onrr", F.col("detect_days") / F.col("possible_days"))
