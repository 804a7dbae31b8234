"""The published contract: coverage by stream, ranked sources, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.operators import relate


def coverage_by_stream(ledger: DataFrame) -> DataFrame:
    """(stream, days, by_reason, unverified_dates, partial_boundary_days); reasons and dates sorted.

    ledger: stream, date, status, reason, span_boundary_day_partial_risk ('1' where so).
    """
    dates = lambda test: F.sort_array(F.collect_list(F.when(test, F.col("date")))).alias
    reasons = ledger.groupBy("stream", "reason").agg(F.count("*").alias("n")).groupBy("stream").agg(
        F.sort_array(F.collect_list(F.struct("reason", "n"))).alias("by_reason")
    )
    rows = ledger.groupBy("stream").agg(
        F.count("*").alias("days"),
        dates(F.col("status") != "OBSERVED")("unverified_dates"),
        dates(F.col("span_boundary_day_partial_risk") == "1")("partial_boundary_days"),
    )
    return rows.join(reasons, "stream")


def coverage_sentence(unverified: Column) -> Column:
    """How complete the coverage of a source's window is, in words."""
    # fixed values: the sentence is shown as it is
    gap = F.format_string("S-NPP has %d unverified-coverage days in this window (missing data is not evidence of no fire)", unverified.cast("long"))
    return F.concat(F.lit("Complete for NOAA-20 and NOAA-21; "), F.when(unverified > 0, gap).otherwise("S-NPP complete"))


def unverified_in_window(sources: DataFrame, ledger: DataFrame, stream: str, key: str, first: str, last: str) -> DataFrame:
    """(key, unverified): days of one stream without verified coverage between two days of each source.

    The days of a ledger are few (one a date), so they are broadcast.
    """
    days = ledger.where((F.col("stream") == stream) & (F.col("status") != "OBSERVED")).select(F.to_date("date").alias("_d")).distinct()
    hit = F.col("_d").between(F.to_date(first), F.to_date(last))
    return sources.join(F.broadcast(days), hit, "left").groupBy(key).agg(F.count("_d").alias("unverified"))


def ranked_sources(scored: DataFrame, held_out: DataFrame, key: str, score: str, most: int = 3000) -> DataFrame:
    """The ``most`` best sources that are not held out, ranked by score and then id."""
    kept = relate.exclude(scored, held_out, key).orderBy(F.desc(score), key).limit(most)
    top = F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("_s"), key)))
    # ``most`` rows: their order is a short list
    ranks = kept.agg(top.alias("t")).select(F.posexplode("t").alias("pos", "r")).select(F.col(f"r.{key}").alias(key), (F.col("pos") + 1).alias("rank"))
    return kept.join(F.broadcast(ranks), key)


def counters(scored: DataFrame, held_out: DataFrame, key: str, flag: str, tier: str) -> DataFrame:
    """One row: sources monitored, candidates, alerts by tier and held-out sources."""
    kept = relate.exclude(scored, held_out, key)
    left_out = relate.restrict(scored, held_out, key).agg(F.count("*").alias("heldout_excluded"))
    row = kept.agg(
        F.count("*").alias("sources_monitored"), F.count_if(F.col(flag)).alias("pihs_candidates"),
        F.count_if(F.col(tier) == "HIGH").alias("alerts_high"), F.count_if(F.col(tier) == "MEDIUM").alias("alerts_medium"),
    )
    return row.crossJoin(F.broadcast(left_out))


def frontend_rows(points: DataFrame, registry: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Map points with registry and candidate context; what is missing stays null."""
    return relate.with_context(points, key, registry=registry, candidate=candidates)
