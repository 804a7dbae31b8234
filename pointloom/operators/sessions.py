"""Sessions of point observations per source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.fields import event_state


def sessionize(
    df: DataFrame, source: str, ts: str, ties: list[str], gap_hours: float = 36.0
) -> DataFrame:
    """``df`` with gap_h and session, 1 upwards: a gap of more than ``gap_hours`` opens a new one.

    A gap of exactly that length stays within the session.
    """
    order = Window.partitionBy(source).orderBy(ts, *ties)
    gap = (F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(order))) / 3.6e9
    opens = F.coalesce((F.col("gap_h") > gap_hours).cast("int"), F.lit(1))
    return df.withColumn("gap_h", gap).withColumn(
        "session", F.sum(opens).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    )


def event_id(source: str = "source_id", session: str = "session"):
    """``EVT-{source}-{session:03d}`` (W02); three digits at least, more if needed."""
    return F.concat_ws("-", F.lit("EVT"), F.col(source).cast("string"), F.format_string("%03d", session))


def session_table(sessions: DataFrame, source: str, ts: str, sensor: str, as_of) -> DataFrame:
    """One row per session: size, start, end, sensors as sorted (sensor, n) pairs and state."""
    by_sensor = sessions.groupBy(source, "session", sensor).agg(
        F.count("*").alias("_n"), F.min(ts).alias("_from"), F.max(ts).alias("_to")
    )
    out = by_sensor.groupBy(source, "session").agg(
        F.sum("_n").alias("n"),
        F.min("_from").alias("start"),
        F.max("_to").alias("end"),
        F.sort_array(F.collect_list(F.struct(F.col(sensor).alias("sensor"), F.col("_n").alias("n")))).alias("sensors"),
    )
    return out.withColumn("state", event_state(F.col("end"), as_of))


def session_gaps(table: DataFrame, source: str) -> DataFrame:
    """Hours between the end of a session and the start of the next."""
    order = Window.partitionBy(source).orderBy("session")
    gap = (F.unix_micros("start") - F.unix_micros(F.lag("end").over(order))) / 3.6e9
    return table.withColumn("gap_h", gap).where("gap_h IS NOT NULL")


def day_gaps(df: DataFrame, source: str, day: str) -> DataFrame:
    """Days between consecutive distinct days of a source."""
    order = Window.partitionBy(source).orderBy(day)
    days = df.select(source, day).distinct()
    return days.withColumn("gap_days", F.date_diff(F.col(day), F.lag(day).over(order))).where("gap_days IS NOT NULL")


def observation_gaps(df: DataFrame, source: str, ts: str, ties: list[str]) -> DataFrame:
    """Days between consecutive observations of a source (W05), a finer grain than W04."""
    order = Window.partitionBy(source).orderBy(ts, *ties)
    gap = (F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(order))) / 8.64e10
    return df.withColumn("gap_days", gap).where("gap_days IS NOT NULL")
