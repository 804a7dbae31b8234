"""Registry of driver queries and the proxy tables they share.

The driver tables hold no coordinates and no faults, so observations, sites and
points are projected from them by the same arithmetic in Spark and in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function as the query of its name, with its DuckDB SQL if there is any."""

    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Observations: one row per event; every 97th value is unknown.
OBS = """obs AS (
  SELECT event_id, user_id AS source_id, event_type AS sensor, ts, CAST(ts AS DATE) AS day,
         CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END AS frp,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS conf,
         (hour(ts) < 6 OR hour(ts) >= 18) AS night,
         8 + (user_id * 37 % 2900) / 100.0::DOUBLE + (event_id % 7) * 0.0005::DOUBLE AS lat,
         68 + (user_id * 53 % 2900) / 100.0::DOUBLE + (event_id % 5) * 0.0005::DOUBLE AS lon
  FROM events)"""


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select(
        "event_id",
        F.col("user_id").alias("source_id"),
        F.col("event_type").alias("sensor"),
        ts.alias("ts"),
        F.to_date(ts).alias("day"),
        F.when(F.col("event_id") % 97 != 0, F.col("value")).alias("frp"),
        F.get_json_object("props", "$.k").cast("int").alias("conf"),
        ((F.hour(ts) < 6) | (F.hour(ts) >= 18)).alias("night"),
        (8 + (F.col("user_id") * 37 % 2900) / 100 + (F.col("event_id") % 7) * 0.0005).alias("lat"),
        (68 + (F.col("user_id") * 53 % 2900) / 100 + (F.col("event_id") % 5) * 0.0005).alias("lon"),
    )


#: Sites: suppliers with a kind and coordinates.
SITES = """sites AS (
  SELECT s_suppkey AS site_id, s_name AS site_name,
         CASE s_suppkey % 3 WHEN 0 THEN 'COAL' WHEN 1 THEN 'STEEL' ELSE 'OILGAS' END AS kind,
         8 + (s_suppkey * 37 % 2900) / 100.0::DOUBLE + (s_suppkey % 7) * 0.0005::DOUBLE AS s_lat,
         68 + (s_suppkey * 53 % 2900) / 100.0::DOUBLE + (s_suppkey % 5) * 0.0005::DOUBLE AS s_lon
  FROM supplier)"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("site_id"),
        F.col("s_name").alias("site_name"),
        F.when(k % 3 == 0, "COAL").when(k % 3 == 1, "STEEL").otherwise("OILGAS").alias("kind"),
        (8 + (k * 37 % 2900) / 100 + (k % 7) * 0.0005).alias("s_lat"),
        (68 + (k * 53 % 2900) / 100 + (k % 5) * 0.0005).alias("s_lon"),
    )


#: Points: customers with coordinates a few kilometres apart.
POINTS = """points AS (
  SELECT c_custkey AS point_id, c_mktsegment AS segment, c_nationkey AS nation,
         8 + ((c_custkey % 97) * 37 % 2900) / 100.0::DOUBLE + (c_custkey % 41) * 0.0015::DOUBLE AS lat,
         68 + ((c_custkey % 97) * 53 % 2900) / 100.0::DOUBLE + (c_custkey % 29) * 0.0015::DOUBLE AS lon
  FROM customer)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("point_id"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").alias("nation"),
        (8 + ((k % 97) * 37 % 2900) / 100 + (k % 41) * 0.0015).alias("lat"),
        (68 + ((k % 97) * 53 % 2900) / 100 + (k % 29) * 0.0015).alias("lon"),
    )


def km(a: str, b: str, c: str, d: str) -> str:
    """SQL of the distance in kilometres between (a, b) and (c, d)."""
    return (
        f"(2 * 6371.0088::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + "
        f"cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))))"
    )


#: Sources: activity of each source, with its sessions and extent.
ACTIVITY = OBS + """, sess AS (
  SELECT *, sum(CASE WHEN gap IS NULL OR gap > 36 THEN 1 ELSE 0 END)
            OVER (PARTITION BY source_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session
  FROM (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY source_id ORDER BY ts, event_id))) / 3.6e9::DOUBLE AS gap FROM obs)),
act AS (
  SELECT source_id, count(*) AS detection_count, count(DISTINCT day) AS active_days,
         count(*) FILTER (night) / count(*)::DOUBLE AS night_frac, max(frp) AS frp_max, avg(frp) AS frp_mean,
         max(session)::BIGINT AS event_count,
         count(*) FILTER (ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAY) AS recent_detections,
         min(ts) AS first_seen, max(ts) AS last_seen,
         sqrt(pow((max(lat) - min(lat)) * 111320.0::DOUBLE, 2) + pow((max(lon) - min(lon)) * 111320.0::DOUBLE * cos(radians((min(lat) + max(lat)) / 2)), 2)) AS extent_m
  FROM sess GROUP BY source_id)"""


def source_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.functions.geo import diagonal_m
    from pointloom.operators.activity import activity
    from pointloom.operators.sessions import sessionize

    o = obs(spark, sf_dir)
    end = F.lit("2024-01-30 00:00:00").cast("timestamp")
    act = activity(o, "source_id", "ts", "frp", F.col("night"), end, 7)
    more = sessionize(o, "source_id", "ts", ["event_id"]).groupBy("source_id").agg(
        F.max("session").cast("long").alias("event_count"),
        diagonal_m(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).alias("extent_m"),
    )
    return act.join(more, "source_id")


RULES = ACTIVITY + """, ruled AS (
  SELECT *, (active_days >= 20)::INT * 3 + (active_days >= 5)::INT + (night_frac >= 0.6::DOUBLE AND detection_count >= 3)::INT * 2
            + (event_count >= 3)::INT + (extent_m <= 750 AND detection_count >= 3)::INT AS rule_score,
         (active_days >= 20 AND night_frac >= 0.6::DOUBLE AND detection_count >= 3 AND extent_m <= 750) AS rule_flag
  FROM act), jumped AS (
  SELECT *, CASE WHEN detection_count >= 3 AND frp_mean > 0 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, (frp_max / frp_mean - 1) / 4)) ELSE 0.0::DOUBLE END AS jump FROM ruled),
alerts AS (
  SELECT *, round(0.35::DOUBLE * rule_score / 8 + 0.25::DOUBLE * least(1.0::DOUBLE, recent_detections / 5.0::DOUBLE) + 0.15::DOUBLE * jump
                  + 0.15::DOUBLE * least(1.0::DOUBLE, active_days / 60.0::DOUBLE), 4) AS alert_score FROM jumped),
tiered AS (SELECT *, CASE WHEN alert_score >= 0.6::DOUBLE THEN 'HIGH' WHEN alert_score >= 0.4::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS alert_tier FROM alerts)"""


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.operators.activity import with_alert, with_rules

    return with_alert(with_rules(source_activity(spark, sf_dir)))


def rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})
