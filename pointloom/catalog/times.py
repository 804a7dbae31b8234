"""Queries over time: sessions, daily statistics, baselines, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.catalog.base import ACTIVITY, OBS, obs, query, rounded
from pointloom.functions.fields import season, tier
from pointloom.operators import assess, activity, baseline, coverage, sessions, stats

AS_OF = "2024-01-30 00:00:00"
SESSION = ACTIVITY + f""", stab AS (
  SELECT source_id, session::INT AS session, count(*) AS n, min(ts) AS a, max(ts) AS b FROM sess GROUP BY 1, 2)"""


def sessionized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessionize(obs(spark, sf_dir), "source_id", "ts", ["event_id"])


def session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.session_table(sessionized(spark, sf_dir), "source_id", "ts", "sensor", F.lit(AS_OF).cast("timestamp"))


FLAGSHIP = SESSION + """, daily AS (SELECT source_id, day, max(frp) AS v FROM obs GROUP BY 1, 2),
latest AS (SELECT source_id, max(day) AS d FROM daily WHERE v IS NOT NULL GROUP BY 1),
hist AS (SELECT daily.source_id, median(v) AS m, list(v) AS vs, count(*) AS n FROM daily JOIN latest USING (source_id) WHERE day < d AND v IS NOT NULL GROUP BY 1),
spread AS (SELECT source_id, m, n, median(abs(x - m)) AS mad, avg(abs(x - m)) AS ad FROM (SELECT source_id, m, n, unnest(vs) AS x FROM hist) GROUP BY ALL),
z AS (SELECT s.source_id, n AS n_history, CASE WHEN mad > 1e-9 THEN 0.6745::DOUBLE * (v - m) / mad WHEN ad > 1e-9 THEN (v - m) / (1.253314::DOUBLE * ad) END AS z
      FROM spread s JOIN latest USING (source_id) JOIN daily ON daily.source_id = s.source_id AND daily.day = latest.d)"""


@query("WITH " + FLAGSHIP + ", k AS (SELECT source_id, count(*) AS n_sessions FROM stab GROUP BY 1) SELECT source_id, n_sessions, n_history, round(z, 6) AS robust_z FROM z JOIN k USING (source_id) WHERE z IS NOT NULL ORDER BY z DESC, source_id LIMIT 20")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions per source and the robust score of its latest day against earlier days: the top 20."""
    o = obs(spark, sf_dir)
    days = stats.daily(o, ["source_id"], "day", "frp").where("daily IS NOT NULL")
    last = days.groupBy("source_id").agg(F.max("day").alias("d"), F.max_by("daily", "day").alias("x"))
    history = days.join(last, "source_id").where("day < d")
    spread = stats.median_mad(history, ["source_id"], "daily")
    z = stats.robust_score(F.col("x"), F.col("median"), F.col("mad"), F.col("mean_ad"))
    n = sessionized(spark, sf_dir).groupBy("source_id").agg(F.max("session").cast("long").alias("n_sessions"))
    scored = spread.join(last, "source_id").join(n, "source_id").withColumn("z", z).where("z IS NOT NULL")
    return scored.orderBy(F.desc("z"), "source_id").limit(20).select(
        "source_id", "n_sessions", F.col("n").alias("n_history"), F.round("z", 6).alias("robust_z")
    )


@query("WITH " + SESSION + " SELECT event_id, source_id, session::INT AS session, round(gap, 6) AS gap_h FROM sess", name="sessions")
def session_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sessionized(spark, sf_dir).select("event_id", "source_id", "session", "gap_h"), 6, "gap_h")


@query("WITH " + SESSION + """, h AS (SELECT source_id, session::INT AS session, sensor, count(*) AS n FROM sess GROUP BY ALL),
hh AS (SELECT source_id, session, string_agg(sensor || ':' || n, ',' ORDER BY sensor) AS sensors FROM h GROUP BY ALL)
SELECT source_id, session, n, epoch_us(a) AS start_us, epoch_us(b) AS end_us, sensors, 'EVT-' || source_id || '-' || lpad(session::VARCHAR, 3, '0') AS event_id FROM stab JOIN hh USING (source_id, session)""")
def session_aggs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = session_rows(spark, sf_dir)
    shown = F.array_join(F.transform("sensors", lambda s: F.concat_ws(":", s["sensor"], s["n"].cast("string"))), ",")
    return t.select(
        "source_id", "session", "n", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"),
        shown.alias("sensors"), sessions.event_id().alias("event_id"),
    )


@query("WITH " + SESSION + " SELECT source_id, session, round((epoch_us(a) - epoch_us(lag(b) OVER (PARTITION BY source_id ORDER BY session))) / 3.6e9, 6) AS gap_h FROM stab QUALIFY lag(b) OVER (PARTITION BY source_id ORDER BY session) IS NOT NULL")
def session_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sessions.session_gaps(session_rows(spark, sf_dir), "source_id").select("source_id", "session", "gap_h"), 6, "gap_h")


@query("WITH " + SESSION + f" SELECT CASE WHEN (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(b)) / 3.6e9 <= 36 THEN 'active' ELSE 'archived' END AS state, count(*) AS n FROM stab GROUP BY 1")
def event_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_rows(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"))


def _daily(how: str, sql: str):
    @query("WITH " + OBS + f" SELECT source_id, sensor, day::VARCHAR AS day, round({sql}(frp), 9) AS daily, count(*) AS n_obs FROM obs GROUP BY ALL", name=f"daily_agg_{how}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = stats.daily(obs(spark, sf_dir), ["source_id", "sensor"], "day", "frp", how)
        return rounded(d.withColumn("day", F.col("day").cast("string")), 9, "daily")


for _how, _sql in (("max", "max"), ("mean", "avg"), ("median", "median")):
    _daily(_how, _sql)

SPREAD = OBS + """, med AS (SELECT sensor, median(frp) AS m FROM obs WHERE frp IS NOT NULL GROUP BY 1),
spread AS (SELECT sensor, m, count(*) AS n, median(abs(frp - m)) AS mad, avg(abs(frp - m)) AS ad FROM obs JOIN med USING (sensor) WHERE frp IS NOT NULL GROUP BY ALL)"""


@query("WITH " + SPREAD + " SELECT sensor, n, round(m, 9) AS median, round(mad, 9) AS mad, round(ad, 9) AS mean_ad FROM spread")
def median_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.median_mad(obs(spark, sf_dir), ["sensor"], "frp"), 9, "median", "mad", "mean_ad")


@query("WITH " + OBS + " SELECT source_id, count(*) AS n, round(min(frp), 6) AS min, round(quantile_cont(frp, 0.1), 6) AS p10, round(median(frp), 6) AS median, round(quantile_cont(frp, 0.9), 6) AS p90, round(max(frp), 6) AS max FROM obs WHERE frp IS NOT NULL GROUP BY 1")
def percentile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.summary(obs(spark, sf_dir), ["source_id"], "frp"), 6, "min", "p10", "median", "p90", "max")


@query("WITH " + SPREAD + " SELECT event_id, round(CASE WHEN mad > 1e-9 THEN 0.6745::DOUBLE * (frp - m) / mad WHEN ad > 1e-9 THEN (frp - m) / (1.253314::DOUBLE * ad) END, 6) AS z FROM obs JOIN spread USING (sensor) WHERE frp IS NOT NULL")
def robust_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir).where("frp IS NOT NULL")
    s = stats.median_mad(o, ["sensor"], "frp")
    z = stats.robust_score(F.col("frp"), F.col("median"), F.col("mad"), F.col("mean_ad"))
    return o.join(F.broadcast(s), "sensor").select("event_id", F.round(z, 6).alias("z"))  # a row for each sensor


@query("WITH " + OBS + ", l AS (SELECT source_id, list(frp) AS ref FROM obs WHERE frp IS NOT NULL GROUP BY 1) SELECT source_id, round(len(list_filter(ref, lambda x: x <= 20))::DOUBLE / len(ref), 6) AS share FROM l")
def empirical_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.share_at_most(obs(spark, sf_dir), ["source_id"], "frp", F.lit(20.0))
    return s.select("source_id", F.round("share", 6).alias("share"))


LOO = OBS + """, d AS (SELECT source_id, day, max(frp) AS v FROM obs WHERE frp IS NOT NULL GROUP BY ALL),
pairs AS (SELECT a.source_id, a.day, a.v, b.v AS o FROM d a JOIN d b ON a.source_id = b.source_id AND a.day <> b.day),
med AS (SELECT source_id, day, v, median(o) AS m, count(*) AS n FROM pairs GROUP BY ALL),
sp AS (SELECT p.source_id, p.day, p.v, m, median(abs(o - m)) AS mad, avg(abs(o - m)) AS ad FROM pairs p JOIN med USING (source_id, day, v) WHERE n >= 3 GROUP BY ALL),
zs AS (SELECT source_id, CASE WHEN mad > 1e-9 THEN 0.6745::DOUBLE * (v - m) / mad WHEN ad > 1e-9 THEN (v - m) / (1.253314::DOUBLE * ad) END AS z FROM sp)"""


@query("WITH " + LOO + " SELECT source_id, count(*) AS n, round(sum(greatest(0, z)), 5) AS total, round(max(greatest(0, z)), 5) AS peak FROM zs WHERE z IS NOT NULL GROUP BY 1")
def loo_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = stats.daily(obs(spark, sf_dir).where("frp IS NOT NULL"), ["source_id"], "day", "frp")
    v = d.groupBy("source_id").agg(F.array_sort(F.collect_list("daily")).alias("v"))
    z = v.select("source_id", F.explode(stats.leave_one_out(F.col("v"))).alias("z"))
    return z.groupBy("source_id").agg(F.count("*").alias("n"), F.round(F.sum("z"), 5).alias("total"), F.round(F.max("z"), 5).alias("peak"))


SEASON = "CASE WHEN month({0}) IN (1, 2) THEN 'winter' WHEN month({0}) IN (3, 4, 5) THEN 'pre-monsoon' WHEN month({0}) IN (6, 7, 8, 9) THEN 'monsoon' ELSE 'post-monsoon' END"
BASE = OBS + f""", o2 AS (SELECT *, event_id % 53 = 0 AS excluded FROM obs),
rec AS (SELECT source_id, sensor, day, max(frp) AS v, bool_or(excluded) AS x FROM o2 GROUP BY ALL),
lastd AS (SELECT source_id, max(day) AS td FROM obs GROUP BY 1),
tgt AS (SELECT source_id, td, first(sensor ORDER BY n DESC, sensor) AS tsensor FROM (SELECT o2.source_id, td, sensor, count(*) AS n FROM o2 JOIN lastd ON o2.source_id = lastd.source_id AND day = td GROUP BY ALL) GROUP BY ALL),
why AS (SELECT rec.*, td, tsensor, CASE WHEN day >= td THEN 'SAME_OR_LATER_DAY' WHEN sensor <> tsensor THEN 'DIFFERENT_SENSOR'
   WHEN {SEASON.format('day')} <> {SEASON.format('td')} THEN 'DIFFERENT_SEASON' WHEN x THEN 'EXTERNALLY_EXCLUDED' WHEN v IS NULL THEN 'FRP_MISSING' END AS reason FROM rec JOIN tgt USING (source_id))"""
BASE_PARAMS = baseline.BaselineParams(least_history=5)


def _with_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs(spark, sf_dir).withColumn("excluded", F.col("event_id") % 53 == 0)


@query("WITH " + BASE + " SELECT source_id, coalesce(reason, 'ELIGIBLE') AS reason, count(*) AS n FROM why GROUP BY ALL")
def baseline_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = baseline.daily_records(_with_exclusions(spark, sf_dir), "source_id", "day", "sensor", "frp", "excluded", BASE_PARAMS)
    return r.groupBy("source_id", F.coalesce("reason", F.lit("ELIGIBLE")).alias("reason")).agg(F.count("*").alias("n"))


@query("WITH " + BASE + """, el AS (SELECT source_id, v FROM why WHERE reason IS NULL), cur AS (SELECT t.source_id, max(frp) AS x FROM tgt t JOIN o2 ON o2.source_id = t.source_id AND day = td GROUP BY 1),
m AS (SELECT source_id, median(v) AS m, count(*) AS n FROM el GROUP BY 1),
sp AS (SELECT el.source_id, m, n, median(abs(v - m)) AS mad, avg(abs(v - m)) AS ad FROM el JOIN m USING (source_id) GROUP BY ALL),
j AS (SELECT cur.source_id, x, coalesce(n, 0)::INT AS n, CASE WHEN x IS NOT NULL AND n >= 5 THEN CASE WHEN mad > 1e-9 THEN 0.6745::DOUBLE * (x - m) / mad WHEN ad > 1e-9 THEN (x - m) / (1.253314::DOUBLE * ad) END END AS z FROM cur LEFT JOIN sp USING (source_id))
SELECT source_id, n AS n_eligible, round(z, 6) AS robust_z, CASE WHEN x IS NULL THEN 'TARGET_FRP_MISSING' WHEN n < 5 THEN 'INSUFFICIENT_HISTORY' WHEN z IS NULL THEN 'DEGENERATE_BASELINE' ELSE 'OK' END AS status FROM j""")
def baseline_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = baseline.baseline(_with_exclusions(spark, sf_dir), "source_id", "day", "sensor", "frp", "excluded", BASE_PARAMS)
    return rounded(b.select("source_id", "n_eligible", "robust_z", "status"), 6, "robust_z")


GAPS = OBS + ", days AS (SELECT DISTINCT source_id, day FROM obs), g AS (SELECT source_id, day, date_diff('day', lag(day) OVER (PARTITION BY source_id ORDER BY day), day) AS gap FROM days)"


@query("WITH " + GAPS + """, b AS (SELECT source_id, count(*) AS n_obs, count(DISTINCT day) AS active_days, (max(day) - min(day) + 1)::INT AS span_days, median(frp) AS vm, max(frp) AS vx FROM obs GROUP BY 1),
q AS (SELECT source_id, median(gap) AS gm, quantile_cont(gap, 0.9) AS g9, max(gap)::INT AS gx FROM g WHERE gap IS NOT NULL GROUP BY 1)
SELECT source_id, n_obs, active_days, span_days, round(vm, 6) AS value_median, round(vx, 6) AS value_max, round(gm, 6) AS gap_median, round(g9, 6) AS gap_p90, gx AS gap_max,
 CASE WHEN active_days <= 2 AND span_days <= 3 THEN 'TRANSIENT' WHEN active_days >= 5 AND span_days >= 14 THEN 'RECURRENT_DETECTIONS' ELSE 'INSUFFICIENT_TIME_BASE' END AS recurrence FROM b LEFT JOIN q USING (source_id)""")
def source_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(baseline.profile(obs(spark, sf_dir), "source_id", "day", "frp"), 6, "value_median", "value_max", "gap_median", "gap_p90")


@query("WITH " + GAPS + " SELECT source_id, day::VARCHAR AS day, gap::INT AS gap_days FROM g WHERE gap IS NOT NULL")
def day_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = sessions.day_gaps(obs(spark, sf_dir), "source_id", "day")
    return g.withColumn("day", F.col("day").cast("string"))


@query("WITH " + OBS + " SELECT event_id, round((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 8.64e10, 6) AS gap_days FROM obs WINDOW w AS (PARTITION BY source_id ORDER BY ts, event_id) QUALIFY lag(ts) OVER w IS NOT NULL")
def observation_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = sessions.observation_gaps(obs(spark, sf_dir), "source_id", "ts", ["event_id"])
    return rounded(g.select("event_id", "gap_days"), 6, "gap_days")


#: Observations without some whole days, so that streams have gaps.
THIN = OBS + """, thin AS (SELECT * FROM obs WHERE (day(ts) * 7 + length(sensor)) % 4 <> 0),
c AS (SELECT sensor, day, count(*) AS n_obs FROM thin GROUP BY ALL), span AS (SELECT sensor, min(day) AS a, max(day) AS b FROM c GROUP BY 1),
led AS (SELECT s.sensor, s.d AS day, n_obs, CASE WHEN n_obs >= 1 THEN 'OBSERVED' ELSE 'NO_ROWS_UNVERIFIED' END AS status
        FROM (SELECT sensor, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS d FROM span) s LEFT JOIN c ON c.sensor = s.sensor AND c.day = s.d)"""


def thin_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir).where((F.dayofmonth("ts") * 7 + F.length("sensor")) % 4 != 0)
    return coverage.ledger(o, "sensor", "day")


@query("WITH " + THIN + " SELECT sensor, day::VARCHAR AS day, n_obs, status FROM led")
def coverage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thin_ledger(spark, sf_dir).withColumn("day", F.col("day").cast("string"))


@query("WITH " + THIN + ", i AS (SELECT sensor, day, day - (row_number() OVER (PARTITION BY sensor ORDER BY day))::INT AS k FROM led WHERE status <> 'OBSERVED') SELECT sensor, min(day)::VARCHAR AS first, max(day)::VARCHAR AS last, count(*) AS n_days FROM i GROUP BY sensor, k")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = coverage.gaps(thin_ledger(spark, sf_dir), "sensor", "day")
    return g.withColumns({"first": F.col("first").cast("string"), "last": F.col("last").cast("string")})


@query("WITH " + THIN + " SELECT sensor, count(*) AS span_days, count(*) FILTER (status = 'OBSERVED') AS observed_days, count(*) FILTER (status <> 'OBSERVED') AS gap_days FROM led GROUP BY 1")
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.coverage_summary(thin_ledger(spark, sf_dir), "sensor")


@query("WITH " + THIN + """, w AS (SELECT source_id, min(day) AS a, max(day) AS b FROM obs GROUP BY 1), d AS (SELECT source_id, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM w),
s AS (SELECT DISTINCT day FROM led WHERE status = 'OBSERVED' AND sensor IN ('view', 'click'))
SELECT source_id, count(s.day) AS covered_days, count(*) - count(s.day) AS unverified_days FROM d LEFT JOIN s USING (day) GROUP BY 1""")
def coverage_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = obs(spark, sf_dir).groupBy("source_id").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    led = thin_ledger(spark, sf_dir).where(F.col("sensor").isin("view", "click"))
    return coverage.window_coverage(w, led, "a", "b", "day", ["source_id"])


@query("WITH " + OBS + " SELECT source_id, count(*) FILTER (day BETWEEN DATE '2024-01-05' AND DATE '2024-01-19') AS n_window, max(frp) FILTER (day BETWEEN DATE '2024-01-05' AND DATE '2024-01-19') AS frp_max, round((epoch_us(TIMESTAMP '2024-01-20 06:00:00') - epoch_us(max(ts))) / 3.6e9, 6) AS hours_since_last FROM obs WHERE ts <= TIMESTAMP '2024-01-20 06:00:00' GROUP BY 1")
def asof_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    moment = F.lit("2024-01-20 06:00:00").cast("timestamp")
    seen = coverage.as_of(obs(spark, sf_dir), "ts", moment)
    inside = F.col("day").between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-19").cast("date"))
    return seen.groupBy("source_id").agg(
        F.count_if(inside).alias("n_window"), F.max(F.when(inside, F.col("frp"))).alias("frp_max"),
        F.round((F.unix_micros(moment) - F.unix_micros(F.max("ts"))) / 3.6e9, 6).alias("hours_since_last"),
    )


CHANCES = OBS + """, det AS (SELECT source_id, day, max(day) OVER (PARTITION BY source_id) AS e FROM (SELECT DISTINCT source_id, day FROM obs WHERE event_id % 2 = 0)),
pos AS (SELECT DISTINCT source_id, day FROM obs WHERE source_id % 5 <> 0)"""


def _chances(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = obs(spark, sf_dir)
    hits = o.where("event_id % 2 = 0").select("source_id", "day").distinct()
    ends = hits.groupBy("source_id").agg(F.max("day").alias("e"), F.min("day").alias("first"))
    return hits.join(ends, "source_id"), o.where("source_id % 5 <> 0").select("source_id", "day").distinct()


@query("WITH " + CHANCES + """, u AS (SELECT source_id, day FROM det UNION SELECT p.source_id, p.day FROM pos p WHERE source_id IN (SELECT source_id FROM det)), ends AS (SELECT DISTINCT source_id, e FROM det),
k AS (SELECT u.source_id, count(*) AS possible_days, count(d.day) AS detect_days FROM u JOIN ends USING (source_id) LEFT JOIN det d ON d.source_id = u.source_id AND d.day = u.day WHERE u.day BETWEEN ends.e - 13 AND ends.e GROUP BY 1)
SELECT ends.source_id, detect_days, possible_days, CASE WHEN ends.source_id NOT IN (SELECT source_id FROM pos) THEN 'OBSERVATION_OPPORTUNITY_UNKNOWN' WHEN coalesce(possible_days, 0) = 0 THEN 'NO_VALID_OPPORTUNITIES' ELSE 'OK' END AS status,
 CASE WHEN ends.source_id IN (SELECT source_id FROM pos) AND possible_days > 0 THEN round(detect_days / possible_days::DOUBLE, 6) END AS onrr FROM ends LEFT JOIN k USING (source_id)""")
def onrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, possible = _chances(spark, sf_dir)
    r = coverage.recurrence_rate(hits, possible, "source_id", "day", "e", 14)
    return rounded(r.select("source_id", "detect_days", "possible_days", "status", "onrr"), 6, "onrr")


def scores(of: str, key: str, value: str, x: str) -> str:
    """SQL of robust scores of ``x`` against the values of ``of`` by ``key``, as (key, z, n)."""
    return (
        f"(SELECT {key}, n, CASE WHEN mad > 1e-9 THEN 0.6745::DOUBLE * (x - m) / mad WHEN ad > 1e-9 THEN (x - m) / (1.253314::DOUBLE * ad) END AS z FROM ("
        f"SELECT {key}, {x} AS x, m, n, median(abs({value} - m)) AS mad, avg(abs({value} - m)) AS ad FROM {of} JOIN (SELECT {key}, median({value}) AS m, count(*) AS n FROM {of} GROUP BY ALL) USING ({key}) GROUP BY ALL))"
    )


#: SQL of persistence from det (source_id, day) and pos (source_id, day), windows of two days, five at least.
PERSISTENCE = """, own AS (SELECT source_id, max(day) AS e, min(day) AS f FROM det GROUP BY 1),
both_days AS (SELECT source_id, day FROM det UNION SELECT source_id, day FROM pos),
rate AS (SELECT u.source_id, (e - u.day) // 2 AS k, count(d.day)::DOUBLE / count(*) AS r FROM both_days u JOIN own USING (source_id) LEFT JOIN (SELECT DISTINCT source_id, day FROM det) d ON d.source_id = u.source_id AND d.day = u.day
  WHERE u.day <= e AND u.source_id IN (SELECT source_id FROM pos) AND e - ((e - u.day) // 2 * 2)::INT >= f AND (e - u.day) // 2 <= 24 GROUP BY ALL),
now AS (SELECT source_id, r AS x FROM rate WHERE k = 0), past AS (SELECT source_id, rate.k, r, x FROM rate JOIN now USING (source_id) WHERE rate.k > 0),
pz AS """ + scores("past", "source_id", "r", "x") + """,
others AS (SELECT a.source_id, a.k, a.r AS x, b.r FROM past a JOIN past b ON a.source_id = b.source_id AND a.k <> b.k),
lz AS """ + scores("others", "source_id, k", "r", "x") + """,
share AS (SELECT l.source_id, count(*) AS n, count(*) FILTER (greatest(0, l.z) <= greatest(0, pz.z) + 1e-12) AS below FROM lz l JOIN pz USING (source_id) WHERE l.n >= 3 AND l.z IS NOT NULL GROUP BY 1),
persist AS (SELECT own.source_id, x AS onrr, coalesce(pz.n, 0)::INT AS n_windows,
  CASE WHEN x IS NULL THEN 'OBSERVATION_OPPORTUNITY_UNKNOWN' WHEN coalesce(pz.n, 0) < 5 THEN 'INSUFFICIENT_HISTORY' WHEN pz.z IS NULL THEN 'DEGENERATE_BASELINE' ELSE 'OK' END AS p_status,
  CASE WHEN pz.n >= 5 THEN pz.z END AS p_z, CASE WHEN pz.n >= 5 AND pz.z IS NOT NULL AND share.n >= 5 THEN below / share.n::DOUBLE END AS p_norm
  FROM own LEFT JOIN now USING (source_id) LEFT JOIN pz USING (source_id) LEFT JOIN share USING (source_id))"""


@query("WITH " + CHANCES + PERSISTENCE + " SELECT source_id, round(onrr, 6) AS onrr, n_windows, p_status, round(p_z, 6) AS p_z, round(p_norm, 6) AS p_norm FROM persist")
def persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's recurrence rate against its own earlier windows of two days."""
    hits, possible = _chances(spark, sf_dir)
    rates = coverage.window_rates(hits, possible, "source_id", "day", 2, 24)
    return rounded(assess.persistence(hits, rates, "source_id", assess.AssessParams(least_windows=5)), 6, "onrr", "p_z", "p_norm")


@query("WITH " + CHANCES + ", ends AS (SELECT source_id, max(e) AS e, min(day) AS f FROM det GROUP BY 1), k AS (SELECT source_id, e, f, unnest(range(1, 7))::INT AS k FROM ends) SELECT source_id, k, (e - k * 5 - 4)::VARCHAR AS window_from, (e - k * 5)::VARCHAR AS window_to FROM k WHERE e - k * 5 >= f")
def onrr_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, _ = _chances(spark, sf_dir)
    ends = hits.select("source_id", "e", "first").distinct()
    w = coverage.past_windows(ends, "source_id", "e", "first", 5, 6)
    return w.withColumns({"window_from": F.col("window_from").cast("string"), "window_to": F.col("window_to").cast("string")})


@query("WITH " + OBS + ", m AS (SELECT source_id, month(ts)::INT AS month, count(*) AS n FROM obs GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY n DESC, month) AS k, n / sum(n) OVER (PARTITION BY source_id) AS share FROM m) SELECT source_id, month, round(share, 6) AS share FROM r WHERE k = 1")
def modal_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(activity.modal_month(obs(spark, sf_dir), "source_id", "ts"), 6, "share")


@query("WITH " + OBS + " SELECT source_id, round(CASE WHEN avg(frp) <= 0 THEN 0 ELSE stddev_pop(frp) / avg(frp) END, 6) AS cv, round(count(*) / count(DISTINCT day)::DOUBLE, 6) AS per_active_day FROM obs GROUP BY 1")
def cv_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(activity.variation(obs(spark, sf_dir), "source_id", "ts", "frp"), 6, "cv", "per_active_day")


@query("WITH " + ACTIVITY + f" SELECT CASE WHEN event_count = 1 THEN 'EPISODIC' WHEN event_count < 10 THEN 'RECURRENT' WHEN date_diff('day', first_seen, last_seen) >= 90 THEN 'PERSISTENT' ELSE 'OTHER' END AS tier, {SEASON.format('last_seen')} AS season, count(*) AS n FROM act GROUP BY ALL")
def source_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.catalog.base import source_activity

    a = source_activity(spark, sf_dir)
    span = (F.unix_micros("last_seen") - F.unix_micros("first_seen")) / 8.64e10
    return a.groupBy(tier(F.col("event_count"), span).alias("tier"), season(F.month("last_seen")).alias("season")).agg(F.count("*").alias("n"))
