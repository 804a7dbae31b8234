"""Queries of packets, contracts and client rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.catalog.base import (
    ACTIVITY, OBS, POINTS, RULES, SITES, alerts, km, obs, points, query, rounded, sites, source_activity, table,
)
from pointloom.operators import contract, coverage, legacy, packets, projections, relate

DETECTIONS = OBS + """, det AS (SELECT source_id, ts, event_id, lat, lon, coalesce(frp, 0) AS frp, 300 + conf * 0.7::DOUBLE AS ti4,
  CASE WHEN conf >= 80 THEN 'h' WHEN conf >= 30 THEN 'n' ELSE 'l' END AS conf, CASE WHEN night THEN 'N' ELSE 'D' END AS dn,
  ['N', 'N20', 'N21'][(event_id % 3)::INT + 1] AS sat, CASE WHEN event_id % 4 = 0 THEN 'VIIRS_NOAA20_NRT' ELSE 'VIIRS_SNPP_SP' END AS product FROM obs)"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir)
    sat = F.get(F.array(F.lit("N"), F.lit("N20"), F.lit("N21")), (F.col("event_id") % 3).cast("int"))
    return o.select(
        "source_id", "ts", "event_id", "lat", "lon", F.coalesce("frp", F.lit(0.0)).alias("frp"), (300 + F.col("conf") * 0.7).alias("ti4"),
        F.when(F.col("conf") >= 80, "h").when(F.col("conf") >= 30, "n").otherwise("l").alias("conf"),
        F.when(F.col("night"), "N").otherwise("D").alias("dn"), sat.alias("sat"),
        F.when(F.col("event_id") % 4 == 0, "VIIRS_NOAA20_NRT").otherwise("VIIRS_SNPP_SP").alias("product"),
    )


EVIDENCE = DETECTIONS + f""", g AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY source_id ORDER BY ts, event_id))) / 8.64e10::DOUBLE AS gap FROM det),
c AS (SELECT source_id, avg(lat) AS cla, avg(lon) AS clo FROM det GROUP BY 1),
m AS (SELECT source_id, max(n) AS modal FROM (SELECT source_id, month(ts) AS mo, count(*) AS n FROM det GROUP BY ALL) GROUP BY 1),
e AS (SELECT source_id, count(*) AS n, count(DISTINCT ts::DATE) AS days, (epoch_us(max(ts)) - epoch_us(min(ts))) / 8.64e10::DOUBLE AS dur, max(gap) AS max_gap, median(gap) AS med_gap,
  median(frp) AS frp_median, max(frp) AS frp_max, median(ti4) AS ti4_median, max(ti4) AS ti4_max, count(*) FILTER (ti4 >= 367) / count(*)::DOUBLE AS sat_frac,
  count(*) FILTER (dn = 'N') / count(*)::DOUBLE AS night_frac, count(*) FILTER (conf = 'h') / count(*)::DOUBLE AS high,
  max({km('cla', 'clo', 'lat', 'lon')}) * 1000 AS extent, string_agg(DISTINCT CASE sat WHEN 'N' THEN '1SNPP' WHEN 'N20' THEN '2N20' ELSE '3N21' END, '+' ORDER BY CASE sat WHEN 'N' THEN '1SNPP' WHEN 'N20' THEN '2N20' ELSE '3N21' END) AS mix
  FROM g JOIN c USING (source_id) GROUP BY source_id)"""


@query("WITH " + EVIDENCE + """ SELECT source_id, n AS observation_count, days AS active_days, round(dur, 6) AS duration_days, round(max_gap, 6) AS max_gap_d, round(med_gap, 6) AS median_gap_d,
  round(frp_median, 6) AS frp_median, round(frp_max, 6) AS frp_max, round(ti4_median, 6) AS ti4_median, round(ti4_max, 6) AS ti4_max, round(sat_frac, 6) AS ti4_sat_frac, round(night_frac, 6) AS night_frac,
  round(high, 6) AS conf_high_frac, round(days / (ceil(dur) + 1), 6) AS span_frac, round(modal / n::DOUBLE, 6) AS modal_month_frac, round(extent, 3) AS spatial_extent_m, regexp_replace(mix, '[123](SNPP|N20|N21)', '\\1', 'g') AS sat_mix FROM e JOIN m USING (source_id)""")
def packet_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = packets.evidence(detections(spark, sf_dir), "source_id", "ts", ["event_id"])
    e = e.drop("first_seen", "last_seen", "centroid_lat", "centroid_lon", *[f"n_obs_{name}" for name, _ in packets.SATELLITES])
    shares = ("duration_days", "max_gap_d", "median_gap_d", "frp_median", "frp_max", "ti4_median", "ti4_max", "ti4_sat_frac", "night_frac", "conf_high_frac", "span_frac", "modal_month_frac")
    return rounded(rounded(e, 6, *shares), 3, "spatial_extent_m")


@query("WITH " + DETECTIONS + " SELECT source_id, count(*) FILTER (product LIKE '%SP') AS n_sp, count(*) FILTER (product LIKE '%NRT') AS n_nrt FROM det GROUP BY 1")
def graded_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.graded_counts(detections(spark, sf_dir), "source_id", "product")


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    box = {f"bbox_{k}_{n}": f(k) for k in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))}
    return d.groupBy("source_id").agg(
        F.count("*").alias("n_obs"), F.countDistinct(F.to_date("ts")).alias("n_events"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.avg("lat").alias("centroid_lat"), F.avg("lon").alias("centroid_lon"), *[v.alias(k) for k, v in box.items()],
    )


REGISTRY = DETECTIONS + ", reg AS (SELECT source_id, count(*) AS n_obs, count(DISTINCT ts::DATE) AS n_events, min(ts) AS f, max(ts) AS l, avg(lat) AS cla, max(lat) - min(lat) AS dy, max(lon) - min(lon) AS dx FROM det GROUP BY 1)"


@query("WITH " + REGISTRY + " SELECT source_id, round((epoch_us(l) - epoch_us(f)) / 8.64e10::DOUBLE, 3) AS reg_span_days, n_obs AS reg_n_obs, n_events AS reg_n_events, round(n_obs / n_events::DOUBLE, 4) AS reg_obs_per_event, round(sqrt(pow(dy * 111320, 2) + pow(dx * 111320 * cos(radians(cla)), 2)), 1) AS reg_bbox_diag_m FROM reg")
def registry_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.registry_features(_registry(spark, sf_dir)).drop("centroid_lat", "centroid_lon", "first_seen", "last_seen")


@query("WITH " + REGISTRY + """, s AS (SELECT source_id, n_obs FROM reg WHERE source_id % 3 = 0), k AS (SELECT source_id % 4 AS label4, source_id FROM reg)
SELECT source_id, reg.n_obs AS reg_n_obs, s.n_obs AS n_sub, s.n_obs IS NOT NULL AS has_sub, CASE label4 WHEN 0 THEN 'STEEL' WHEN 1 THEN 'POWER' END AS label FROM reg LEFT JOIN s USING (source_id) JOIN k USING (source_id) WHERE label4 < 2""")
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = _registry(spark, sf_dir)
    sub = reg.where("source_id % 3 = 0").select("source_id", F.col("n_obs").alias("n_sub"))
    kind = F.get(F.array(*map(F.lit, ("STEEL", "POWER", "UNKNOWN", ""))), (F.col("source_id") % 4).cast("int"))
    features = packets.feature_table(reg, "source_id", sub=sub)
    rows = packets.training_rows(features, reg.select("source_id", kind.alias("label")), "source_id", "label")
    return rows.select("source_id", "reg_n_obs", "n_sub", "has_sub", "label")


def _packet(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    measures = packets.evidence(detections(spark, sf_dir), "source_id", "ts", ["event_id"])
    return packets.blinded(packets.packet(measures, _registry(spark, sf_dir), "source_id", b"salt"), "source_id")


@query("WITH u AS (SELECT count(DISTINCT user_id) AS n, count(DISTINCT user_id) FILTER (user_id % 50 = 0) AS less FROM events) SELECT unnest(['days_within_observations','first_has_all_ids','gap_within_duration','high_share','id_format','median_below_max','month_share','night_share','no_leak','saturated_share','second_has_all_ids','span_share','unique_ids']) AS \"check\", unnest([0,0,0,0,0,0,0,0,0,0,less,0,0])::BIGINT AS n_bad, unnest([true,true,true,true,true,true,true,true,true,true,less = 0,true,true]) AS ok FROM u")
def packet_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packet passes its checks; the second annotator's copy lacks every fiftieth source."""
    shown, key = _packet(spark, sf_dir)
    second = relate.restrict(shown, key.where("source_id % 50 <> 0"), "annotation_id")
    return packets.packet_checks(shown, shown, second)


#: Streams are the hours of the day at which events come; a day between a stream's first and last without one is unverified.
LEDGER = """seen AS (SELECT 'H' || strftime(ts, '%H') AS stream, ts::DATE AS day, count(*) AS n FROM events WHERE (user_id + dayofmonth(ts)) % 5 = 0 GROUP BY ALL),
spans AS (SELECT stream, min(day) AS a, max(day) AS b FROM seen GROUP BY 1),
days AS (SELECT stream, a, b, (a + i::INT)::DATE AS day FROM spans, range(0, datediff('day', a, b) + 1) t(i)),
ledger AS (SELECT stream, day::VARCHAR AS date, CASE WHEN n IS NULL THEN 'UNVERIFIED' ELSE 'OBSERVED' END AS status, CASE WHEN n IS NULL THEN 'NO_FILE_COVERS_DAY' WHEN n = 1 THEN 'ONE_ROW' ELSE 'ROWS_PRESENT' END AS reason, CASE WHEN day IN (a, b) THEN '1' ELSE '0' END AS span_boundary_day_partial_risk FROM days LEFT JOIN seen USING (stream, day))"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where((F.col("user_id") + F.dayofmonth("ts")) % 5 == 0)
    rows = e.select(F.concat(F.lit("H"), F.date_format("ts", "HH")).alias("stream"), F.to_date("ts").alias("day"))
    days = coverage.ledger(rows, "stream", "day")
    spans = days.groupBy("stream").agg(F.min("day").alias("_a"), F.max("day").alias("_b"))
    n = F.col("n_obs")
    return days.join(spans, "stream").select(
        "stream", F.col("day").cast("string").alias("date"), F.when(n.isNull(), "UNVERIFIED").otherwise("OBSERVED").alias("status"),
        F.when(n.isNull(), "NO_FILE_COVERS_DAY").when(n == 1, "ONE_ROW").otherwise("ROWS_PRESENT").alias("reason"),
        F.when(F.col("day").isin(F.col("_a"), F.col("_b")), "1").otherwise("0").alias("span_boundary_day_partial_risk"),
    )


@query("WITH " + LEDGER + ", r AS (SELECT stream, string_agg(reason || '=' || n, ',' ORDER BY reason) AS reasons FROM (SELECT stream, reason, count(*) AS n FROM ledger GROUP BY ALL) GROUP BY 1) SELECT stream, count(*) AS days, reasons, coalesce(string_agg(date, ',' ORDER BY date) FILTER (status <> 'OBSERVED'), '') AS unverified, string_agg(date, ',' ORDER BY date) FILTER (span_boundary_day_partial_risk = '1') AS partial FROM ledger JOIN r USING (stream) GROUP BY stream, reasons")
def coverage_by_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contract.coverage_by_stream(ledger(spark, sf_dir))
    reasons = F.array_join(F.transform("by_reason", lambda x: F.concat_ws("=", x["reason"], x["n"].cast("string"))), ",")
    return c.select("stream", "days", reasons.alias("reasons"), F.array_join("unverified_dates", ",").alias("unverified"), F.array_join("partial_boundary_days", ",").alias("partial"))


@query("WITH " + LEDGER + ", " + OBS + """, s AS (SELECT source_id, min(ts)::DATE AS a, max(ts)::DATE AS b FROM obs GROUP BY 1), d AS (SELECT date::DATE AS d FROM ledger WHERE stream = 'H03' AND status <> 'OBSERVED'),
u AS (SELECT source_id, count(d) AS n FROM s LEFT JOIN d ON d BETWEEN a AND b GROUP BY 1)
SELECT source_id, n AS unverified, 'Complete for NOAA-20 and NOAA-21; ' || CASE WHEN n > 0 THEN 'S-NPP has ' || n || ' unverified-coverage days in this window (missing data is not evidence of no fire)' ELSE 'S-NPP complete' END AS sentence FROM u""")
def coverage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = obs(spark, sf_dir).groupBy("source_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    u = contract.unverified_in_window(s, ledger(spark, sf_dir), "H03", "source_id", "a", "b")
    return u.withColumn("sentence", contract.coverage_sentence(F.col("unverified")))


HELD = ", held AS (SELECT source_id FROM tiered WHERE source_id % 25 = 0)"


def _held(scored: DataFrame) -> DataFrame:
    return scored.where("source_id % 25 = 0").select("source_id")


@query("WITH " + RULES + HELD + " SELECT source_id, row_number() OVER (ORDER BY alert_score DESC, source_id)::INT AS rank FROM tiered ANTI JOIN held USING (source_id) ORDER BY rank LIMIT 60")
def ranked_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = alerts(spark, sf_dir)
    return contract.ranked_sources(a, _held(a), "source_id", "alert_score", 60).select("source_id", "rank")


@query("WITH " + RULES + HELD + " SELECT count(*) AS sources_monitored, count(*) FILTER (rule_flag) AS pihs_candidates, count(*) FILTER (alert_tier = 'HIGH') AS alerts_high, count(*) FILTER (alert_tier = 'MEDIUM') AS alerts_medium, (SELECT count(*) FROM held) AS heldout_excluded FROM tiered ANTI JOIN held USING (source_id)")
def contract_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = alerts(spark, sf_dir)
    return contract.counters(a, _held(a), "source_id", "rule_flag", "alert_tier")


UI_POINTS = SITES + ", " + POINTS + """, mp AS (SELECT 'S' || point_id AS source_id, point_id::INT AS rank, CASE WHEN point_id % 40 = 0 THEN 0 ELSE lat END AS lat, CASE WHEN point_id % 40 = 0 THEN 0 ELSE lon END AS lon, ['HIGH', 'MEDIUM', 'low', NULL][(point_id % 4)::INT + 1] AS tier, point_id % 9 = 0 AS pihs, point_id FROM points),
src AS (SELECT 'S' || point_id AS source_id, lat AS s_lat, lon AS s_lon, CASE WHEN point_id % 2 = 0 THEN ' Supplier#' || printf('%09d', point_id % 30 + 1) || ' ' END AS near, ['STEEL_METAL', 'THERMAL_POWER', 'OTHER'][(point_id % 3)::INT + 1] AS cat FROM points WHERE point_id % 5 <> 0)"""


def _ui_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = points(spark, sf_dir), F.col("point_id")
    sid = F.concat(F.lit("S"), k.cast("string")).alias("source_id")
    zero = lambda c: F.when(k % 40 == 0, 0.0).otherwise(F.col(c)).alias(c)
    pick = lambda names, n: F.get(F.array(*[F.lit(x) for x in names]), (k % n).cast("int"))
    mp = p.select(sid, k.cast("int").alias("rank"), zero("lat"), zero("lon"), pick(("HIGH", "MEDIUM", "low", None), 4).alias("tier"), (k % 9 == 0).alias("pihs"))
    name = F.concat(F.lit(" Supplier#"), F.format_string("%09d", k % 30 + 1), F.lit(" "))
    src = p.where("point_id % 5 <> 0").select(
        sid, F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), F.lit(None).cast("timestamp").alias("first_seen"), F.lit(None).cast("timestamp").alias("last_seen"),
        F.when(k % 2 == 0, name).alias("nearest_facility"), pick(("STEEL_METAL", "THERMAL_POWER", "OTHER"), 3).alias("facility_category"), F.lit(1.5).alias("facility_km"),
    )
    fac = sites(spark, sf_dir).select(F.col("site_id").cast("string").alias("facility_id"), F.upper("site_name").alias("facility_name"))
    return projections.ui_events(mp, src, fac)


@query("WITH " + UI_POINTS + """ SELECT mp.source_id AS id, rank, CASE WHEN cat = 'STEEL_METAL' THEN 'steel' WHEN cat = 'THERMAL_POWER' THEN 'thermal_power' END AS industrial_type,
  CASE WHEN cat IN ('STEEL_METAL', 'THERMAL_POWER') THEN 'industrial' ELSE 'unknown' END AS class_key, lower(tier) AS severity, CASE WHEN src.s_lat IS NULL THEN 'real_ranked' ELSE 'real_detailed' END AS kind, site_id::VARCHAR AS facility_id, pihs AS persistent
FROM mp LEFT JOIN src USING (source_id) LEFT JOIN sites ON lower(trim(near)) = lower(site_name) WHERE NOT (coalesce(src.s_lat, lat) = 0 AND coalesce(src.s_lon, lon) = 0)""")
def ui_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ui_events(spark, sf_dir).select("id", "rank", "industrial_type", "class_key", "severity", "kind", "facility_id", "persistent")


@query("WITH " + UI_POINTS + " SELECT mp.source_id AS id FROM mp LEFT JOIN src USING (source_id) WHERE lower(tier) IN ('high', 'medium') AND cat = 'STEEL_METAL' AND rank % 2 = 1 AND NOT (coalesce(s_lat, lat) = 0)")
def alerts_out_of_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = projections.alerts(_ui_events(spark, sf_dir))
    return projections.out_of_time(e, e.where("rank % 2 = 0"), F.col("industrial_type") == "steel").select("id")


@query("WITH " + SITES + ", " + POINTS + f" SELECT site_id, string_agg(point_id, ',' ORDER BY point_id) AS near FROM sites JOIN points ON abs(lat - s_lat) < 0.05 WHERE {km('s_lat', 's_lon', 'lat', 'lon')} <= 5 GROUP BY 1")
def nearby_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = sites(spark, sf_dir).select(F.col("site_id").alias("facility_id"), F.col("s_lat").alias("lat"), F.col("s_lon").alias("lon"))
    e = points(spark, sf_dir).select(F.col("point_id").alias("id"), F.col("point_id").alias("rank"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    n = projections.nearby_sources(f, e).where(F.size("near") > 0)
    return n.select(F.col("facility_id").alias("site_id"), F.array_join(F.transform("near", lambda x: x["event"].cast("string")), ",").alias("near"))


@query("WITH " + SITES + " SELECT site_id::VARCHAR AS id, kind AS type FROM sites WHERE kind <> 'COAL' AND lower(site_name || ' ' || kind) LIKE '%7%'")
def facility_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sites(spark, sf_dir).select(F.col("site_id").cast("string").alias("id"), F.col("site_name").alias("name"), F.col("kind").alias("type"), F.col("s_lat").alias("lat"), F.col("s_lon").alias("lon"))
    return projections.facility_list(projections.ui_facilities(s, F.lower("type")), ["steel", "oilgas"], " 7 ").select("id", "type")


@query("WITH " + RULES + " SELECT source_id, rule_score::BIGINT AS score, rule_flag AS flag, true AS agrees FROM tiered")
def rules_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = projections.rules_agree(alerts(spark, sf_dir)).withColumn("score", F.col("score").cast("long"))
    return a


@query("WITH " + RULES + " SELECT count(*) AS n, count(*) AS n_reconciled FROM tiered")
def alerts_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, same = projections.alert_sum()
    return alerts(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(same).alias("n_reconciled"))


@query("WITH " + ACTIVITY + " SELECT source_id, round(frp_max / nullif(frp_mean, 0), 6) AS frp_ratio, round(1 - night_frac, 6) AS day_share FROM act")
def thermal_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = source_activity(spark, sf_dir)
    r = projections.thermal_ratios(F.col("frp_max"), F.col("frp_mean"), F.col("night_frac"))
    return rounded(a.select("source_id", *[v.alias(k) for k, v in r.items()]), 6, "frp_ratio", "day_share")


@query("WITH " + OBS + """ SELECT event_id, printf('%.4f', abs(lat)) || '°N, ' || printf('%.4f', abs(lon)) || '°E' AS place, strftime(ts, '%Y-%m-%d %H:%M') || ' UTC' AS at,
 CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || ' min ago' WHEN m < 1440 THEN (m // 60) || ' h ago' ELSE (m // 1440) || ' d ago' END AS age FROM (SELECT *, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) // 60000000 AS m FROM obs)""")
def display_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return obs(spark, sf_dir).select(
        "event_id", projections.coordinate(F.col("lat"), F.col("lon")).alias("place"), projections.utc_text(F.col("ts")).alias("at"), projections.age_text(F.col("ts"), now).alias("age")
    )


@query("WITH i AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT07:05Z') WHEN 2 THEN strftime(o_orderdate, '  %Y-%m-%d 07:05:09 ') WHEN 3 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE strftime(o_orderdate, '%Y-%m-%d 27:05') END AS t, o_orderdate::DATE AS d FROM orders) SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN epoch_us(d::TIMESTAMP) WHEN 1 THEN epoch_us(d + INTERVAL '7:05:00' HOUR TO SECOND) WHEN 2 THEN epoch_us(d + INTERVAL 25509 SECOND) END AS us FROM i".replace("INTERVAL '7:05:00' HOUR TO SECOND", "INTERVAL 25500 SECOND"))
def utc_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 5
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    typed = (
        F.when(k == 0, day).when(k == 1, F.concat(day, F.lit("T07:05Z"))).when(k == 2, F.concat(F.lit("  "), day, F.lit(" 07:05:09 ")))
        .when(k == 3, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.concat(day, F.lit(" 27:05")))
    )
    return o.select("o_orderkey", F.unix_micros(projections.utc_input(typed)).alias("us"))


@query("WITH c AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority LIKE '1%', o_orderstatus = 'O' DESC, o_totalprice, o_orderkey)::INT AS place, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'O' DESC, o_orderkey) AS r FROM orders) SELECT o_custkey, o_orderkey, place FROM c WHERE r <= 4")
def evidence_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("group"), "o_orderkey", F.when(F.col("o_orderpriority").startswith("1"), " ").otherwise("url").alias("reference"),
        (F.col("o_orderstatus") == "O").alias("competing"), F.col("o_totalprice").alias("distance_km"),
    )
    placed = projections.in_order_of_offer(o, "o_orderkey")
    return projections.best_items(placed, "group", "competing", "o_orderkey").select(F.col("group").alias("o_custkey"), "o_orderkey", "place")


NAMES = {"view": "Viewed", "click": "Clicked", "purchase": "Bought"}


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'Viewed' WHEN 'click' THEN 'Clicked' WHEN 'purchase' THEN 'Bought' ELSE event_type END AS shown, event_type || '-' || printf('%06d', event_id) AS detection_id FROM events WHERE event_type = 'click'")
def shown_in_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = projections.in_state(table(spark, sf_dir, "events"), "click", "event_type")
    number = legacy.detection_id(F.col("event_type"), F.col("event_id"))
    return rows.select("event_id", projections.named(F.col("event_type"), NAMES).alias("shown"), number.alias("detection_id"))


@query("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS rank, event_id FROM events")
def ranked_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map points of one document are a short list; here one list for each user."""
    listed = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("points"))
    return listed.select("user_id", projections.ranked(F.col("points"))).select("user_id", "rank", F.col("point.event_id").alias("event_id"))
