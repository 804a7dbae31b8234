"""Queries over raw-looking observations: validation, keys, deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.catalog.base import OBS, obs, query, table
from pointloom.functions import fields, geo
from pointloom.operators import coverage, dedup, digest, relate, validate
from pointloom.plans.scratch import written
from pointloom.sources import observations as scan

#: Raw text rows with faults by modulus.
RAW = """raw AS (
  SELECT event_id AS row_number,
         CASE WHEN event_id % 101 = 0 THEN '' WHEN event_id % 103 = 0 THEN 'abc' WHEN event_id % 107 = 0 THEN '91'
              ELSE printf('%.5f', 8 + (user_id * 37 % 2900) / 100.0::DOUBLE) END AS latitude,
         printf('%.5f', 68 + (user_id * 53 % 2900) / 100.0::DOUBLE) AS longitude,
         CASE WHEN event_id % 109 = 0 THEN '' WHEN event_id % 113 = 0 THEN '2024-13-40'
              WHEN event_id % 127 = 0 THEN '1999-12-31' WHEN event_id % 131 = 0 THEN '2031-01-01' ELSE strftime(ts, '%Y-%m-%d') END AS acq_date,
         CAST(CAST(strftime(ts, '%H%M') AS INTEGER) AS VARCHAR) AS acq_time,
         CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN 'x' WHEN event_id % 17 = 0 THEN '-1'
              WHEN event_id % 19 = 0 THEN '0' WHEN event_id % 23 = 0 THEN '5001' ELSE printf('%.2f', value) END AS frp,
         CASE WHEN event_id % 29 = 0 THEN '149.9' WHEN event_id % 31 = 0 THEN '550' WHEN event_id % 37 = 0 THEN '?' ELSE '300' END AS brightness,
         CASE event_id % 9 WHEN 0 THEN 'l' WHEN 1 THEN 'n' WHEN 2 THEN 'h' WHEN 3 THEN '30' WHEN 4 THEN '79' WHEN 5 THEN '80'
              WHEN 6 THEN '101' WHEN 7 THEN '' ELSE '55' END AS confidence,
         CASE WHEN event_id % 4 = 0 THEN 'VIIRS' WHEN event_id % 4 = 1 THEN 'modis' WHEN event_id % 4 = 2 THEN 'VIIRS' ELSE NULL END AS instrument,
         CASE event_id % 5 WHEN 0 THEN 'NOAA-20' WHEN 1 THEN 'snpp' WHEN 2 THEN 'Aqua' WHEN 3 THEN '' ELSE 'N21' END AS satellite,
         CASE WHEN event_id % 41 = 0 THEN 'X' WHEN event_id % 2 = 0 THEN 'D' ELSE 'n' END AS daynight,
         event_id % 89 = 0 AS malformed, user_id
  FROM events)"""


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows as a file would hold them: written, so that no query computes them again in each use of a column."""
    return written(_raw(spark, sf_dir), "raw")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    i = F.col("event_id")

    def cases(*pairs, other):
        out = F.when(i % pairs[0][0] == pairs[0][1], pairs[0][2])
        for mod, rest, value in pairs[1:]:
            out = out.when(i % mod == rest, value)
        return out.otherwise(other)

    degrees = lambda start, factor: geo.decimals(start + (F.col("user_id") * factor % 2900) / 100, 5)
    return e.select(
        i.alias("row_number"),
        cases((101, 0, ""), (103, 0, "abc"), (107, 0, "91"), other=degrees(8, 37)).alias("latitude"),
        degrees(68, 53).alias("longitude"),
        cases((109, 0, ""), (113, 0, "2024-13-40"), (127, 0, "1999-12-31"), (131, 0, "2031-01-01"), other=F.date_format("ts", "yyyy-MM-dd")).alias("acq_date"),
        F.date_format("ts", "HHmm").cast("int").cast("string").alias("acq_time"),
        cases((11, 0, ""), (13, 0, "x"), (17, 0, "-1"), (19, 0, "0"), (23, 0, "5001"), other=geo.decimals(F.col("value"), 2)).alias("frp"),
        cases((29, 0, "149.9"), (31, 0, "550"), (37, 0, "?"), other=F.lit("300")).alias("brightness"),
        cases(*[(9, k, v) for k, v in enumerate(["l", "n", "h", "30", "79", "80", "101", ""])], other=F.lit("55")).alias("confidence"),
        cases((4, 0, "VIIRS"), (4, 1, "modis"), (4, 2, "VIIRS"), other=F.lit(None)).alias("instrument"),
        cases((5, 0, "NOAA-20"), (5, 1, "snpp"), (5, 2, "Aqua"), (5, 3, ""), other=F.lit("N21")).alias("satellite"),
        cases((41, 0, "X"), (2, 0, "D"), other=F.lit("n")).alias("daynight"),
        (i % 89 == 0).alias("malformed"),
        "user_id",
    )


REFERENCE = "2024-02-01 00:00:00"
TYPED = RAW + f""", parsed AS (
  SELECT *, try_cast(nullif(trim(latitude), '') AS DOUBLE) AS lat_v, try_cast(nullif(trim(longitude), '') AS DOUBLE) AS lon_v,
         try_strptime(nullif(acq_date, '') || ' ' || lpad(acq_time, 4, '0'), '%Y-%m-%d %H%M') AS stamp FROM raw),
reasoned AS (
  SELECT *, CASE WHEN malformed THEN 'MALFORMED_ROW' WHEN latitude = '' OR longitude = '' THEN 'MISSING_COORDINATES'
    WHEN lat_v IS NULL OR lon_v IS NULL OR lat_v NOT BETWEEN -90 AND 90 OR lon_v NOT BETWEEN -180 AND 180 THEN 'INVALID_COORDINATES'
    WHEN acq_date = '' THEN 'MISSING_DATE' WHEN stamp IS NULL THEN 'UNPARSEABLE_TIMESTAMP'
    WHEN stamp > TIMESTAMP '{REFERENCE}' + INTERVAL 1 HOUR THEN 'TIMESTAMP_IN_FUTURE'
    WHEN stamp < TIMESTAMP '2000-01-01' THEN 'TIMESTAMP_BEFORE_MISSION' END AS reason FROM parsed)"""


def reasoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = raw(spark, sf_dir).withColumn("stamp", fields.acquired(F.nullif("acq_date", F.lit("")), F.col("acq_time")))
    reason = validate.fatal_reason(
        F.col("malformed"), F.col("latitude"), F.col("longitude"), F.col("acq_date"), F.col("stamp"),
        F.lit(REFERENCE).cast("timestamp"),
    )
    return r.withColumn("reason", reason)


@query("WITH " + TYPED + " SELECT row_number, reason FROM reasoned WHERE reason IS NOT NULL")
def validate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasoned(spark, sf_dir).where("reason IS NOT NULL").select("row_number", "reason")


@query("WITH " + TYPED + " SELECT coalesce(reason, 'VALID') AS reason, count(*) AS n FROM reasoned GROUP BY 1")
def validation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasoned(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("VALID")).alias("reason")).agg(F.count("*").alias("n"))


AGAIN = RAW + """, raw2 AS (SELECT * REPLACE (coalesce(instrument, 'VIIRS') AS instrument) FROM raw
  UNION ALL SELECT * REPLACE (coalesce(instrument, 'VIIRS') AS instrument, row_number + 1000000000 AS row_number) FROM raw WHERE row_number % 10 = 0)""" + TYPED[len(RAW):].replace("FROM raw)", "FROM raw2)") + """,
seen AS (SELECT *, row_number() OVER same AS r, first_value(row_number) OVER same AS original FROM reasoned
  WINDOW same AS (PARTITION BY reason IS NULL, upper(instrument), nullif(satellite, ''), acq_date, stamp, lat_v, lon_v ORDER BY row_number))"""


@query("WITH " + AGAIN + """ SELECT row_number, CASE WHEN reason IS NULL AND r > 1 THEN 'DUPLICATE_EXACT' ELSE reason END AS reason, CASE WHEN reason IS NULL AND r > 1 THEN original END AS duplicate_of,
  CASE WHEN try_cast(frp AS DOUBLE) >= 0 THEN try_cast(frp AS DOUBLE) END AS frp_mw, CASE WHEN upper(daynight) IN ('D', 'N') THEN upper(daynight) END AS day_night FROM seen""")
def validated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every raw row through the whole validation, a tenth of them twice: reasons, exact repeats, kept values."""
    none, no = F.lit(None).cast("string"), F.lit(False)
    r = raw(spark, sf_dir).withColumns(
        {
            "instrument": F.coalesce("instrument", F.lit("VIIRS")), "data_mode": F.lit("NRT"), "source_file": F.lit("events.csv"), "has_ti4": no, "has_t31": no,
            "has_brightness": F.lit(True), "bright_ti4": none, "bright_ti5": none, "bright_t31": none, "scan": none, "track": none, "version": none,
        }
    )
    again = r.where("row_number % 10 = 0").withColumn("row_number", F.col("row_number") + 1_000_000_000)
    v = validate.validate(r.unionByName(again), F.lit(REFERENCE).cast("timestamp"))
    return v.select("row_number", "reason", "duplicate_of", "frp_mw", "day_night")


CONF = """conf AS (
  SELECT *, CASE lower(trim(confidence)) WHEN 'l' THEN 'low' WHEN 'n' THEN 'nominal' WHEN 'h' THEN 'high' END AS word,
         try_cast(nullif(trim(confidence), '') AS DOUBLE) AS num, upper(trim(instrument)) AS ins FROM raw),
parsed_conf AS (
  SELECT *, CASE WHEN trim(confidence) = '' THEN 'missing' WHEN word IS NOT NULL AND ins = 'MODIS' THEN 'semantics_mismatch'
      WHEN word IS NOT NULL THEN 'ok' WHEN num IS NULL OR num NOT BETWEEN 0 AND 100 THEN 'invalid'
      WHEN ins = 'VIIRS' AND num IN (30, 70, 95) THEN 'ok' WHEN ins = 'VIIRS' THEN 'semantics_mismatch'
      WHEN ins = 'MODIS' THEN 'ok' ELSE 'semantics_unknown' END AS status FROM conf)"""


@query(
    "WITH " + RAW + ", " + CONF + """
SELECT row_number, status,
  CASE WHEN status <> 'ok' THEN NULL WHEN word IS NOT NULL THEN word
       WHEN ins = 'VIIRS' THEN CASE num WHEN 30 THEN 'low' WHEN 70 THEN 'nominal' ELSE 'high' END
       WHEN num < 30 THEN 'low' WHEN num < 80 THEN 'nominal' ELSE 'high' END AS class,
  CASE WHEN status = 'ok' AND word IS NULL AND ins = 'MODIS' THEN num END AS pct
FROM parsed_conf"""
)
def confidence_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = raw(spark, sf_dir).withColumn("c", fields.confidence(F.col("confidence"), F.col("instrument")))
    return r.select("row_number", F.col("c.status").alias("status"), F.col("c.class").alias("class"), F.col("c.pct").alias("pct"))


@query(
    "WITH " + RAW + ", " + CONF + """, flagged AS (
  SELECT row_number, unnest([
    CASE WHEN try_cast(nullif(frp, '') AS DOUBLE) IS NULL AND frp <> '' THEN 'FRP_INVALID' END,
    CASE WHEN try_cast(frp AS DOUBLE) < 0 THEN 'FRP_NEGATIVE' END, CASE WHEN try_cast(frp AS DOUBLE) = 0 THEN 'FRP_ZERO' END,
    CASE WHEN try_cast(frp AS DOUBLE) > 5000 THEN 'FRP_SUSPICIOUS' END,
    CASE WHEN try_cast(brightness AS DOUBLE) IS NULL THEN 'BRIGHTNESS_INVALID' END,
    CASE WHEN try_cast(brightness AS DOUBLE) NOT BETWEEN 150 AND 550 THEN 'BRIGHTNESS_OUT_OF_RANGE' END,
    CASE status WHEN 'invalid' THEN 'CONFIDENCE_INVALID' WHEN 'semantics_mismatch' THEN 'CONFIDENCE_SEMANTICS_MISMATCH' WHEN 'semantics_unknown' THEN 'CONFIDENCE_SEMANTICS_UNKNOWN' END,
    CASE WHEN upper(daynight) NOT IN ('D', 'N') THEN 'DAYNIGHT_INVALID' END, CASE WHEN instrument IS NULL THEN 'SENSOR_UNKNOWN' END]) AS flag
  FROM parsed_conf)
SELECT flag, count(*) AS n, min(row_number) AS first_row FROM flagged WHERE flag IS NOT NULL GROUP BY flag"""
)
def field_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = raw(spark, sf_dir)
    flags = validate.field_flags(
        F.col("frp"), F.col("brightness"), fields.confidence(F.col("confidence"), F.col("instrument")), F.col("daynight"), F.col("instrument")
    )
    return r.select("row_number", F.explode(flags).alias("flag")).groupBy("flag").agg(
        F.count("*").alias("n"), F.min("row_number").alias("first_row")
    )


@query(
    "WITH " + RAW + """
SELECT row_number, CASE WHEN trim(frp) = '' THEN NULL WHEN try_cast(frp AS DOUBLE) >= 0 THEN try_cast(frp AS DOUBLE) END AS frp_mw,
       CASE WHEN try_cast(brightness AS DOUBLE) BETWEEN 150 AND 550 THEN try_cast(brightness AS DOUBLE) END AS brightness_k FROM raw"""
)
def kept_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir).select(
        "row_number", validate.kept_frp(F.col("frp")).alias("frp_mw"), validate.kept_brightness(F.col("brightness")).alias("brightness_k")
    )


SAT = """CASE upper(trim(satellite)) WHEN 'NOAA-21' THEN 'N21' WHEN 'NOAA21' THEN 'N21' WHEN 'NOAA-20' THEN 'N20' WHEN 'NOAA20' THEN 'N20'
  WHEN 'SUOMI-NPP' THEN 'N' WHEN 'SNPP' THEN 'N' WHEN 'NPP' THEN 'N' ELSE nullif(trim(satellite), '') END"""


@query(
    "WITH " + TYPED + f"""
SELECT row_number, 'PHYS|' || upper(coalesce(instrument, 'NA')) || '|' || coalesce({SAT}, 'NA') || '|' || strftime(stamp, '%Y%m%dT%H%M') || '|'
  || printf('%.5f', lat_v) || '|' || printf('%.5f', lon_v) AS physical_key FROM reasoned WHERE reason IS NULL"""
)
def physical_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reasoned(spark, sf_dir).where("reason IS NULL")
    key = fields.physical_key(F.col("instrument"), F.col("satellite"), F.col("stamp"), F.col("latitude").cast("double"), F.col("longitude").cast("double"))
    return r.select("row_number", key.alias("physical_key"))


@query(
    "WITH " + TYPED + """
SELECT row_number, concat_ws(':', 'HISTORICAL', coalesce(instrument, 'NA'), coalesce(nullif(satellite, ''), 'NA'), acq_date, acq_time,
  printf('%.5f', lat_v), printf('%.5f', lon_v)) AS observation_id FROM reasoned WHERE reason IS NULL"""
)
def obs_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reasoned(spark, sf_dir).where("reason IS NULL")
    key = fields.observation_id(
        F.lit("HISTORICAL"), F.col("instrument"), F.nullif("satellite", F.lit("")), F.col("acq_date"), F.col("acq_time"),
        F.col("latitude").cast("double"), F.col("longitude").cast("double"),
    )
    return r.select("row_number", key.alias("observation_id"))


@query("WITH " + RAW + f" SELECT coalesce({SAT}, 'NONE') AS satellite, nullif(concat_ws(' ', upper(instrument), {SAT}), '') AS label, count(*) AS n FROM raw GROUP BY 1, 2")
def sensor_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    sat = fields.satellite(F.col("satellite"))
    return raw(spark, sf_dir).groupBy(
        F.coalesce(sat, F.lit("NONE")).alias("satellite"), fields.sensor_label(F.upper("instrument"), sat).alias("label")
    ).agg(F.count("*").alias("n"))


#: Two deliveries of the same events; the second repeats a third of them, some with another value.
COPIES = OBS + """, copies AS (
  SELECT 'pk' || event_id AS pk, 'a.csv' AS file, event_id AS row_number, 'A' || event_id AS id, frp, sensor, 2 AS richness FROM obs
  UNION ALL
  SELECT 'pk' || event_id, CASE WHEN event_id % 12 = 0 THEN 'a.csv' ELSE 'b.csv' END, event_id + 1000000, 'B' || event_id,
         CASE WHEN event_id % 15 = 0 THEN frp + 1 WHEN event_id % 21 = 0 THEN NULL ELSE frp END, sensor, CASE WHEN event_id % 9 = 0 THEN 3 ELSE 2 END
  FROM obs WHERE event_id % 3 = 0)
, ranked AS (SELECT *, row_number() OVER w AS r, first_value(id) OVER w AS cid, first_value(file) OVER w AS cfile, first_value(frp) OVER w AS cfrp
  FROM copies WINDOW w AS (PARTITION BY pk ORDER BY richness DESC, file, row_number, id))"""


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, i = obs(spark, sf_dir), F.col("event_id")
    pk = F.concat(F.lit("pk"), i.cast("string")).alias("pk")
    a = o.select(pk, F.lit("a.csv").alias("file"), i.alias("row_number"), F.concat(F.lit("A"), i.cast("string")).alias("id"), "frp", "sensor", F.lit(2).alias("richness"))
    b = o.where(i % 3 == 0).select(
        pk, F.when(i % 12 == 0, "a.csv").otherwise("b.csv").alias("file"), (i + 1000000).alias("row_number"),
        F.concat(F.lit("B"), i.cast("string")).alias("id"),
        F.when(i % 15 == 0, F.col("frp") + 1).when(i % 21 == 0, F.lit(None)).otherwise(F.col("frp")).alias("frp"),
        "sensor", F.when(i % 9 == 0, 3).otherwise(2).alias("richness"),
    )
    return a.unionByName(b)


def deduped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return dedup.dedup_by_key(
        copies(spark, sf_dir), "pk", [F.desc("richness"), "file", "row_number", "id"], ["frp", "sensor"], {"frp"}, "file", "id"
    )


@query("WITH " + COPIES + " SELECT pk, id, file, frp FROM ranked WHERE r = 1")
def dedup_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduped(spark, sf_dir)[0].select("pk", "id", "file", "frp")


RELATION = "CASE WHEN abs(frp - cfrp) > 1e-6 THEN 'ATTRIBUTE_CONFLICT' WHEN file = cfile THEN 'SAME_FILE_REPEAT' ELSE 'IDENTICAL_COPY' END"


@query("WITH " + COPIES + f" SELECT pk, cid AS canonical_id, id AS alias_id, {RELATION} AS relation, CASE WHEN abs(frp - cfrp) > 1e-6 THEN 'frp' ELSE '' END AS conflicts FROM ranked WHERE r > 1")
def alias_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduped(spark, sf_dir)[1].select("pk", "canonical_id", "alias_id", "relation", F.array_join("conflicts", ",").alias("conflicts"))


@query("WITH " + COPIES + f" SELECT cfile AS canonical_file, file AS alias_file, {RELATION} AS relation, count(*) AS n FROM ranked WHERE r > 1 GROUP BY ALL")
def dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.file_pairs(deduped(spark, sf_dir)[1])


@query("WITH " + COPIES + ", f AS (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY file, row_number) AS k FROM copies) SELECT pk, id FROM f WHERE k = 1")
def dedup_first_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.keep_first(copies(spark, sf_dir), ["pk"], ["file", "row_number"]).select("pk", "id")


@query(
    "WITH " + OBS + """, k AS (SELECT *, row_number() OVER (PARTITION BY sensor, printf('%.3f', lat), printf('%.3f', lon), strftime(ts, '%Y-%m-%d %H:%M') ORDER BY event_id) AS r FROM obs)
SELECT event_id FROM k WHERE r = 1"""
)
def dedup_minute_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir).withColumns(
        {"a": geo.decimals(F.col("lat"), 3), "b": geo.decimals(F.col("lon"), 3), "m": F.date_format("ts", "yyyy-MM-dd HH:mm")}
    )
    return dedup.keep_first(o, ["sensor", "a", "b", "m"], ["event_id"]).select("event_id")


@query("WITH " + COPIES + ", v AS (SELECT pk, count(DISTINCT coalesce(frp::VARCHAR, 'null') || sensor) AS n FROM copies GROUP BY pk) SELECT pk FROM v WHERE n = 1")
def usable_facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.usable_records(copies(spark, sf_dir), "pk", ["frp", "sensor"]).select("pk")


@query("WITH " + OBS + " SELECT sensor, count(*) FILTER (ts <= TIMESTAMP '2024-01-15 12:00:00') AS known, count(*) FILTER (ts > TIMESTAMP '2024-01-15 12:00:00') AS hidden FROM obs GROUP BY sensor")
def asof_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, moment = obs(spark, sf_dir), F.lit("2024-01-15 12:00:00").cast("timestamp")
    known = coverage.as_of(o, "ts", moment).groupBy("sensor").agg(F.count("*").alias("known"))
    total = o.groupBy("sensor").agg(F.count("*").alias("n"))
    return total.join(known, "sensor", "left").select(
        "sensor", F.coalesce("known", F.lit(0)).alias("known"), (F.col("n") - F.coalesce("known", F.lit(0))).alias("hidden")
    )


@query("WITH " + OBS + ", m AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'NRT' ELSE 'HISTORICAL' END AS data_mode FROM obs) SELECT data_mode, count(*) AS n, (SELECT count(DISTINCT data_mode) FROM m) > 1 AS mixed FROM m GROUP BY 1")
def mode_guard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = obs(spark, sf_dir).select(F.when(F.col("event_id") % 2 == 0, "NRT").otherwise("HISTORICAL").alias("data_mode"))
    counts = m.groupBy("data_mode").agg(F.count("*").alias("n"))
    total = counts.agg((F.count("*") > 1).alias("mixed"))
    return counts.crossJoin(F.broadcast(total))  # one row


@query("WITH " + OBS + " SELECT event_id, printf('%.5f', lat) AS lat5, printf('%.5f', lon) AS lon5, floor(lat / 0.01)::BIGINT AS cell_y, floor(lon / 0.01)::BIGINT AS cell_x, 'N' || lpad((floor(lat / 3) * 3)::INT::VARCHAR, 2, '0') || 'E' || lpad((floor(lon / 3) * 3)::INT::VARCHAR, 3, '0') AS land_tile FROM obs")
def coordinate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs(spark, sf_dir).select(
        "event_id", geo.coord5(F.col("lat")).alias("lat5"), geo.coord5(F.col("lon")).alias("lon5"),
        geo.cell(F.col("lat"), 0.01).alias("cell_y"), geo.cell(F.col("lon"), 0.01).alias("cell_x"),
        geo.land_tile(F.col("lat"), F.col("lon")).alias("land_tile"),
    )


@query("SELECT event_id, event_type, NULL::DOUBLE AS extra FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, NULL, value FROM events WHERE event_id % 2 = 1")
def union_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return scan.concat(
        [e.where("event_id % 2 = 0").select("event_id", "event_type"), e.where("event_id % 2 = 1").select("event_id", F.col("value").alias("extra"))]
    )


@query("WITH a AS (SELECT DISTINCT user_id AS k FROM events), b AS (SELECT DISTINCT c_custkey AS k FROM customer) SELECT 'both' AS part, count(*) AS n FROM a JOIN b USING (k) UNION ALL SELECT 'left_only', count(*) FROM a ANTI JOIN b USING (k) UNION ALL SELECT 'right_only', count(*) FROM b ANTI JOIN a USING (k) UNION ALL SELECT 'either', count(*) FROM (FROM a UNION FROM b)")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return relate.set_parts(a, b, "k")


@query("SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) // 10 AS bucket, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1")
def json_contract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k int"))
    return e.groupBy(F.floor(F.col("p.k") / 10).cast("int").alias("bucket")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("SELECT c_custkey, '{\"id\":' || c_custkey || ',\"name\":\"' || c_name || '\",\"segment\":\"' || c_mktsegment || '\"}' AS line FROM customer")
def canonical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    line = digest.canonical_json({"segment": F.col("c_mktsegment"), "name": F.col("c_name"), "id": F.col("c_custkey")})
    return c.select("c_custkey", line.alias("line"))


@query("SELECT " + ", ".join(f"sum(('0x' || substr(sha256(c_name), {8 * k + 1}, 8))::BIGINT)::BIGINT AS limb{k}" for k in range(8)) + " FROM customer")
def multiset_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.limb_sums(table(spark, sf_dir, "customer"), F.col("c_name"))
