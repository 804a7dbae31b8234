"""Boundaries, missing values, row order and brute force of the operators."""

import hashlib
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointloom.functions import fields, geo
from pointloom.operators import (
    activity, attribution, baseline, context, coverage, dedup, digest, facility, formation, geojoin, graph, live,
    ml, research, sessions, stats, validate, views,
)
from pointloom.plans.numbering import number_within
from pointloom.plans.ranges import range_of
from pointloom.plans.scratch import written
from pointloom.sources import observations as scan
from pointloom.sources import sinks


def times(spark, rows):
    return spark.createDataFrame(rows, "k string, s long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))


def test_session_gap_of_exactly_36_hours_stays(spark):
    df = times(spark, [("a", 1, "2024-01-01 00:00:00"), ("b", 1, "2024-01-02 12:00:00"), ("c", 1, "2024-01-04 00:00:01")])
    got = {r["k"]: r["session"] for r in sessions.sessionize(df, "s", "ts", ["k"]).collect()}
    assert got == {"a": 1, "b": 1, "c": 2}


def test_event_ids_keep_more_than_three_digits(spark):
    df = spark.createDataFrame([(1, 7), (1, 1234)], "source_id long, session int")
    assert [r[0] for r in df.select(sessions.event_id()).collect()] == ["EVT-1-007", "EVT-1-1234"]


def brute(a, b, km):
    out = set()
    for i, la, lo in a:
        for j, lb, ob in b:
            h = math.sin(math.radians(lb - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(lb)) * math.sin(math.radians(ob - lo) / 2) ** 2
            if 2 * geo.EARTH_KM * math.asin(min(1, math.sqrt(h))) <= km:
                out.add((i, j))
    return out


@pytest.mark.parametrize("km", [0.375, 5.0, 120.0])
def test_grid_join_equals_brute_force(spark, km):
    rng = random.Random(3)
    spread = km / 40
    make = lambda n: [(k, c + rng.uniform(-spread, spread), rng.uniform(-spread, spread) * 2) for k in range(n) for c in [rng.choice([-33.0, 0.0, 21.0, 68.0])]]
    a, b = make(150), make(150)
    left = spark.createDataFrame(a, "i long, la double, lo double")
    right = spark.createDataFrame(b, "j long, lb double, ob double")
    got = geojoin.grid_join(left, right, km, ("la", "lo"), ("lb", "ob"))
    rows = [(r["i"], r["j"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(a, b, km)


def test_nearest_ties_go_to_the_smaller_key(spark):
    pairs = spark.createDataFrame([("p", "b", 1.0), ("p", "a", 1.0), ("p", "c", 2.0)], "p string, s string, distance_km double")
    assert geojoin.nearest(pairs, "p", "s").first()["s"] == "a"


def cloud(spark, n=160, seed=5):
    rng = random.Random(seed)
    rows = [
        (f"k{i:04d}", f"2024-01-{1 + i % 28:02d} {rng.randrange(24):02d}:{rng.randrange(60):02d}:00", 21 + rng.gauss(0, 0.01), 78 + rng.gauss(0, 0.01))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "pk string, ts string, lat double, lon double").withColumn("ts", F.col("ts").cast("timestamp"))


def plain_formation(rows, p=formation.FormationParams()):
    """The rule over all rows at once in plain Python: (key, us, lat, lon, pixel) -> key: (anchor, valid, rejected)."""
    members, sums, out = [], {}, {}
    for key, _, lat, lon, pixel in sorted(rows, key=lambda r: (r[1], r[0])):
        nearest = {}
        for other, mlat, mlon, mpixel, anchor in members:
            d = brute_m(lat, lon, mlat, mlon)
            reach = max(p.radius_m, p.pixel_factor * max(pixel, mpixel)) if p.pixel_aware else p.radius_m
            if d <= reach:
                nearest[anchor] = min(d, nearest.get(anchor, math.inf))
        valid = {a: d for a, d in nearest.items() if brute_m(lat, lon, sums[a][0] / sums[a][2], sums[a][1] / sums[a][2]) <= p.extent_m}
        anchor = min(valid, key=lambda a: (valid[a], hashlib.sha1(a.encode()).hexdigest()[:10])) if valid else key
        total = sums.setdefault(anchor, [0.0, 0.0, 0])
        sums[anchor] = [total[0] + lat, total[1] + lon, total[2] + 1]
        members.append((key, lat, lon, pixel, anchor))
        out[key] = (anchor, len(valid), len(nearest) - len(valid))
    return out


def brute_m(a, b, c, d):
    half = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * geo.EARTH_M * math.asin(min(1.0, math.sqrt(half)))


def formed_rows(spark, obs, p, **kwargs):
    got = formation.assign(obs, "pk", "ts", p, pixel="pixel", **kwargs)
    return {r["key"]: (r["anchor"], len(r["valid"]), r["extent_rejections"]) for r in got.collect()}


@pytest.mark.parametrize("p", [formation.FormationParams(), formation.FormationParams(pixel_aware=True, pixel_factor=1.0)])
def test_formation_equals_the_rule_over_all_rows(spark, p):
    obs = cloud(spark).withColumn("pixel", F.when(F.crc32("pk") % 5 == 0, 900.0).otherwise(400.0))
    rows = [tuple(r) for r in obs.select("pk", F.unix_micros("ts"), "lat", "lon", "pixel").collect()]
    wanted = {k: (a, v if v > 1 else 0, x) for k, (a, v, x) in plain_formation(rows, p).items()}
    assert formed_rows(spark, obs, p) == wanted
    assert len({a for a, _, _ in wanted.values()}) > 5


def test_formation_in_batches_equals_one_run(spark):
    obs = cloud(spark).withColumn("pixel", F.lit(0.0))
    times = sorted(r["ts"] for r in obs.select("ts").collect())
    cut = times[len(times) // 2]
    p = formation.FormationParams()
    first = written(formation.assign(obs.where(F.col("ts") <= F.lit(cut)), "pk", "ts", p), "formed")
    state = written(formation.state_of(first), "state")
    later = formation.assign(obs.where(F.col("ts") > F.lit(cut)), "pk", "ts", p, state=state)
    both = {r["key"]: r["anchor"] for r in first.unionByName(later).collect()}
    assert both == {k: a for k, (a, _, _) in formed_rows(spark, obs, p).items()}


def test_a_hot_spot_is_formed_by_its_distinct_places(spark):
    """20,000 detections at 50 places of one site: cells, not pairs of rows."""
    obs = spark.range(20_000).select(
        F.format_string("%06d", "id").alias("pk"), F.timestamp_seconds(F.col("id") * 60).alias("ts"),
        (20 + F.col("id") % 10 * 0.0004).alias("lat"), (80 + F.col("id") % 5 * 0.0004).alias("lon"), F.lit(0.0).alias("pixel"),
    )
    points = obs.groupBy("lat", "lon").agg(F.count("*").alias("n"))
    cells, links = formation.cell_links(points, 375.0)
    assert cells.count() <= 12 and links.count() <= 66
    named = formation.named_sources(written(formation.assign(obs, "pk", "ts"), "formed"))
    row = formation.diagnostics(named).first()
    assert row["n_observations"] == 20_000 and row["n_sources"] == named.select("source_id").distinct().count() <= 4
    assert formation.ambiguities(named).where("metres > 375").count() == 0


def test_components_equal_brute_force(spark):
    draw = random.Random(12)
    rows = [(k, 60 + draw.gauss(0, 0.02), -20 + draw.gauss(0, 0.04)) for k in range(500)]
    rows += [(500 + k, draw.uniform(-0.006, 0.006), 10 + draw.uniform(-0.02, 0.02)) for k in range(60)]  # over the equator
    parent = list(range(len(rows)))

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for k, (_, a, b) in enumerate(rows):
        for j in range(k):
            if brute_m(a, b, rows[j][1], rows[j][2]) <= 375:
                parent[root(k)] = root(j)
    got = {r["k"]: r["component"] for r in formation.components(spark.createDataFrame(rows, "k int, lat double, lon double"), "k", 0.375).collect()}
    classes = {}
    for k in range(len(rows)):
        classes.setdefault(root(k), set()).add(got[k])
    assert all(len(c) == 1 for c in classes.values()) and len({min(c) for c in classes.values()}) == len(classes)


def test_formation_does_not_depend_on_row_order(spark):
    obs = cloud(spark, 80)
    a = formation.form_sources(obs, "pk", "ts").toPandas()
    b = formation.form_sources(obs.orderBy(F.desc("lat")), "pk", "ts").toPandas()
    assert dict(zip(a["pk"], a["source_id"], strict=True)) == dict(zip(b["pk"], b["source_id"], strict=True))


def ordered(rows):
    rows = [{"component": 0, "seed": None, "key": k, "us": i, "lat": lat, "lon": 70.0, "pixel": 0.0} for i, (k, lat) in enumerate(rows)]
    return list(formation.assign_in_order(rows, formation.FormationParams(), 375.0))


def test_radius_boundary_and_extent_cap():
    step = 300 / (geo.EARTH_M * math.pi / 180)
    got = ordered([(f"{i:03d}", 10 + i * step) for i in range(30)])
    assert len({r["anchor"] for r in got}) > 1 and sum(r["extent_rejections"] for r in got) > 0
    near = ordered([("a", 10.0), ("b", 10 + 374 / 111195.0), ("c", 10 - 376 / 111195.0)])
    assert [r["anchor"] for r in near] == ["a", "a", "c"]


def test_source_ids_widen_on_collision(spark, monkeypatch):
    anchors = spark.createDataFrame([("a", 3), ("b", 1), ("c", 2)], "anchor string, us int")
    real = formation.F.sha1
    monkeypatch.setattr(formation.F, "sha1", lambda c: F.concat(F.lit("0123456789"), F.when(F.col(c) == "b", "0000").otherwise("1111"), real(c)))
    got = {r["anchor"]: r["source_id"] for r in formation.source_ids(anchors, "us").collect()}
    assert got["b"] == "SRC-0123456789" and got["c"] == "SRC-01234567891111" and len(got["a"]) == 22


def test_leaders_equal_brute_force(spark):
    obs = cloud(spark)
    rows = sorted((r["ts"], r["pk"], r["lat"], r["lon"]) for r in obs.collect())
    leaders, wanted = [], {}
    for _, key, lat, lon in rows:
        hit = next((k for k, a, b in leaders if brute_m(lat, lon, a, b) <= 375), None)
        if hit is None:
            leaders.append((key, lat, lon))
        wanted[key] = hit or key
    assert {r["pk"]: r["leader"] for r in formation.lead_clusters(obs, "pk", "ts").collect()} == wanted


def test_components_of_a_long_path(spark):
    edges = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    more = edges.union(spark.createDataFrame([(900, 901), (901, 901), (900, 901)], "src long, dst long"))
    got = {r["node"]: r["component"] for r in graph.connected_components(more).collect()}
    assert len(got) == 203 and {got[k] for k in range(201)} == {0} and got[901] == got[900] == 900


def test_components_of_no_edges(spark):
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_confidence_by_sensor(spark):
    rows = [("l", "VIIRS"), ("30", "VIIRS"), ("55", "VIIRS"), ("29", "MODIS"), ("30", "MODIS"), ("80", "MODIS"), ("n", "MODIS"), ("101", "MODIS"), ("50", None), ("", "VIIRS"), (None, None), ("h", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c string, s string")
    got = [(r["p"]["class"], r["p"]["pct"], r["p"]["status"]) for r in df.select("i", fields.confidence(F.col("c"), F.col("s")).alias("p")).orderBy("i").collect()]
    assert got == [
        ("low", None, "ok"), ("low", None, "ok"), (None, None, "semantics_mismatch"), ("low", 29.0, "ok"), ("nominal", 30.0, "ok"), ("high", 80.0, "ok"),
        (None, None, "semantics_mismatch"), (None, None, "invalid"), (None, None, "semantics_unknown"), (None, None, "missing"), (None, None, "missing"), ("high", None, "ok"),
    ]


def test_number_tells_blank_from_bad(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(["", None, " 5 ", "nan", "inf", "x", "-0.0"])], "i int, x string")
    got = [(r["n"]["value"], r["n"]["bad"]) for r in df.select("i", fields.number(F.col("x")).alias("n")).orderBy("i").collect()]
    assert got == [(None, False), (None, False), (5.0, False), (None, True), (None, True), (None, True), (-0.0, False)]


def test_unpadded_times(spark):
    df = spark.createDataFrame([("2024-01-02", "307"), ("2024-01-02", "2561"), ("2024-13-40", "0000"), ("2024-01-02", None)], "d string, t string")
    got = [str(r[0]) if r[0] else None for r in df.select(fields.acquired(F.col("d"), F.col("t"))).collect()]
    assert got == ["2024-01-02 03:07:00", None, None, None]


def test_validation_of_csv_files(spark, tmp_path):
    head = ",".join(scan.LAYOUTS["viirs"])
    ok = "21.5,78.25,330.1,0.4,0.4,2024-01-01,307,N20,VIIRS,n,2.0NRT,290.1,5.5,N"
    lines = [
        "﻿" + head, ok, ok, ok.replace("21.5", "91"), ok.replace("21.5", ""), "1,2,3", ok.replace("5.5", "-1").replace("307", "308"),
        ok.replace("307", "309").replace(",n,", ",55,"), ok.replace("2024-01-01", "2024-02-01").replace("307", "101"),
        ok.replace("2024-01-01", "2024-02-01").replace("307", "100"), ok.replace("2024-01-01", "1999-12-31"),
    ]
    path = tmp_path / "VIIRS_NOAA20_NRT_2024-01-01_range5.csv"
    path.write_text("\n".join(lines))
    raw = scan.read_layout(spark, str(path), "viirs", "NRT", "p")
    got = {r["row_number"]: r for r in validate.validate(raw, F.lit("2024-02-01 00:00:00").cast("timestamp")).collect()}
    assert [got[k]["reason"] for k in range(1, 11)] == [
        None, "DUPLICATE_EXACT", "INVALID_COORDINATES", "MISSING_COORDINATES", "MALFORMED_ROW", None, None, "TIMESTAMP_IN_FUTURE", None, "TIMESTAMP_BEFORE_MISSION",
    ]
    assert got[2]["duplicate_of"] == 1 and got[6]["frp_mw"] is None and got[6]["flags"] == ["FRP_NEGATIVE"]
    assert got[7]["flags"] == ["CONFIDENCE_SEMANTICS_MISMATCH"] and got[1]["physical_key"] == "PHYS|VIIRS|N20|20240101T0307|21.50000|78.25000"
    status = validate.review_status(validate.validate(raw, F.lit("2024-02-01").cast("timestamp"))).first()
    assert status["n_input"] == status["n_valid"] + status["n_excluded"] and status["status"] == "REVIEW_EXCLUSIONS"
    names = scan.input_manifest(spark, str(tmp_path)).collect()
    assert (names[0]["product"], names[0]["grade"], names[0]["days"]) == ("VIIRS_NOAA20", "NRT", 5)


def test_unknown_file_names_are_refused(spark, tmp_path):
    (tmp_path / "other.csv").write_text("x")
    with pytest.raises(Exception, match="unknown file name"):
        scan.input_manifest(spark, str(tmp_path)).collect()


def test_modes_and_ids_are_guarded(spark):
    with pytest.raises(ValueError, match="mixed"):
        scan.one_mode(spark.createDataFrame([("NRT",), ("DEMO",)], "data_mode string"))
    with pytest.raises(ValueError, match="repeated"):
        scan.unique_ids(spark.createDataFrame([("a",), ("a",)], "id string"), "id")
    with pytest.raises(ValueError, match="mode"):
        scan.read_layout(spark, "x", "viirs", "DEMO", "p")


def test_staging_prunes_days(spark, tmp_path):
    df = times(spark, [("a", 1, "2024-01-01 10:00:00"), ("b", 1, "2024-01-03 10:00:00")])
    sinks.stage_by_day(df, str(tmp_path / "s"), "ts")
    assert [r["k"] for r in scan.staged(spark, str(tmp_path / "s"), "2024-01-02").collect()] == ["b"]


def test_a_null_is_no_conflict(spark):
    rows = [("k", "f1", 1, "a", 1.0, 2), ("k", "f2", 2, "b", None, 1), ("k", "f2", 3, "c", 1.0 + 1e-7, 1), ("k", "f2", 4, "d", 1.5, 1)]
    df = spark.createDataFrame(rows, "pk string, file string, row int, id string, frp double, rich int")
    first, alias = dedup.dedup_by_key(df, "pk", [F.desc("rich"), "file", "row", "id"], ["frp"], {"frp"}, "file", "id")
    assert first.first()["id"] == "a"
    assert {r["alias_id"]: r["relation"] for r in alias.collect()} == {"b": "IDENTICAL_COPY", "c": "IDENTICAL_COPY", "d": "ATTRIBUTE_CONFLICT"}


def test_leave_one_out_equals_brute_force(spark):
    values = [3.0, 5.0, 5.0, 9.0, 4.0, 12.0]

    def score(x, others):
        s = sorted(others)
        med = lambda v: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2
        m = med(s)
        mad, ad = med([abs(v - m) for v in s]), sum(abs(v - m) for v in s) / len(s)
        return 0.6745 * (x - m) / mad if mad > 1e-9 else (x - m) / (1.253314 * ad) if ad > 1e-9 else None

    values = sorted(values)  # the scores come in order of the values
    want = [max(0.0, score(v, values[:i] + values[i + 1 :])) for i, v in enumerate(values)]
    got = spark.createDataFrame([(values,)], "v array<double>").select(stats.leave_one_out(F.col("v"))).first()[0]
    assert got == pytest.approx(want)
    few = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>").select(stats.leave_one_out(F.col("v"))).first()[0]
    assert few == []


def test_baseline_statuses(spark):
    days = [(1, f"2024-01-{d:02d}", "v", float(d % 4)) for d in range(1, 16)] + [(2, f"2024-01-{d:02d}", "v", 5.0) for d in range(1, 16)]
    days += [(3, "2024-01-01", "v", 1.0), (4, "2024-01-01", "v", 1.0), (4, "2024-01-02", "v", None)]
    df = spark.createDataFrame(days, "s int, d string, sensor string, x double").withColumn("d", F.col("d").cast("date"))
    got = {r["s"]: r for r in baseline.baseline(df, "s", "d", "sensor", "x").collect()}
    assert {k: r["status"] for k, r in got.items()} == {1: "OK", 2: "DEGENERATE_BASELINE", 3: "INSUFFICIENT_HISTORY", 4: "TARGET_FRP_MISSING"}
    assert got[2]["robust_z"] is None and 0 <= got[1]["t_anom"] <= 1


def test_later_rows_do_not_change_as_of_features(spark):
    df = times(spark, [("a", 1, "2024-01-01 00:00:00"), ("b", 1, "2024-01-05 00:00:00")])
    late = df.union(times(spark, [("c", 1, "2024-02-01 00:00:00")]))
    moment = F.lit("2024-01-10").cast("timestamp")
    rows = lambda d: sorted(r["k"] for r in coverage.as_of(d, "ts", moment).collect())
    assert rows(df) == rows(late) == ["a", "b"]


def test_coverage_never_turns_missing_into_zero(spark):
    df = spark.createDataFrame([("v", "2024-01-01"), ("v", "2024-01-04")], "s string, d string").withColumn("d", F.col("d").cast("date"))
    led = coverage.ledger(df, "s", "d").orderBy("d").collect()
    assert [(r["n_obs"], r["status"]) for r in led] == [(1, "OBSERVED"), (None, "NO_ROWS_UNVERIFIED"), (None, "NO_ROWS_UNVERIFIED"), (1, "OBSERVED")]
    gap = coverage.gaps(coverage.ledger(df, "s", "d"), "s", "d").first()
    assert (str(gap["first"]), str(gap["last"]), gap["n_days"]) == ("2024-01-02", "2024-01-03", 2)


def scored(spark, **changes):
    row = {"source_id": "s", "active_days": 30, "night_frac": 0.9, "detection_count": 60, "event_count": 8, "extent_m": 300.0, "recent_detections": 4, "frp_max": 40.0, "frp_mean": 8.0} | changes
    kinds = "source_id string, active_days long, night_frac double, detection_count long, event_count long, extent_m double, recent_detections long, frp_max double, frp_mean double"
    return activity.with_alert(activity.with_rules(spark.createDataFrame([tuple(row.values())], kinds))).first()


@pytest.mark.parametrize(
    ("changes", "score", "flag"),
    [
        ({}, 8, True), ({"active_days": 19}, 5, False), ({"active_days": 20}, 8, True), ({"active_days": 4}, 4, False), ({"extent_m": 750.0}, 8, True),
        ({"extent_m": 751.0}, 7, False), ({"night_frac": 0.59}, 6, False), ({"detection_count": 2}, 5, False), ({"event_count": 2}, 7, True), ({"night_frac": None}, None, False),
    ],
)
def test_rule_boundaries(spark, changes, score, flag):
    r = scored(spark, **changes)
    assert (r["rule_score"], r["rule_flag"]) == (score, flag)
    assert (r["rule_reasons"] == ["INSUFFICIENT_DATA"]) == (score is None)


def test_alert_score_is_rounded_before_its_tier(spark):
    r = scored(spark)
    assert r["alert_score"] == pytest.approx(0.35 + 0.25 * 0.8 + 0.15 * 1.0 + 0.15 * 0.5) and r["alert_tier"] == "HIGH"


def test_percents_sum_to_one_hundred(spark):
    rng = random.Random(1)
    rows = [(k, c, rng.random() + 1e-6) for k in range(50) for c in "abcde"]
    got = attribution.percents(spark.createDataFrame(rows, "k int, category string, weight double"), "k").groupBy("k").agg(F.sum("percent").alias("t"), F.count("*").alias("n")).collect()
    assert {(r["t"], r["n"]) for r in got} == {(100, 5)}


def test_polygon_relation(spark):
    square = [(0.0, 0.0), (0.0, 0.01), (0.01, 0.01), (0.01, 0.0)]
    ring = F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in square])
    df = spark.createDataFrame([(1, 0.005, 0.005), (2, 0.02, 0.005), (3, 0.0, 0.005), (4, -0.001, -0.001)], "i int, lat double, lon double")
    got = {r["i"]: r["p"] for r in df.select("i", geo.polygon_relation(F.col("lat"), F.col("lon"), ring).alias("p")).collect()}
    assert [got[k]["inside"] for k in (1, 2, 3, 4)] == [True, False, True, False]
    assert got[1]["boundary_m"] == pytest.approx(555.97, abs=0.2) and got[3]["boundary_m"] == pytest.approx(0, abs=1e-6)
    lines = spark.createDataFrame([([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)],), ([(0.0, 0.0), (0.0, 0.0)],), (square,)], "ring array<struct<lat:double,lon:double>>")
    assert [r[0] for r in lines.select(geo.ring_problem(F.col("ring"))).collect()] == ["POLYGON_ZERO_AREA", "POLYGON_TOO_FEW_VERTICES", None]


def test_association_never_takes_just_the_nearest(spark):
    events = spark.createDataFrame([("none", 0.0, 0.0), ("one", 10.0, 10.0), ("two", 20.0, 20.0)], "e string, e_lat double, e_lon double")
    near = [("a", 10.001, 10.0), ("b", 20.001, 20.0), ("c", 20.004, 20.0)]
    sites = spark.createDataFrame(near, "s string, s_lat double, s_lon double").withColumn("ring", F.lit(None).cast("array<struct<lat:double,lon:double>>"))
    cands = facility.candidates(events, sites, "e", "s")
    got = {r["e"]: (r["status"], r["selected"]) for r in facility.decide(cands, events, "e", "s").collect()}
    assert got == {"none": ("UNRESOLVED", None), "one": ("ASSOCIATED", "a"), "two": ("MULTIPLE_CANDIDATES", None)}
    margin = facility.FacilityParams(margin_m=100.0)
    assert {r["e"]: r["basis"] for r in facility.decide(cands, events, "e", "s", margin).collect()}["two"] == "SEPARATION_MARGIN"
    with pytest.raises(ValueError, match="decision fields"):
        facility.refuse_decision_fields(spark.createDataFrame([(1, "x")], "a int, decision_basis string"))


def test_context_needs_all_tiles(spark):
    points = spark.createDataFrame([("p", 21.1, 78.1), ("q", 50.0, 50.0)], "k string, lat double, lon double")
    elements = spark.createDataFrame([("n/1", 21.105, 78.1, ["works"]), ("n/1", 21.105, 78.1, ["works"])], "ref string, e_lat double, e_lon double, categories array<string>")
    tiles = points.where("k = 'p'").select(F.explode(geo.tiles_around(F.col("lat"), F.col("lon"), 5000)).alias("tile"))
    got = {r["k"]: r for r in context.point_features(points, elements, tiles, "k").collect()}
    assert (got["p"]["context_status"], got["p"]["n_works_1000m"], got["p"]["n_forest_1000m"]) == ("OK", 1, 0)
    assert (got["q"]["context_status"], got["q"]["n_works_1000m"]) == ("MISSING_NOT_FETCHED", None)


def test_live_rows_match_known_sources_first(spark):
    obs = times(spark, [("p1", 0, "2024-01-01 00:00:00"), ("p2", 0, "2024-01-01 00:01:00"), ("p3", 0, "2024-01-01 00:02:00"), ("p3", 0, "2024-01-01 00:02:00")]).withColumnRenamed("k", "physical_key")
    obs = obs.withColumn("lat", F.when(F.col("physical_key") == "p1", 21.0).otherwise(30.0)).withColumn("lon", F.lit(78.0))
    registry = spark.createDataFrame([("SRC-1", 21.001, 78.0)], "source_id string, r_lat double, r_lon double")
    got = {r["physical_key"]: (r["source_id"], r["kind"]) for r in live.associate(obs, registry).collect()}
    assert got["p1"] == ("SRC-1", "EXISTING") and got["p2"] == got["p3"] and got["p2"][1] == "PROVISIONAL" and len(got) == 3


def test_digest_does_not_depend_on_order(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("x"))
    a, b = digest.multiset_digest(df, F.col("x")), digest.multiset_digest(df.orderBy(F.desc("x")).repartition(7), F.col("x"))
    assert a == b != digest.multiset_digest(df.where("x <> '7'"), F.col("x"))


def test_blind_ids_are_keyed(spark):
    df = spark.createDataFrame([("s1",), ("s2",)], "k string")
    ids = lambda salt: [r["blind_id"] for r in research.blind_ids(df, "k", salt).orderBy("k").collect()]
    assert ids(b"a") != ids(b"b") and len(set(ids(b"a"))) == 2 and all(x.startswith("ANN-") for x in ids(b"a"))


def test_kappa_is_null_when_chance_agreement_is_one(spark):
    df = spark.createDataFrame([("x", "x"), ("x", "x")], "a string, b string")
    assert research.kappa(df, "a", "b").first()["kappa"] is None


def test_gate_closed_means_no_model(spark):
    rng = random.Random(2)
    rows = [(f"g{g}", float(rng.gauss(g % 2 * 2, 1)), None if i == 3 else float(g), "A" if g % 2 else "B") for g in range(20) for i in range(4)]
    df = spark.createDataFrame(rows, "grp string, x double, y double, label string")
    assert ml.train(df.limit(10), ["x", "y"], "label", "grp") is None
    model = ml.train(df, ["x", "y"], "label", "grp")
    report = ml.reported(model.transform(ml.with_missing_flags(df, ["x", "y"])))
    assert report["n"] == 80 and report["accuracy"] > 0.7
    train, test = ml.split(df, "label", "grp")
    groups = lambda d: {r[0] for r in d.select("grp").distinct().collect()}
    assert not groups(train) & groups(test)


def test_live_state_and_queries(spark):
    df = spark.createDataFrame([("OK", "2024-01-01 00:00:00"), ("OK", "2023-12-31 10:00:00"), ("DOWN", None), ("OK", None)], "s string, g string").withColumn("g", F.col("g").cast("timestamp"))
    got = [r[0] for r in df.select(views.live_state(F.col("s"), F.col("g"), F.lit("2024-01-01 05:00:00").cast("timestamp"))).collect()]
    assert got == ["on", "stale", "unavailable", "invalid"]
    q = spark.createDataFrame([("21.5, 78.25",), ("91, 0",), ("steel",)], "q string")
    assert [r[0] and tuple(r[0]) for r in q.select(views.coordinate_query(F.col("q"))).collect()] == [(21.5, 78.25), None, None]


def test_numbers_are_gapless_in_hot_groups(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"), "id")
    got = number_within(df, ["g"], ["id"], "n", 16).toPandas()
    assert all(sorted(v) == list(range(len(v))) for _, v in got.groupby("g")["n"]) and len(got) == 3000


def test_ranges_of_bounds(spark):
    bounds = [2.0, 3.0, 5.0, 7.0, 11.0, 13.0, 17.0]
    df = spark.createDataFrame([(float(x),) for x in range(20)] + [(None,)], "v double")
    got = [r[0] for r in df.select(range_of(F.col("v"), bounds)).collect()]
    assert got == [sum(b <= x for b in bounds) for x in range(20)] + [0]
