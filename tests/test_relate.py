"""Joins by id with their checks, packets, projections and the order contract of streams."""

import json

import pytest
from pyspark.sql import functions as F

from pointloom.operators import formation, legacy, packets, projections, relate, research
from pointloom.plans.joins import join_heavy
from pointloom.plans.scratch import Leftovers, written
from pointloom.sources import sinks
from pointloom.streaming import formation as streamed


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "k long")


def test_null_keys_are_not_excluded(spark):
    rows = ids(spark, 1, 2, None)
    assert sorted(str(r["k"]) for r in relate.exclude(rows, ids(spark, 1, None), "k").collect()) == ["2", "None"]


def test_a_missing_key_raises_even_if_nothing_of_it_is_read(spark):
    table = ids(spark, 1, 2)
    assert relate.complete(ids(spark, 1, 1, 2), table, "k").count() == 3
    for bad in (ids(spark, 1, 3), ids(spark, 1, None)):
        with pytest.raises(Exception, match="key without a row"):
            relate.complete(bad, table, "k").collect()


def test_a_repeated_context_row_raises(spark):
    table = spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    with pytest.raises(Exception, match="repeated key in t"):
        relate.with_context(ids(spark, 1), "k", t=table).collect()
    once = table.where("v = 'a'")
    assert relate.with_context(ids(spark, 2), "k", t=once).first()["t"] is None
    assert relate.with_context(ids(spark, 1), "k", t=once).first()["t"]["v"] == "a"


def test_id_sets_must_be_equal(spark):
    relate.require_same_ids(ids(spark, 1, 2, 2), ids(spark, 2, 1), "k")
    with pytest.raises(ValueError, match="1 on the left only, 2 on the right only"):
        relate.require_same_ids(ids(spark, 1, 2), ids(spark, 2, 3, 4), "k")


def test_heavy_keys_join_like_any_other(spark):
    rows = written(spark.createDataFrame([(k % 7 if k % 3 else 100, k) for k in range(3000)], "k long, v long"), "rows")
    table = written(rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("name", F.concat(F.lit("n"), F.col("k").cast("string"))), "table")
    for most in (1, 3, 1000):
        got = join_heavy(rows, table, "k", "n", most).collect()
        assert len(got) == 3000 and all(r["name"] == f"n{r['k']}" for r in got)


def test_leftovers_stay_while_they_are_read(spark):
    left = Leftovers()
    with left:
        a, b = written(ids(spark, 1), "a"), written(ids(spark, 2), "b")
    left.release(a.where("k > 0"))
    assert a.count() == 1
    with pytest.raises(Exception):
        b.collect()
    left.release(spark.range(1))
    with pytest.raises(Exception):
        a.collect()


@pytest.mark.parametrize("places", [2, 3])
def test_half_even_is_the_rounding_of_the_binary_value(spark, places):
    values = [k / 1000 for k in range(-3000, 3000)] + [2.675, 0.125, 0.375, 1.005, -77.125, 0.29, 1e-9, 89.995]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(legacy.round_half_even(F.col("x"), places)).collect()]
    assert [g + 0.0 for g in got] == [round(v, places) + 0.0 for v in values]


def test_pilot_prefers_new_cells_and_one_of_a_group(spark):
    rows = [("a1", "A", "g1", "c1", 1), ("a2", "A", "g1", "c2", 2), ("a3", "A", "g2", "c1", 3), ("a4", "A", "g3", "c3", 4),
            ("b1", "B", "g3", "c9", 5), ("b2", "B", "g4", "c1", 6), ("c1", "C", "g5", "c5", 7)]
    queue = spark.createDataFrame(rows, "id string, kind string, group string, cell string, rank int")
    got = [r["id"] for r in research.pilot(queue, {"A": 2, "B": 1}, most=5)]
    assert got == ["a1", "a4", "b2", "c1", "a3"]


def test_stream_order_is_a_contract(spark):
    rows = lambda *r: spark.createDataFrame(r, "pk string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    good = rows(("a", "2024-01-02 00:00:00"), ("b", "2024-01-01 00:00:00"))
    assert streamed.require_order(good, "pk", "ts").count() == 2
    with pytest.raises(streamed.OutOfOrder, match="repeated"):
        streamed.require_order(rows(("a", "2024-01-02 00:00:00"), ("a", "2024-01-02 00:00:00")), "pk", "ts")
    after = (1704153600000000, "a")  # 2024-01-02
    with pytest.raises(streamed.OutOfOrder, match="after a later one"):
        streamed.require_order(good, "pk", "ts", after)
    with pytest.raises(streamed.OutOfOrder, match="repeated"):
        streamed.require_order(rows(("a", "2024-01-02 00:00:00")), "pk", "ts", after)
    assert streamed.require_order(rows(("b", "2024-01-02 00:00:00")), "pk", "ts", after).count() == 1


def test_staged_run_equals_formation_and_counts_what_it_drops(spark, tmp_path):
    n = spark.range(300).select(
        F.col("id").cast("long").alias("row_number"), F.when(F.col("id") % 2 == 0, "a_SP.csv").otherwise("b_NRT.csv").alias("source_file"),
        F.when(F.col("id") % 50 == 0, "MISSING_DATE").alias("reason"), F.lit(None).cast("long").alias("duplicate_of"),
        F.format_string("o%03d", "id").alias("observation_id"), (20 + F.col("id") % 9 * 0.01).alias("lat"), F.lit(80.0).alias("lon"),
        F.timestamp_seconds(1704067200 + F.floor(F.col("id") / 2) * 2 * 3000).alias("timestamp_utc"), (F.col("id") * 1.0).alias("frp_mw"),
        F.lit(300.0).alias("brightness_k"), F.lit("n").alias("confidence_class"), F.lit("D").alias("day_night"),
        F.array().cast("array<string>").alias("flags"), F.format_string("k%03d", F.floor(F.col("id") / 2) * 2).alias("physical_key"),
    )
    summary = streamed.run_staged(n, str(tmp_path), keep=F.col("lat") < 20.075)
    assert summary["n_valid"] == 294 and summary["n_dropped_by_filter"] > 0 and summary["n_alias_rows"] > 0
    days = spark.read.parquet(f"{tmp_path}/days")
    rows = days.select(F.col("physical_key").alias("pk"), F.col("timestamp_utc").alias("ts"), "lat", "lon")
    first = rows.groupBy("pk").agg(F.min("ts").alias("ts")).count()
    assert summary["diagnostics"]["n_observations"] == first == spark.read.parquet(f"{tmp_path}/assignments").count()
    again = streamed.run_staged(n.orderBy(F.desc("row_number")), str(tmp_path / "again"), keep=F.col("lat") < 20.075)
    assert again["digests"] == summary["digests"]


def test_packet_counts_must_agree_with_the_registry(spark):
    measures = spark.createDataFrame([(1, 5), (2, 6)], "source_id long, observation_count long")
    registry = spark.createDataFrame([(1, 5, 1), (2, 7, 1)], "source_id long, n_obs long, n_events long")
    assert packets.packet(measures.where("source_id = 1"), registry, "source_id", b"s").count() == 1
    with pytest.raises(Exception, match="disagrees"):
        packets.packet(measures, registry, "source_id", b"s").collect()


def test_checks_see_leaks_and_ranges(spark):
    rows = spark.createDataFrame([("ANN-0123456789ab", 0.5, "fine"), ("ANN-x", 1.5, "top_class STEEL"), (None, None, None)], "annotation_id string, share double, note string")
    tests = {"id": F.col("annotation_id").rlike("^ANN-[0-9a-f]{12}$"), "share": F.col("share").between(0, 1), "leak": ~F.coalesce("note", F.lit("")).rlike(packets.LEAKS)}
    assert {r["check"]: r["n_bad"] for r in packets.check_counts(rows, tests).collect()} == {"id": 2, "share": 2, "leak": 1}


def test_points_at_the_origin_and_beyond_are_not_valid(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (91.0, 0.0), (None, 1.0), (float("nan"), 1.0), (-90.0, 180.0)], "a double, o double")
    assert [r[0] for r in rows.select(projections.valid_point(F.col("a"), F.col("o"))).collect()] == [False, True, False, False, False, True]


def test_polygons_wider_than_the_search_radius_are_found(spark):
    from pointloom.operators import facility

    ring = [(a, o) for a, o in ((20.0, 80.0), (20.0, 80.4), (20.3, 80.4), (20.3, 80.0))]
    sites = spark.createDataFrame([("s", 20.15, 80.2, ring)], "site_id string, s_lat double, s_lon double, ring array<struct<lat: double, lon: double>>")
    events = spark.createDataFrame([("in", 20.01, 80.01), ("near", 19.995, 80.2), ("far", 19.9, 80.2)], "event_id string, e_lat double, e_lon double")
    got = {r["event_id"]: (r["in_polygon"], r["candidate_m"]) for r in facility.candidates(events, sites, "event_id", "site_id").collect()}
    assert got["in"] == (True, 0.0) and got["near"][0] is False and abs(got["near"][1] - 556) < 2 and "far" not in got


def test_formation_needs_no_observations(spark):
    obs = spark.createDataFrame([], "pk string, ts timestamp, lat double, lon double")
    assert formation.form_sources(obs, "pk", "ts").count() == 0


def test_tables_have_a_manifest_that_order_does_not_change(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None)], "k long, v string")
    a = sinks.write_tables(str(tmp_path / "a"), {"t": df}, {"t": "k"}, {"seed": 1})
    b = sinks.write_tables(str(tmp_path / "b"), {"t": df.orderBy("k").repartition(2)}, {"t": "k"}, {"seed": 1})
    assert a == b and a["tables"]["t"]["rows"] == 2
    assert json.loads(spark.read.text(str(tmp_path / "a/manifest")).first()[0])["manifest_hash"] == a["manifest_hash"]
    assert spark.read.option("header", True).csv(str(tmp_path / "a/t")).count() == 2


def test_packets_for_annotators_do_not_name_the_source(spark, tmp_path):
    df = spark.createDataFrame([("ANN-1", "SRC-9", "x", "y", 20.12345, 80.0)], "annotation_id string, source_id string, first_seen string, last_seen string, centroid_lat double, centroid_lon double")
    sinks.write_packet(df, "source_id", str(tmp_path))
    shown = spark.read.json(str(tmp_path / "packet_json"))
    assert "source_id" not in shown.columns and shown.first()["centroid_lat"] == "20.123"
    assert spark.read.json(str(tmp_path / "PRIVATE_key")).first()["source_id"] == "SRC-9"


def test_only_new_rows_are_appended(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k long, v string")
    assert sinks.append_new(rows, str(tmp_path / "m"), ["k", "absent"]) == 2
    assert sinks.append_new(rows.unionByName(spark.createDataFrame([(3, "c")], "k long, v string")), str(tmp_path / "m"), ["k"]) == 1
    assert spark.read.parquet(str(tmp_path / "m")).count() == 3


def test_no_model_is_saved_while_the_gate_is_closed(tmp_path):
    with pytest.raises(sinks.GateClosed):
        sinks.save_model(None, str(tmp_path), {})
