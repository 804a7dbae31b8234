"""Small functions that no query reaches."""

from pyspark.sql import functions as F

from pointloom.functions import fields
from pointloom.operators import context, packets
from pointloom.sources import sinks


def test_columns_that_there_are():
    assert fields.available(["b", "a", "c"], ["a", "x", "b"]) == ["a", "b"]


def test_site_names(spark):
    urls = ["https://WWW.Example.org/a?b", "http://plants.example.com:80/", "https://w3.site"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(fields.site_name(F.col("u"))).collect()] == ["example.org", "plants.example.com", "w3.site"]


def test_tile_plan_counts_points_by_tile(spark):
    points = spark.createDataFrame([(20.11, 80.11), (20.12, 80.12), (50.0, 10.0)], "lat double, lon double")
    plan = {r["tile"]: r["n_points"] for r in context.tile_plan(points, 10.0).collect()}
    assert sorted(plan.values())[-1] == 2 and len(plan) >= 2


def test_context_rows_that_must_be_found_bad(spark):
    rows = spark.createDataFrame(
        [(100.0, 2, "OK"), (None, 0, "NONE_WITHIN"), (9000.0, 1, "OK"), (None, -1, "NONE_WITHIN"), (5.0, 0, "OK"), (7.0, 0, "NONE_WITHIN"), (None, 0, None)],
        "nearest double, n int, status string",
    )
    found = {r["check"]: r["n_bad"] for r in packets.context_checks(rows, "nearest", "n", "status", 5000.0).collect()}
    assert found["nearest_in_reach"] == 1 and found["count_not_negative"] == 1 and found["status_given"] == 1
    assert found["found_means_counted"] >= 1 and found["absent_means_null"] >= 1


def test_candidates_and_frontend_rows_are_written_in_order(spark, tmp_path):
    df = spark.createDataFrame([("s2", 0.5, True, None), ("s1", 0.9, True, "x"), ("s3", 0.7, False, "y")], "source_id string, score double, flag boolean, note string")
    sinks.write_candidates(df, "flag", str(tmp_path / "c"), "source_id")
    assert [r["source_id"] for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()] == ["s1", "s2"]
    sinks.write_frontend(df, str(tmp_path / "f"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "f")).collect()]
    assert len(lines) == 3 and any('"note":null' in line for line in lines)
