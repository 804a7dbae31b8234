"""Queries on tables larger than the given ones: their rows repeated with shifted keys, and the steps that these broke."""

import duckdb
import pytest
from pyspark.sql import functions as F
from tests.compare import same_rows
from tests.conftest import SF

from pointloom import catalog
from pointloom.functions import geo
from pointloom.operators import formation
from pointloom.plans.scratch import written

SHIFTS = {"customer": {"c_custkey": 2900}, "supplier": {"s_suppkey": 2900}, "events": {"event_id": 100_000, "user_id": 2900}}


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """A folder of small tables three times over, so that places have several rows and proxy sources share places."""
    home = str(tmp_path_factory.mktemp("repeated"))
    con = duckdb.connect()
    for name, keys in SHIFTS.items():
        shifted = ", ".join(f"{k} + i * {v} AS {k}" for k, v in keys.items())
        con.execute(f"copy (select * replace ({shifted}) from '{SF}/{name}.parquet', range(3) t(i)) to '{home}/{name}.parquet'")
        con.execute(f"create view {name} as select * from '{home}/{name}.parquet'")
    return home, con


def equal(spark, repeated, name):
    home, con = repeated
    same_rows(catalog.QUERIES[name](spark, home), con.sql(catalog.ORACLES[name]))


def test_decimals_are_those_of_c(spark):
    values = [8.0005, 8.0015, 0.0625, 0.1875, -8.0005, -0.00001, 19.0025, 1234567.0005, 0.5]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    for places in (3, 5):
        got = {r["k"]: r["t"] for r in rows.select("k", geo.decimals(F.col("v"), places).alias("t")).collect()}
        assert got == {k: f"{v:.{places}f}" for k, v in enumerate(values)}


def test_sources_form_within_a_column(spark):
    rows = [("a", 0, "x"), ("b", 1, "y"), ("c", 2, "x"), ("d", 3, "y")]
    obs = spark.createDataFrame(rows, "pk string, s int, part string").select("pk", F.timestamp_seconds("s").alias("ts"), F.lit(20.0).alias("lat"), F.lit(75.0).alias("lon"), "part")
    formed = written(formation.assign(obs, "pk", "ts", within="part"), "formed")
    assert {(r["key"], r["anchor"], r["within"]) for r in formed.collect()} == {("a", "a", "x"), ("b", "b", "y"), ("c", "a", "x"), ("d", "b", "y")}
    state = formation.state_of(formed)
    later = obs.select(F.concat(F.lit("z"), "pk").alias("pk"), F.timestamp_seconds(F.lit(9)).alias("ts"), "lat", "lon", "part")
    again = formation.assign(later, "pk", "ts", state=state, within="part")
    assert {(r["key"], r["anchor"]) for r in again.collect()} == {("za", "a"), ("zb", "b"), ("zc", "a"), ("zd", "b")}


@pytest.mark.parametrize("name", ["formation_components", "formation_diagnostics", "core_run"])
def test_formation_where_proxy_sources_share_places(spark, repeated, name):
    equal(spark, repeated, name)


@pytest.mark.parametrize("name", ["attribution_top", "attribution_weights", "largest_remainder", "polygon_containment", "facility_decisions", "context_features"])
def test_places_with_several_points_and_sites(spark, repeated, name):
    equal(spark, repeated, name)
