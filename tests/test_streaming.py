import random

import pytest
from pyspark.sql import functions as F

from pointloom.operators import formation
from pointloom.operators import live as operators_live
from pointloom.streaming import formation as streamed
from pointloom.streaming import live
from pointloom.streaming.state import Tiles

SCHEMA = "pk string, ts timestamp, lat double, lon double"


def observations(spark, rows):
    return spark.createDataFrame(rows, "pk string, t long, lat double, lon double").select(
        "pk", F.timestamp_seconds(F.col("t") + 1_700_000_000).alias("ts"), "lat", "lon"
    )


def wandering(size=260, seed=7):
    """Observations around few places, so that sources cross the borders of small tiles and meet each other."""
    draw = random.Random(seed)
    places = [(20 + draw.random() * 0.03, 80 + draw.random() * 0.03) for _ in range(12)] + [(-0.001, -0.001), (60.01, 179.9)]
    rows = []
    for k in range(size):
        lat, lon = draw.choice(places)
        rows.append((f"k{k:05d}", k * 600, lat + draw.gauss(0, 0.003), lon + draw.gauss(0, 0.003)))
    return rows


def run(spark, folder, rows, cuts, **params):
    former = streamed.Former(spark, str(folder), **params)
    for number, (low, high) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        former.place(observations(spark, rows[low:high]), number)
    return former


def ids(df):
    return {r["key"]: (r["source_id"], r["ambiguous"], r["extent_rejections"]) for r in df.collect()}


def test_batches_form_what_one_batch_forms(spark, tmp_path):
    """Also when a batch is repeated; a late row ends the run, an empty batch does not."""
    rows = wandering()
    params = formation.FormationParams(extent_m=500)
    whole = formation.form_sources(observations(spark, rows), "pk", "ts", params)
    wanted = {r["pk"]: (r["source_id"], r["ambiguous"], r["extent_rejections"]) for r in whole.collect()}
    former = run(spark, tmp_path, rows, (60, 200), params=params, tile_degrees=0.008)
    former.place(observations(spark, rows[200:]), 2)
    former.place(observations(spark, []), 3)
    assert ids(former.formed()) == wanted
    assert sum(v[2] for v in wanted.values()) > 3  # the cap on the extent bites
    with pytest.raises(streamed.OutOfOrder):
        former.place(observations(spark, rows[5:6]), 4)
    assert max(len(list(p.iterdir())) for p in tmp_path.glob("members/tile=*")) <= 2  # old versions are gone
    states = {r["anchor"]: r for r in former.active("2023-11-17 00:00:00").collect()}
    assert sum(r["n"] for r in states.values()) == len(rows)
    assert {r["state"] for r in states.values()} <= {"active", "archived"}


def test_a_batch_reads_and_writes_what_is_near_it(spark, tmp_path):
    """State rows of a batch follow its own surroundings, however long the history elsewhere is."""
    draw = random.Random(1)
    busy = [(f"b{k:05d}", k, 10 + draw.random() * 0.5, 10 + draw.random() * 0.5) for k in range(1500)]
    calm = lambda at, t: [(f"c{t}{k}", 5000 * t + k, at + k * 0.0001, 50.0) for k in range(4)]
    rows = [*busy, *calm(40.0, 1), *calm(40.0, 2), *calm(-30.0, 3)]
    former = run(spark, tmp_path, rows, (1500, 1504, 1508))
    counts = {int(p.name): spark.read.parquet(str(p)).first() for p in (tmp_path / "last").iterdir()}
    assert counts[0]["n_state_read"] == 0 and counts[0]["n_state_written"] > 1500
    assert (counts[1]["n_state_read"], counts[2]["n_state_read"], counts[3]["n_state_read"]) == (0, 4, 0)
    assert counts[2]["n_state_written"] <= 9 and counts[3]["n_state_written"] <= 5
    assert former.formed().count() == len(rows)
    written = [p for p in tmp_path.glob("members/tile=*/batch=2")]
    assert len(written) == 1


def test_tiles_near_a_row_hold_all_points_within_reach(spark):
    draw = random.Random(3)
    tiles = Tiles(0.02, 0.004)
    rows = []
    for _ in range(300):
        lat, lon = draw.uniform(-80, 80), draw.uniform(-179, 179)
        rows.append((lat, lon, lat + draw.uniform(-1, 1) * 0.004, lon + draw.uniform(-1, 1) * 0.004))
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    seen = df.select(F.array_contains(tiles.near(F.col("a"), F.col("b")), tiles.of(F.col("c"), F.col("d"))).alias("x"))
    assert all(r["x"] for r in seen.collect())
    with pytest.raises(ValueError):
        Tiles(0.01, 0.006)


def test_live_batches_place_what_one_batch_places(spark, tmp_path):
    """Provisional leaders outlive their batch; repeated rows count once; a failed batch says so and can be repeated."""
    rows = wandering(120, seed=9)
    registry = spark.createDataFrame([("S1", 20.01, 80.01), ("S2", 20.02, 80.0)], "source_id string, r_lat double, r_lon double")
    obs = lambda part: observations(spark, part).withColumnRenamed("pk", "physical_key").withColumn("product", F.lit("p"))
    whole = {r["physical_key"]: (r["source_id"], r["kind"]) for r in operators_live.associate(obs(rows), registry).collect()}
    assert {k for _, k in whole.values()} == {"EXISTING", "PROVISIONAL"}
    run = live.LiveRun(spark, str(tmp_path), registry, tile_degrees=0.02)
    run.place(obs(rows[:50]), 0)
    with pytest.raises(Exception, match="product"):
        run.place(obs(rows[50:]).drop("product"), 1)
    assert run.status().where("batch = 1").first()["status"] == "UNAVAILABLE"
    run.place(obs(rows[50:] + rows[:7] + rows[60:70]), 1)
    run.place(obs(rows[50:] + rows[:7] + rows[60:70]), 1)
    assert {r["physical_key"]: (r["source_id"], r["kind"]) for r in run.placed().collect()} == whole
    assert run.placed().count() == len(rows)
    said = {r["batch"]: (r["status"], r["distinct_observations"]) for r in run.status().collect()}
    assert said == {0: ("OK", 50), 1: ("OK", 70)}
