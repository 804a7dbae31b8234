"""Versions of tables that become current by one rename."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pointloom.operators import context
from pointloom.sources import publish


def rows(spark, n, extra=0):
    return spark.range(n).select("id", (F.col("id") * 2 + extra).alias("v"), F.when(F.col("id") % 3 == 0, "x").alias("note"))


def test_a_version_is_whole_and_the_earlier_one_stays_readable(spark, tmp_path):
    path = str(tmp_path / "p")
    assert publish.manifest(spark, path) is None
    with pytest.raises(FileNotFoundError):
        publish.read(spark, path, "a")
    first = publish.publish(path, {"a": rows(spark, 10), "b": rows(spark, 3)}, {"seed": 1})
    held = publish.read(spark, path, "a", first)
    second = publish.publish(path, {"a": rows(spark, 20), "b": rows(spark, 0)}, {"seed": 1})
    assert (first["version"], second["version"]) == (1, 2)
    assert held.count() == 10 and publish.read(spark, path, "a").count() == 20 and publish.read(spark, path, "b").count() == 0
    assert publish.read(spark, path, "a", publish.manifest(spark, path, 1)).count() == 10
    assert publish.verify(spark, path)["version"] == 2


def test_the_same_rows_have_the_same_manifest_hash(spark, tmp_path):
    a = publish.publish(str(tmp_path / "a"), {"t": rows(spark, 50).repartition(7)})
    b = publish.publish(str(tmp_path / "b"), {"t": rows(spark, 50).orderBy(F.desc("id"))})
    c = publish.publish(str(tmp_path / "c"), {"t": rows(spark, 50, extra=1)})
    assert a["manifest_hash"] == b["manifest_hash"] != c["manifest_hash"]


def test_a_job_lost_before_the_rename_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "p")
    publish.publish(path, {"a": rows(spark, 10)})

    def lost(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(publish._Files, "rename", lost)
        with pytest.raises(KeyboardInterrupt):
            publish.publish(path, {"a": rows(spark, 99)})
    broken = rows(spark, 5).select(F.when(F.col("id") < 3, F.col("id")).otherwise(F.raise_error(F.lit("lost"))).alias("id"))
    with pytest.raises(Exception, match="lost"):
        publish.publish(path, {"b": rows(spark, 1), "a": broken})
    assert publish.manifest(spark, path)["version"] == 1 and publish.read(spark, path, "a").count() == 10
    assert publish.clean(spark, path) == []  # both may still be running
    assert len(publish.clean(spark, path, older_than_s=-60)) == 2
    assert publish.verify(spark, path)["version"] == 1


def test_one_of_two_publishers_gets_the_number(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "p")
    real = publish._facts

    def slow(df):
        monkeypatch.setattr(publish, "_facts", real)
        publish.publish(path, {"a": rows(spark, 2)})
        return real(df)

    monkeypatch.setattr(publish, "_facts", slow)
    with pytest.raises(publish.Conflict):
        publish.publish(path, {"a": rows(spark, 7)})
    assert publish.read(spark, path, "a").count() == 2
    with pytest.raises(publish.Conflict):
        publish.publish(path, {"a": rows(spark, 7)}, after=0)
    assert publish.publish(path, {"a": rows(spark, 7)}, after=1)["version"] == 2


def test_cleaning_keeps_the_last_versions(spark, tmp_path):
    path = str(tmp_path / "p")
    for n in range(1, 5):
        publish.publish(path, {"a": rows(spark, n)})
    assert len(publish.clean(spark, path, keep=2, older_than_s=-60)) == 2
    assert publish.manifest(spark, path, 1) is None and publish.verify(spark, path, 3)["version"] == 3
    assert publish.publish(path, {"a": rows(spark, 9)})["version"] == 5
    with pytest.raises(ValueError):
        publish.clean(spark, path, keep=0)


def test_changed_rows_are_seen(spark, tmp_path):
    path = str(tmp_path / "p")
    of = publish.publish(path, {"a": rows(spark, 10)})
    rows(spark, 10, extra=1).write.mode("overwrite").parquet(f"{path}/data/{of['folder']}/a")
    with pytest.raises(publish.Damaged, match="digest"):
        publish.verify(spark, path)


def test_a_failed_audit_publishes_nothing(spark, tmp_path):
    path = str(tmp_path / "p")
    with pytest.raises(ValueError, match="audit"):
        publish.publish_expansion(path, rows(spark, 1), rows(spark, 1), rows(spark, 1), {"verdict": "FAIL"})
    assert publish.manifest(spark, path) is None


def test_tiles_are_replaced_whole_and_others_stay(spark, tmp_path):
    path = str(tmp_path / "tiles")
    tiles = lambda *pairs: spark.createDataFrame(pairs, "tile string, ref string")
    publish.store_tiles(tiles(("t1", "a"), ("t1", "b"), ("t2", "c")), path)
    publish.store_tiles(tiles(("t1", "z"), ("t3", "d")), path)
    wanted = spark.createDataFrame([("t1",), ("t2",), ("t9",), ("t1",)], "tile string")
    found = publish.stored_tiles(spark, path, wanted, "ref string")
    assert sorted((r["tile"], r["ref"]) for r in found.collect()) == [("t1", "z"), ("t2", "c")]
    assert spark.read.parquet(path).count() == 3


def test_question_of_a_tile(spark):
    df = spark.createDataFrame([("+0080_-0003",)], "tile string")
    text, name = df.select(context.tile_question(F.col("tile")), context.question_hash(context.tile_question(F.col("tile")))).first()
    assert text.startswith('[out:json][timeout:90];(nwr["landuse"="industrial"](20.0000,-0.7500,20.2500,-0.5000);nwr["man_made"="works"]')
    assert text.endswith('nwr["natural"="wood"](20.0000,-0.7500,20.2500,-0.5000););out center tags;')
    assert name == hashlib.sha256(("osm-context-q1\n" + text).encode()).hexdigest()[:16]
