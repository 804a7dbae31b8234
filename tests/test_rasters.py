"""Raster windows against a plain loop over whole small rasters."""

import math
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import context
from pointloom.sources import rasters

RES = 0.002
PER = 111_320.0


def tiff(path, pixels, lat0, lon0, block=None, codec=1, predictor=1, order="<", skip=()):
    """A small one-band raster: tiles of ``block`` x ``block``, or strips of 7 rows."""
    h, w = pixels.shape
    kind = np.dtype(f"{order}u{pixels.dtype.itemsize}")
    rows, cols = (block, block) if block else (7, w)
    parts = []
    for r in range(0, h, rows):
        for c in range(0, w, cols):
            cut = pixels[r : r + rows, c : c + cols]
            if block:
                cut = np.pad(cut, ((0, rows - cut.shape[0]), (0, cols - cut.shape[1])))
            if predictor == 2:
                cut = np.diff(cut, axis=1, prepend=np.zeros((cut.shape[0], 1), cut.dtype))
            raw = cut.astype(kind).tobytes()
            parts.append(b"" if len(parts) in skip else zlib.compress(raw) if codec == 8 else raw)
    body, offsets = b"", []
    for part in parts:
        offsets.append(8 + len(body) if part else 0)
        body += part
    sizes = [len(p) for p in parts]
    tags = [(256, "H", [w]), (257, "H", [h]), (258, "H", [8 * pixels.dtype.itemsize]), (259, "H", [codec]), (277, "H", [1]), (317, "H", [predictor])]
    tags += [(322, "H", [cols]), (323, "H", [rows]), (324, "I", offsets), (325, "I", sizes)] if block else [(273, "I", offsets), (278, "H", [rows]), (279, "I", sizes)]
    tags += [(33550, "d", [RES, RES, 0.0]), (33922, "d", [0.0, 0.0, 0.0, lon0, lat0, 0.0])]
    codes = {"H": 3, "I": 4, "d": 12}
    entries, extra, after = b"", b"", 8 + len(body)
    for tag, letter, values in sorted(tags):
        data = struct.pack(f"{order}{len(values)}{letter}", *values)
        if len(data) <= 4:
            value = data.ljust(4, b"\0")
        else:
            value = struct.pack(order + "I", after + len(extra))
            extra += data
        entries += struct.pack(order + "HHI", tag, codes[letter], len(values)) + value
    start = after + len(extra)
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, start)
    path.write_bytes(head + body + extra + struct.pack(order + "H", len(tags)) + entries + struct.pack(order + "I", 0))


def plain(rasters_, lat, lon, radius):
    """Counts by class and the class at the point, pixel by pixel."""
    counts, here = Counter(), None
    for pixels, lat0, lon0 in rasters_:
        for r in range(pixels.shape[0]):
            for c in range(pixels.shape[1]):
                dy = (lat0 - (r + 0.5) * RES - lat) * PER
                dx = (lon0 + (c + 0.5) * RES - lon) * PER * math.cos(math.radians(lat))
                if dx * dx + dy * dy <= radius * radius:
                    counts[int(pixels[r, c])] += 1
        r, c = math.floor((lat0 - lat) / RES), math.floor((lon - lon0) / RES)
        if 0 <= r < pixels.shape[0] and 0 <= c < pixels.shape[1]:
            here = int(pixels[r, c])
    return counts, here


@pytest.fixture
def field():
    rng = np.random.default_rng(4)
    return rng.choice([0, 10, 40, 50, 80, 77], size=(61, 83), p=[0.1, 0.3, 0.3, 0.1, 0.1, 0.1]).astype("uint8")


POINTS = [(i, 24.0 - 0.0017 * (i % 71), 72.0 + 0.0023 * (i % 67)) for i in range(40)]


@pytest.mark.parametrize("kind", [{"block": 16, "codec": 8}, {"block": 32, "codec": 8, "predictor": 2, "order": ">"}, {}, {"codec": 8, "predictor": 2}])
def test_counts_equal_a_plain_loop(spark, tmp_path, field, kind):
    tiff(tmp_path / "P_N21E072_Map.tif", field, 24.0, 72.0, **kind)
    blocks = rasters.raster_blocks(spark, str(tmp_path))
    points = spark.createDataFrame(POINTS, "id int, lat double, lon double").repartition(3)
    found = {}
    for r in rasters.class_counts(points, blocks, "id", 900.0).collect():
        mine = found.setdefault(r["id"], [Counter(), None])
        assert r["problem"] is None
        mine[0][r["class"]] += r["n"]
        mine[1] = r["class"] if r["here"] else mine[1]
    for i, lat, lon in POINTS:
        counts, here = plain([(field, 24.0, 72.0)], lat, lon, 900.0)
        seen = found.get(i, [Counter(), None])
        assert (+seen[0], seen[1]) == (+counts, here)


def test_wide_values_and_blocks_left_out(spark, tmp_path, field):
    wide = field.astype("uint16") * 300
    tiff(tmp_path / "P_N21E072_Map.tif", wide, 24.0, 72.0, block=16, predictor=2, skip=(1,))
    b = {r["block"]: r.asDict() for r in rasters.raster_blocks(spark, str(tmp_path)).collect()}
    assert (rasters.decoded(b[0]) == wide[:16, :16]).all() and not rasters.decoded(b[1]).any()
    assert (rasters.decoded(b[max(b)]) == wide[48:, 80:]).all()


def test_cover_over_two_rasters_with_its_states(spark, tmp_path, field):
    west, east = field, np.ascontiguousarray(field[:, ::-1])
    tiff(tmp_path / "P_N21E072_Map.tif", west, 24.0, 75.0 - 83 * RES, block=16, codec=8)
    tiff(tmp_path / "P_N21E075_Map.tif", east, 24.0, 75.0, block=16, codec=8)
    (tmp_path / "P_N21E078_Map.tif").write_bytes(b"II*\0nothing")
    rows = [("a", 23.95, 74.999), ("b", 23.95, 75.05), ("c", 40.0, 10.0), ("d", 22.0, 80.0), ("e", None, 80.0), ("f", 23.9995, 75.05), ("b", 23.95, 75.05)]
    points = spark.createDataFrame(rows, "id string, lat double, lon double")
    out = {r["id"]: r for r in context.raster_cover(points, rasters.raster_blocks(spark, str(tmp_path)), "id", 700.0).collect()}
    assert len(out) == 6
    for name, lat, lon in (rows[0], rows[1]):
        counts, here = plain([(west, 24.0, 75.0 - 83 * RES), (east, 24.0, 75.0)], lat, lon, 700.0)
        total, known = sum(counts.values()), sum(n for v, n in counts.items() if v)
        best = max((v for v in counts if v), key=lambda v: (counts[v], -v))
        label = lambda v: context.COVER.get(v, f"unknown_{v}")
        r = out[name]
        assert (r["status"], r["n_pixels"], r["class_at_point"], r["dominant"]) == ("OK", total, here or None, label(best))
        assert r["nodata_share"] == round(counts[0] / total, 4)
        assert r["shares"] == {label(v): round(n / known, 4) for v, n in counts.items() if v}
    assert out["a"]["tiles"] == "N21E072;N21E075"
    assert out["c"]["status"] == out["e"]["status"] == "MISSING_NOT_FETCHED" and out["c"]["n_pixels"] is None
    assert out["d"]["status"].startswith("READ_ERROR") and out["d"]["shares"] is None
    assert out["f"]["status"] == "PARTIAL_TILE_MISSING" and out["f"]["n_pixels"] > 0


def test_a_damaged_block_is_a_status(spark, tmp_path, field):
    path = tmp_path / "P_N21E072_Map.tif"
    tiff(path, field, 24.0, 72.0, block=16, codec=8)
    raw = bytearray(path.read_bytes())
    raw[8:24] = b"\xff" * 16
    path.write_bytes(raw)
    points = spark.createDataFrame([(1, 23.99, 72.01), (2, 23.9, 72.12)], "id int, lat double, lon double")
    out = {r["id"]: r["status"] for r in context.raster_cover(points, rasters.raster_blocks(spark, str(tmp_path)), "id", 300.0).collect()}
    assert out[1].startswith("READ_ERROR") and out[2] == "OK"


def test_inspection(spark, tmp_path, field):
    tiff(tmp_path / "P_N21E072_Map.tif", field, 24.0, 72.0, block=16)
    (tmp_path / "bad.tif").write_bytes(b"no raster")
    found = {r["file"].rsplit("/", 1)[1]: r for r in rasters.inspection(rasters.raster_blocks(spark, str(tmp_path))).collect()}
    good = found["P_N21E072_Map.tif"]
    assert (good["n_blocks"], good["height"], good["width"], good["problem"]) == (24, 61, 83, None)
    assert abs(good["south"] - (24 - 61 * RES)) < 1e-9 and abs(good["east"] - (72 + 83 * RES)) < 1e-9
    assert found["bad.tif"]["problem"].startswith("NotReadable") and found["bad.tif"]["n_blocks"] == 0


def test_a_crowded_block_is_read_by_several_tasks(spark, tmp_path, field):
    tiff(tmp_path / "P_N21E072_Map.tif", field, 24.0, 72.0, block=64)
    points = spark.range(4000).select("id", (23.95 + (F.col("id") % 10) / 1e6).alias("lat"), F.lit(72.05).alias("lon"))
    counts = rasters.class_counts(points, rasters.raster_blocks(spark, str(tmp_path)), "id", 300.0)
    # so few rows would be put together after the shuffle
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tasks = counts.withColumn("task", F.spark_partition_id()).agg(F.count_distinct("task"), F.count_distinct("id")).first()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks[0] > 1 and tasks[1] == 4000
