"""Windows of GeoTIFF rasters of one band, block by block.

A raster is never read whole.  Its header is read once and gives one row for each
block (tile or strip) with the place of its bytes.  Points meet the blocks near them by
cells of a fixed grid, the pairs are range-partitioned and sorted by block, and each
task then goes through its pairs with one decoded block at a time.  A block that very
many points need is read by several tasks, since the ranges cut through its points.
Only counts by point and class leave the tasks, never pixels.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions.geo import METRES_PER_DEGREE

#: Tags of the TIFF format that are read.
WIDTH, HEIGHT, BITS, CODEC, BANDS, PREDICTOR = 256, 257, 258, 259, 277, 317
STRIPS, STRIP_ROWS, STRIP_SIZES = 273, 278, 279
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES = 322, 323, 324, 325
SAMPLE_FORMAT, PIXEL_SCALE, TIE_POINT = 339, 33550, 33922
#: Struct letters of the field types of the format.
FIELD_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
NOT_PACKED, DEFLATE = {1}, {8, 32946}

BLOCKS = (
    "file string, block int, row0 int, col0 int, n_rows int, n_cols int, block_cols int, offset long, size long, codec int, predictor int,"
    " number string, lat0 double, lon0 double, res_y double, res_x double, problem string"
)
#: Degrees of the cells by which points and blocks meet.
CELL = 0.25


class NotReadable(ValueError):
    """A raster of a kind that is not read here."""


def _open(path: str):
    """A file that any executor can seek in; ``path`` as Spark names it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(unquote("/" + path.removeprefix("file:").lstrip("/")))
    if "://" not in path:
        return fs.LocalFileSystem().open_input_file(path)
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _tags(source) -> tuple[str, dict[int, tuple]]:
    """Byte order and the tags of the first directory, of classic and big files."""
    head = source.read_at(16, 0)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    kind = struct.unpack(order + "H", head[2:4])[0] if order else None
    if kind not in (42, 43):
        raise NotReadable("not a TIFF file")
    big = kind == 43
    start = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    counted, entry, place = ("Q", 20, "Q") if big else ("H", 12, "I")
    n = struct.unpack(order + counted, source.read_at(struct.calcsize(counted), start))[0]
    table = source.read_at(n * entry, start + struct.calcsize(counted))
    found = {}
    for at in range(0, n * entry, entry):
        tag, kind_, many = struct.unpack(order + "HH" + place, table[at : at + entry - struct.calcsize(place)])
        letter = FIELD_TYPES.get(kind_)
        if letter is None:
            continue
        size = struct.calcsize(letter) * many
        value = table[at + entry - struct.calcsize(place) : at + entry]
        if size > len(value):
            value = source.read_at(size, struct.unpack(order + place, value)[0])
        found[tag] = struct.unpack(f"{order}{many}{letter}", value[:size])
    return order, found


def blocks_of(path: str) -> list[tuple]:
    """Rows of :data:`BLOCKS` of one file; one row with a ``problem`` if it cannot be read."""
    try:
        with _open(path) as source:
            order, t = _tags(source)
        one = lambda tag, default=None: t[tag][0] if tag in t else default
        if one(BANDS, 1) != 1:
            raise NotReadable("more than one band")
        if one(CODEC, 1) not in NOT_PACKED | DEFLATE:
            raise NotReadable(f"compression {one(CODEC)}")
        if one(PREDICTOR, 1) not in (1, 2) or one(SAMPLE_FORMAT, 1) != 1 or one(BITS, 1) not in (8, 16, 32):
            raise NotReadable("values other than plain whole numbers")
        height, width = one(HEIGHT), one(WIDTH)
        if TILES in t:
            rows, cols, offsets, sizes = one(TILE_HEIGHT), one(TILE_WIDTH), t[TILES], t[TILE_SIZES]
        else:
            rows, cols, offsets, sizes = min(one(STRIP_ROWS, height), height), width, t[STRIPS], t[STRIP_SIZES]
        res_x, res_y = t[PIXEL_SCALE][:2]
        tie = t[TIE_POINT]
        lon0, lat0 = tie[3] - tie[0] * res_x, tie[4] + tie[1] * res_y
        across, number, out = -(-width // cols), f"{order}u{one(BITS, 1) // 8}", []
        for k, (offset, size) in enumerate(zip(offsets, sizes, strict=True)):
            row0, col0 = k // across * rows, k % across * cols
            out.append((
                path, k, row0, col0, min(rows, height - row0), min(cols, width - col0), cols, offset, size,
                one(CODEC, 1), one(PREDICTOR, 1), number, lat0, lon0, res_y, res_x, None,
            ))
        return out
    except (OSError, KeyError, TypeError, IndexError, struct.error, ValueError) as error:
        return [(path, *[None] * 15, f"{type(error).__name__}: {error}"[:140])]


def decoded(b: dict) -> np.ndarray:
    """The pixels of one block, without the padding of edge tiles; a block that is left out is all zeros."""
    shape = (b["n_rows"], b["n_cols"])
    if not b["size"]:
        return np.zeros(shape, dtype=b["number"])
    with _open(b["file"]) as source:
        raw = source.read_at(b["size"], b["offset"])
    if b["codec"] in DEFLATE:
        raw = zlib.decompress(raw)
    kind = np.dtype(b["number"])
    rows = len(raw) // (kind.itemsize * b["block_cols"])
    if rows < b["n_rows"]:
        raise NotReadable("a block is cut short")
    pixels = np.frombuffer(raw, dtype=kind, count=rows * b["block_cols"]).reshape(rows, b["block_cols"])
    if b["predictor"] == 2:
        pixels = np.cumsum(pixels, axis=1, dtype=kind.newbyteorder("="))
    return pixels[: shape[0], : shape[1]]


def raster_blocks(spark: SparkSession, path: str, pattern: str = "*.tif") -> DataFrame:
    """One row for each block of the rasters in a folder; headers are read in tasks."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path")
    schema = _arrow(BLOCKS.split(","))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                columns = list(zip(*blocks_of(name), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    return files.mapInArrow(read, BLOCKS)


def _arrow(fields: list[str]) -> pa.Schema:
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    return pa.schema([(name, types[kind]) for name, kind in (f.split() for f in fields)])


def inspection(blocks: DataFrame) -> DataFrame:
    """(file, n_blocks, n_bytes, height, width, south, west, north, east, problem) of each raster."""
    bottom, right = F.col("row0") + F.col("n_rows"), F.col("col0") + F.col("n_cols")
    found = blocks.groupBy("file").agg(
        F.count("block").alias("n_blocks"), F.sum("size").alias("n_bytes"), F.max(bottom).alias("height"), F.max(right).alias("width"),
        F.min(F.col("lat0") - bottom * F.col("res_y")).alias("south"), F.min("lon0").alias("west"), F.max("lat0").alias("north"),
        F.max(F.col("lon0") + right * F.col("res_x")).alias("east"), F.max("problem").alias("problem"),
    )
    return found


def _cells(low: Column, high: Column) -> Column:
    return F.sequence(F.floor(low / CELL).cast("int"), F.floor(high / CELL).cast("int"))


def _met(points: DataFrame, blocks: DataFrame, key: str, radius_m: float) -> DataFrame:
    """Pairs of a point and a block that its window touches, each once."""
    dlat = F.lit(radius_m / METRES_PER_DEGREE)
    dlon = radius_m / (METRES_PER_DEGREE * F.greatest(F.cos(F.radians("lat")), F.lit(1e-6)))
    p = points.select(
        key, "lat", "lon", (F.col("lat") - dlat).alias("_s"), (F.col("lat") + dlat).alias("_n"), (F.col("lon") - dlon).alias("_w"), (F.col("lon") + dlon).alias("_e")
    )
    top, left = F.col("lat0") - F.col("row0") * F.col("res_y"), F.col("lon0") + F.col("col0") * F.col("res_x")
    b = blocks.where("problem IS NULL").select(
        "*", (top - F.col("n_rows") * F.col("res_y")).alias("_bs"), top.alias("_bn"), left.alias("_bw"), (left + F.col("n_cols") * F.col("res_x")).alias("_be")
    )
    grid = lambda df, s, n, w, e: df.select("*", F.explode(_cells(F.col(s), F.col(n))).alias("_y")).select("*", F.explode(_cells(F.col(w), F.col(e))).alias("_x"))
    both = grid(p, "_s", "_n", "_w", "_e").join(grid(b, "_bs", "_bn", "_bw", "_be"), ["_y", "_x"])
    touch = (F.col("_s") <= F.col("_bn")) & (F.col("_n") >= F.col("_bs")) & (F.col("_w") <= F.col("_be")) & (F.col("_e") >= F.col("_bw"))
    # the pair belongs to the cell of the corner of what both boxes share
    corner = (F.col("_y") == F.floor(F.greatest("_s", "_bs") / CELL)) & (F.col("_x") == F.floor(F.greatest("_w", "_bw") / CELL))
    return both.where(touch & corner).select(key, "lat", "lon", *blocks.columns)


def _window(pixels: np.ndarray, b: dict, lat: float, lon: float, radius_m: float) -> tuple[np.ndarray, int | None]:
    """Classes of a block's pixels with centres within the radius, and the class of the pixel at the point."""
    cos = max(np.cos(np.radians(lat)), 1e-6)
    dlat, dlon = radius_m / METRES_PER_DEGREE, radius_m / (METRES_PER_DEGREE * cos)
    row = lambda y: int(np.floor((b["lat0"] - y) / b["res_y"])) - b["row0"]
    col = lambda x: int(np.floor((x - b["lon0"]) / b["res_x"])) - b["col0"]
    n_rows, n_cols = pixels.shape
    r = np.arange(max(row(lat + dlat), 0), min(row(lat - dlat), n_rows - 1) + 1)
    c = np.arange(max(col(lon - dlon), 0), min(col(lon + dlon), n_cols - 1) + 1)
    here = int(pixels[row(lat), col(lon)]) if 0 <= row(lat) < n_rows and 0 <= col(lon) < n_cols else None
    if not len(r) or not len(c):
        return pixels[:0, 0], here
    dy = (b["lat0"] - (r + b["row0"] + 0.5) * b["res_y"] - lat) * METRES_PER_DEGREE
    dx = (b["lon0"] + (c + b["col0"] + 0.5) * b["res_x"] - lon) * METRES_PER_DEGREE * np.cos(np.radians(lat))
    inside = dy[:, None] ** 2 + dx[None, :] ** 2 <= radius_m**2
    return pixels[r[0] : r[-1] + 1, c[0] : c[-1] + 1][inside], here


def class_counts(points: DataFrame, blocks: DataFrame, key: str, radius_m: float = 500.0) -> DataFrame:
    """(key, class, n, here, problem): pixels of each class within the radius of each point.

    points: key, lat, lon (rows without usable coordinates have no pixels).  A point near
    the edge of a block has rows of several blocks, to be summed.  A row with ``here``
    gives the class at the point itself; one with ``problem`` a block that did not decode.
    """
    usable = points.where("lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180")
    pairs = _met(usable, blocks, key, radius_m)
    near = pairs.repartitionByRange("file", "block", key).sortWithinPartitions("file", "block")
    kind = points.schema[key].dataType.simpleString()
    names = [f.split()[0] for f in BLOCKS.split(",")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pixels, problem = None, None, None
        for batch in batches:
            data = {n: batch.column(n).to_pylist() for n in (*names, "lat", "lon")}
            at, classes, counts, here, problems = [], [], [], [], []
            for i in range(batch.num_rows):
                b = {n: data[n][i] for n in names}
                if held != (b["file"], b["block"]):
                    held, problem = (b["file"], b["block"]), None
                    try:
                        pixels = decoded(b)
                    except (OSError, ValueError, zlib.error) as error:
                        pixels, problem = None, f"{type(error).__name__}: {error}"[:140]
                if problem is not None:
                    rows = [(None, 0, False, problem)]
                else:
                    seen, own = _window(pixels, b, data["lat"][i], data["lon"][i], radius_m)
                    values, n = np.unique(seen, return_counts=True)
                    rows = [(int(v), int(k), False, None) for v, k in zip(values, n, strict=True)]
                    if own is not None:
                        rows.append((own, 0, True, None))
                for v, k, own_pixel, what in rows:
                    at.append(i)
                    classes.append(v)
                    counts.append(k)
                    here.append(own_pixel)
                    problems.append(what)
            arrays = [pa.array(classes, pa.int32()), pa.array(counts, pa.int64()), pa.array(here, pa.bool_()), pa.array(problems, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), *arrays], names=[key, "class", "n", "here", "problem"])

    return near.mapInArrow(count, f"`{key}` {kind}, class int, n long, here boolean, problem string")
