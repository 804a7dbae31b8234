"""Scans of raw observation files.

CSV files of different layouts are read apart and united by name: one read over
mixed headers maps columns by position.  Everything is read as text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of the known layouts, in file order.
_SHARED = ["acq_date", "acq_time", "satellite", "instrument", "confidence", "version"]
LAYOUTS = {
    "viirs": ["latitude", "longitude", "bright_ti4", "scan", "track", *_SHARED, "bright_ti5", "frp", "daynight"],
    "modis": ["latitude", "longitude", "brightness", "scan", "track", *_SHARED, "bright_t31", "frp", "daynight"],
}
LAYOUTS["modis_type"] = [*LAYOUTS["modis"], "type"]
EVERY = list(dict.fromkeys(c for columns in LAYOUTS.values() for c in columns))
FILE_NAME = r"^(VIIRS_(?:NOAA20|NOAA21|SNPP)|MODIS)_(SP|NRT)_(\d{4}-\d{2}-\d{2})_range(\d+)\.csv$"


def read_layout(spark: SparkSession, paths: list[str] | str, layout: str, mode: str, product: str) -> DataFrame:
    """One layout: string columns, malformed, row_number (1 upwards per file), source_file and has_* flags.

    Rows with too few or too many cells are malformed.  ``mode`` must be HISTORICAL or NRT.
    """
    if mode not in ("HISTORICAL", "NRT"):
        raise ValueError(f"not a mode of real data: {mode}")
    columns = LAYOUTS[layout]
    lines = spark.read.text(paths).select(F.col("value"), F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    # the ids grow within a file in reading order, which row numbers of one file need
    order = Window.partitionBy("source_file").orderBy("_block", "_id")
    numbered = lines.withColumn("row_number", F.row_number().over(order) - 1).where("row_number > 0 AND trim(value) <> ''")
    cells = F.split(F.regexp_replace("value", "﻿", ""), ",")
    out = numbered.withColumn("_cells", cells)
    picked = [F.trim(F.get("_cells", F.lit(k))).alias(c) for k, c in enumerate(columns)]
    return out.select(
        *picked,
        *[F.lit(None).cast("string").alias(c) for c in EVERY if c not in columns],
        (F.size("_cells") != len(columns)).alias("malformed"),
        F.col("row_number").cast("long"),
        "source_file",
        F.lit(layout == "viirs").alias("has_ti4"),
        F.lit("bright_t31" in columns).alias("has_t31"),
        F.lit("brightness" in columns).alias("has_brightness"),
        F.lit(mode).alias("data_mode"),
        F.lit(product).alias("source_product"),
    )


def read_clean_export(spark: SparkSession, path: str, mode: str, product: str) -> DataFrame:
    """The cleaned export layout: ISO timestamps are split to date and HHMM (S02); rows count from 2."""
    raw = spark.read.option("header", True).csv(path)
    need = {"latitude", "longitude", "timestamp"}
    if not need <= {c.lower() for c in raw.columns}:
        raise ValueError(f"missing columns: {sorted(need - set(raw.columns))}")
    ts = F.try_to_timestamp("timestamp")
    text = lambda c: (F.col(c) if c in raw.columns else F.lit(None)).cast("string")
    order = Window.partitionBy(F.input_file_name()).orderBy(F.monotonically_increasing_id())
    return raw.select(
        "latitude", "longitude",
        F.date_format(ts, "yyyy-MM-dd").alias("acq_date"), F.date_format(ts, "HHmm").alias("acq_time"),
        text("brightness_k").alias("brightness"), text("frp_mw").alias("frp"), text("confidence_score").alias("confidence"),
        text("satellite").alias("satellite"), text("instrument").alias("instrument"), text("day_night").alias("daynight"),
        *[F.lit(None).cast("string").alias(c) for c in ("bright_ti4", "bright_ti5", "bright_t31", "scan", "track", "version", "type")],
        ts.isNull().alias("malformed"),
        (F.row_number().over(order) + 1).cast("long").alias("row_number"),
        F.input_file_name().alias("source_file"),
        F.lit(False).alias("has_ti4"), F.lit(False).alias("has_t31"), F.lit(True).alias("has_brightness"),
        F.lit(mode).alias("data_mode"), F.lit(product).alias("source_product"),
    )


def from_rows(spark: SparkSession, rows: list[dict], mode: str, product: str) -> DataFrame:
    """Rows in memory, as a test or a caller has them."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in EVERY])
    keys = {k for r in rows for k in r}
    data = [tuple(None if r.get(c) is None else str(r[c]) for c in EVERY) + (k,) for k, r in enumerate(rows, 1)]
    df = spark.createDataFrame(data, T.StructType([*schema.fields, T.StructField("row_number", T.LongType())]))
    return df.withColumns(
        {
            "malformed": F.lit(False), "source_file": F.lit("memory"),
            "has_ti4": F.lit("bright_ti4" in keys), "has_t31": F.lit("bright_t31" in keys),
            "has_brightness": F.lit("brightness" in keys), "data_mode": F.lit(mode), "source_product": F.lit(product),
        }
    )


def input_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(name, product, grade, start, days, sha256) of the files of a folder; other names are refused."""
    files = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    part = lambda k: F.regexp_extract(name, FILE_NAME, k)
    refused = F.raise_error(F.concat(F.lit("unknown file name: "), name))
    return files.select(
        name.alias("name"),
        F.when(name.rlike(FILE_NAME), part(1)).otherwise(refused).alias("product"),
        part(2).alias("grade"), part(3).alias("start"), part(4).try_cast("int").alias("days"),
        F.sha2("content", 256).alias("sha256"),
    ).orderBy("name")


def concat(parts: list[DataFrame]) -> DataFrame:
    """Union by name with missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def one_mode(df: DataFrame) -> DataFrame:
    """``df``, if all its rows have one data mode."""
    modes = [r[0] for r in df.select("data_mode").distinct().limit(3).collect()]
    if len(modes) > 1:
        raise ValueError(f"mixed data modes: {sorted(map(str, modes))}")
    return df


def unique_ids(df: DataFrame, key: str) -> DataFrame:
    """``df``, if no id repeats."""
    twice = df.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"repeated id: {twice[0][0]}")
    return df


def staged(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Observations staged by day, pruned to a range of days."""
    df = spark.read.parquet(path)
    if first:
        df = df.where(F.col("utc_date") >= F.lit(first).cast("date"))
    return df.where(F.col("utc_date") <= F.lit(last).cast("date")) if last else df


def read_registry(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """A source registry from CSV, optionally only the given source_id rows."""
    df = spark.read.option("header", True).csv(path)
    return df if ids is None else df.join(ids, "source_id", "left_semi")


def read_membership(spark: SparkSession, path: str) -> DataFrame:
    """physical_key and source_id of a tab-separated membership file."""
    return spark.read.option("header", True).option("sep", "\t").csv(path).select("physical_key", "source_id")


def read_event_lines(spark: SparkSession, path: str, sources: DataFrame) -> DataFrame:
    """Events written as one JSON array a line, for the wanted sources."""
    part = lambda k: F.get_json_object("value", f"$[{k}]")
    rows = spark.read.text(path).select(
        part(0).alias("event_id"), part(1).alias("source_id"), part(2).cast("long").alias("n"),
        part(3).alias("start"), part(4).alias("end"), part(7).alias("state"),
    )
    return rows.join(sources.select("source_id"), "source_id", "left_semi")


def read_map_elements(spark: SparkSession, path: str) -> DataFrame:
    """(tile, ref, e_lat, e_lon, tags) of cached map answers, one JSON file a tile."""
    point = "struct<lat:double,lon:double>"
    schema = (
        "provenance struct<tile:string>, response struct<elements:array<struct<type:string,id:bigint,lat:double,"
        f"lon:double,center:{point},tags:map<string,string>>>>"
    )
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    e = rows.select(F.col("provenance.tile").alias("tile"), F.explode("response.elements").alias("e"))
    return e.select(
        "tile", F.concat_ws("/", "e.type", F.col("e.id").cast("string")).alias("ref"),
        F.coalesce("e.lat", "e.center.lat").alias("e_lat"), F.coalesce("e.lon", "e.center.lon").alias("e_lon"), "e.tags",
    )


def fetch_windows(spark: SparkSession, first: str, last: str, days: int) -> DataFrame:
    """Windows of at most ``days`` days that cover a range, as a work list for a fetcher."""
    a, b = F.lit(first).cast("date"), F.lit(last).cast("date")
    starts = spark.range(1).select(F.explode(F.sequence(a, b, F.expr(f"interval {int(days)} days"))).alias("start"))
    end = F.least(F.date_add("start", days - 1), b)
    return starts.select("start", end.alias("end"), (F.date_diff(end, F.col("start")) + 1).alias("days"))


def prefer(primary: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``primary``, and those of ``fallback`` for keys it lacks."""
    return primary.unionByName(fallback.join(primary.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def brightness(ti4: Column, other: Column) -> Column:
    """The VIIRS channel, else the other one; blanks fall through."""
    return F.coalesce(F.nullif(F.trim(ti4), F.lit("")), F.nullif(F.trim(other), F.lit("")))
