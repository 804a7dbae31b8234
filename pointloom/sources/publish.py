"""Sets of tables that change as one: written aside, made current by one rename.

    <path>/data/<folder>/<table>/    Parquet of one version
    <path>/versions/000000007.json   its manifest; the greatest number is current

The tables of a version are written to a folder of their own, then the manifest is
written under a name that no reader looks at and renamed to the next number.  A job
that is lost before the rename leaves the earlier version as it was; a reader holds a
manifest, so it never sees tables of two versions.  Of two jobs that publish at once
one gets the number and the other :class:`Conflict`: the rename does not replace.  The
file system must rename atomically, as HDFS does; a store of objects does not.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators import digest


class Conflict(RuntimeError):
    """Another job published the version that this one was about to."""


class Damaged(RuntimeError):
    """A table is not what its manifest says."""


class _Files:
    """The few calls on the shared file system that publishing needs."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        root = self._path(path)
        conf = spark._jsc.hadoopConfiguration()
        self._fs = root.getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def names(self, folder: str) -> list[tuple[str, int]]:
        """(name, time of last change in ms) of what is in a folder."""
        where = self._path(folder)
        if not self._fs.exists(where):
            return []
        return [(s.getPath().getName(), s.getModificationTime()) for s in self._fs.listStatus(where)]

    def write(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(path), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, path: str) -> str:
        where = self._path(path)
        size = self._fs.getFileStatus(where).getLen()
        stream = self._fs.open(where)
        try:
            return bytes(stream.readNBytes(int(size))).decode()
        finally:
            stream.close()

    def rename(self, source: str, target: str) -> bool:
        """Whether ``source`` got the name ``target``, which must be free."""
        try:
            self._context.rename(self._path(source), self._path(target), self._options)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


def _versions(files: _Files, path: str) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n, _ in files.names(f"{path}/versions") if n.endswith(".json"))


def _facts(df: DataFrame) -> dict:
    line = digest.canonical_json({c: F.col(c) for c in df.columns})
    return {
        "columns": {f.name: f.dataType.simpleString() for f in df.schema.fields},
        "rows": df.count(), "digest": digest.multiset_digest(df, line),
    }


def publish(path: str, tables: Mapping[str, DataFrame], params: Mapping | None = None, after: int | None = None) -> dict:
    """Write ``tables`` as the next version of ``path`` and return its manifest.

    The manifest holds, for each table, columns, rows and a digest that does not depend
    on the order of rows.  With ``after``, publishing fails unless that version is
    current (0: none yet).  Counts and digests are taken from what was written.
    """
    spark = next(iter(tables.values())).sparkSession
    path, files = path.rstrip("/"), _Files(spark, path)
    last = max(_versions(files, path), default=0)
    if after is not None and after != last:
        raise Conflict(f"version {last} is current, not {after}")
    folder, found = uuid.uuid4().hex, {}
    for name, df in tables.items():
        place = f"{path}/data/{folder}/{name}"
        df.write.parquet(place)
        found[name] = _facts(spark.read.parquet(place))
    stable = digest.manifest({}, dict(params or {}), {k: json.dumps(v, sort_keys=True) for k, v in found.items()})
    body = {"version": last + 1, "folder": folder, "params": stable["params"], "tables": found, "manifest_hash": stable["manifest_hash"]}
    aside = f"{path}/data/{folder}/manifest"
    files.write(aside, json.dumps(body, sort_keys=True))
    files._fs.mkdirs(files._path(f"{path}/versions"))
    if not files.rename(aside, f"{path}/versions/{last + 1:09d}.json"):
        files.delete(f"{path}/data/{folder}")
        raise Conflict(f"version {last + 1} was published by another job")
    return body


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The manifest of a version, the current one if none is named; None where nothing was published."""
    path, files = path.rstrip("/"), _Files(spark, path)
    known = _versions(files, path)
    if version is None:
        version = max(known, default=None)
    if version not in known:
        return None
    return json.loads(files.read(f"{path}/versions/{version:09d}.json"))


def read(spark: SparkSession, path: str, name: str, of: dict | None = None) -> DataFrame:
    """A table of the manifest ``of``, or of the current version."""
    of = of or manifest(spark, path)
    if of is None:
        raise FileNotFoundError(f"nothing was published at {path}")
    columns = of["tables"][name]["columns"]
    schema = ", ".join(f"`{c}` {t}" for c, t in columns.items())
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/data/{of['folder']}/{name}")


def verify(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The manifest of a version whose tables were read again and are as it says, else :class:`Damaged`."""
    of = manifest(spark, path, version)
    if of is None:
        raise FileNotFoundError(f"nothing was published at {path}")
    for name, facts in of["tables"].items():
        seen = _facts(read(spark, path, name, of))
        off = [k for k in ("rows", "digest") if seen[k] != facts[k]]
        if off:
            raise Damaged(f"{name}: {', '.join(off)} differ from version {of['version']}")
    return of


def clean(spark: SparkSession, path: str, keep: int = 2, older_than_s: float = 86_400.0) -> list[str]:
    """Delete the data of all but the last ``keep`` versions, and what lost jobs left behind; the folders deleted.

    Folders younger than ``older_than_s`` stay: a job may still be writing one, or a
    reader be reading it.  A version whose data goes loses its manifest first.
    """
    if keep < 1:
        raise ValueError("the current version stays")
    path, files = path.rstrip("/"), _Files(spark, path)
    known = _versions(files, path)
    kept = {manifest(spark, path, v)["folder"] for v in known[-keep:]}
    limit = (time.time() - older_than_s) * 1000
    old = {name for name, changed in files.names(f"{path}/data") if name not in kept and changed <= limit}
    for v in known[:-keep]:
        if manifest(spark, path, v)["folder"] in old:
            files.delete(f"{path}/versions/{v:09d}.json")
    for name in old:
        files.delete(f"{path}/data/{name}")
    return sorted(old)


def publish_draw(path: str, drawn: DataFrame, population: DataFrame, stratum: str, quotas: Mapping[str, int], seed: str) -> dict:
    """A stratified draw and the populations of its strata."""
    strata = population.groupBy(stratum).agg(F.count("*").alias("population"))
    counts = drawn.groupBy(stratum).agg(F.count("*").alias("drawn"))
    frame = strata.join(counts, stratum, "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    return publish(path, {"draw": drawn, "strata": frame}, {"seed": seed, "quotas": dict(quotas)})


def publish_intake(path: str, run: Mapping[str, DataFrame], packet_hash: str) -> dict:
    """What the intake of two sheets found (K14): the report, the sheet for the adjudicator, the final labels."""
    report = run["errors"].groupBy("sheet", "error").agg(F.count("*").alias("n"))
    parts = {k: run[k] for k in ("alignment", "agreement", "disputed", "unasked", "final")}
    return publish(path, {"errors": run["errors"], "report": report, **parts}, {"packet": packet_hash})


def publish_expansion(path: str, candidates: DataFrame, capacity: DataFrame, worklist: DataFrame, audit: Mapping) -> dict:
    """Expansion candidates, the order in which to look at them, capacity, tiles to fetch, and the audit.

    candidates as from ``research.expand_labels``.  An audit that failed publishes nothing.
    """
    if audit["verdict"] != "PASS":
        raise ValueError(f"the audit failed: {audit}")
    review = candidates.where("status = 'REVIEW'")
    ledger = candidates.groupBy("status", "label").agg(F.count("*").alias("n"))
    return publish(path, {"candidates": candidates, "review": review, "ledger": ledger, "capacity": capacity, "worklist": worklist}, {"audit": dict(audit)})


def store_tiles(rows: DataFrame, path: str, tile: str = "tile") -> None:
    """Cache rows by tile: the tiles that ``rows`` has are replaced whole, all others stay.

    A tile with many rows is written by several tasks.
    """
    spread = rows.hint("rebalance", tile)
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(tile).parquet(path)


def stored_tiles(spark: SparkSession, path: str, wanted: DataFrame, schema: str, tile: str = "tile") -> DataFrame:
    """Cached rows of the tiles ``wanted``; the join prunes the folders of the others."""
    rows = spark.read.schema(f"{schema}, {tile} string").parquet(path)
    return rows.join(wanted.select(tile).distinct(), tile, "left_semi")
