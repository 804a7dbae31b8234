"""Written outputs."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions import geo
from pointloom.operators import digest
from pointloom.operators.packets import blinded
from pointloom.plans.scratch import written


def stage_by_day(df: DataFrame, path: str, ts: str = "timestamp_utc") -> None:
    """Parquet by UTC day, rows of a day in few files."""
    dated = df.withColumn("utc_date", F.to_date(ts))
    dated.repartition("utc_date").write.mode("overwrite").partitionBy("utc_date").parquet(path)


def write_ledgers(validated: DataFrame, path: str) -> None:
    """Exclusions and field flags as JSON lines, valid rows as Parquet."""
    validated.where("reason IS NULL").write.mode("overwrite").parquet(f"{path}/observations")
    validated.where("reason IS NOT NULL").select("source_file", "row_number", "reason", "duplicate_of").write.mode("overwrite").json(f"{path}/exclusions")
    validated.where("reason IS NULL").select("observation_id", F.explode("flags").alias("flag")).write.mode("overwrite").json(f"{path}/flags")


def write_formation(sources: DataFrame, events: DataFrame, assignments: DataFrame, path: str) -> None:
    """Sources, events and assignments."""
    for name, df in (("sources", sources), ("events", events), ("assignments", assignments)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_activity(df: DataFrame, path: str, decimals: dict[str, int]) -> None:
    """CSV sorted by source with fixed decimals (K04); several part files keep the order."""
    shown = df.withColumns({c: geo.decimals(F.col(c), n) for c, n in decimals.items()})
    shown.orderBy("source_id").write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def facility_index(df: DataFrame, south=5.0, north=39.0, west=66.0, east=99.0) -> DataFrame:
    """Facilities of a region ordered by kind and id."""
    return df.where(F.col("lat").between(south, north) & F.col("lon").between(west, east)).orderBy("kind", F.col("site_id").cast("string"))


def contract_document(stats: dict, sources: DataFrame, points: DataFrame, most: int = 300, most_points: int = 3000) -> dict:
    """The packaged document of the best sources and its content hash.

    At most ``most`` sources and ``most_points`` points reach the driver.
    """
    rows = lambda df, n: [json.loads(r) for r in df.orderBy("rank").limit(n).toJSON().collect()]
    body = {"stats": stats, "sources": rows(sources, most), "points": rows(points, most_points)}
    text = json.dumps(body, sort_keys=True, separators=(",", ":"))
    return body | {"run_id": "demo-" + hashlib.sha256(text.encode()).hexdigest()[:12]}


def write_or_report(job, path_writer, sanitized_status: str = "LIVE_FEED_UNAVAILABLE") -> dict:
    """Run a job; on failure hand a status document without details to the writer."""
    try:
        document = {"status": "OK", **job()}
    except Exception as error:
        document = {"status": sanitized_status, "error_type": type(error).__name__}
    path_writer(document)
    return document


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small document as a text file in the folder ``path``."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_tables(path: str, tables: dict[str, DataFrame], keys: dict[str, str], params: dict) -> dict:
    """Each table as CSV sorted by its key, with a manifest of columns, rows and digests.

    Digests do not depend on the order of rows or on part files, so a repeated run
    is compared by its manifest.
    """
    found = {}
    for name, df in tables.items():
        df.orderBy(keys[name]).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
        line = digest.canonical_json({c: F.col(c) for c in df.columns})
        found[name] = {
            "columns": {f.name: f.dataType.simpleString() for f in df.schema.fields},
            "rows": df.count(), "digest": digest.multiset_digest(df, line),
        }
    body = digest.manifest({}, params, {k: json.dumps(v, sort_keys=True) for k, v in found.items()}) | {"tables": found}
    spark = next(iter(tables.values())).sparkSession
    write_text(spark, json.dumps(body, sort_keys=True), f"{path}/manifest")
    return body


def write_packet(packets: DataFrame, source: str, path: str) -> None:
    """The packet for annotators as CSV and JSON lines, and apart from it the private key."""
    shown, private = blinded(packets, source)
    shown.orderBy("annotation_id").write.mode("overwrite").option("header", True).csv(f"{path}/packet_csv")
    shown.orderBy("annotation_id").write.mode("overwrite").json(f"{path}/packet_json")
    private.orderBy("annotation_id").write.mode("overwrite").json(f"{path}/PRIVATE_key")


def write_candidates(scored: DataFrame, flag: str, path: str, *order: str) -> None:
    """Flagged sources as CSV, best first."""
    scored.where(F.col(flag)).orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def write_frontend(rows: DataFrame, path: str, key: str = "source_id") -> None:
    """Context rows as JSON lines with nulls kept, sorted by id."""
    rows.orderBy(key).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_new(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose keys the master does not hold yet; how many they were.

    Key columns that the rows lack are left out of the comparison.
    """
    spark = rows.sparkSession
    try:
        master = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        master = None
    used = [k for k in keys if k in rows.columns]
    fresh = rows.dropDuplicates(used)
    if master is not None:
        fresh = fresh.join(master.select(*used).distinct(), used, "left_anti")
    fresh = written(fresh, "fresh")
    fresh.write.mode("append").parquet(path)
    return fresh.count()


class GateClosed(RuntimeError):
    """A model was to be saved although its labels do not suffice."""


def save_model(model, path: str, facts: dict) -> None:
    """A fitted pipeline and its facts; without a model, as while the label gate is closed, this raises."""
    if model is None:
        raise GateClosed("the label gate is closed: there is no model to save")
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    write_text(spark, json.dumps(facts, sort_keys=True, default=str), f"{path}/facts")
