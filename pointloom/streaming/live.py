"""The live run: product streams, known sources, provisional ones that outlive a batch.

The streams of several products are united.  Of each batch, rows whose physical key
came before are dropped, the others join the nearest known source or a provisional
one.  Leaders of provisional sources are state in tiles, so a batch reads those near
its rows.  What a batch placed, the leaders it founded and its status are written
by its number; a repeated batch writes the same again.  A batch that fails leaves
a status that says so, and the next attempt replaces it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators import live
from pointloom.operators.celljoin import KM_PER_DEGREE
from pointloom.operators.dedup import keep_first
from pointloom.plans.scratch import Leftovers, written
from pointloom.streaming.state import Tiles, TileState

COLUMNS = ["physical_key", "ts", "lat", "lon", "product"]


def united(streams: dict[str, DataFrame]) -> DataFrame:
    """Streams of (physical_key, ts, lat, lon) as one, with their product."""
    named = [s.select("physical_key", F.col("ts").cast("timestamp").alias("ts"), "lat", "lon").withColumn("product", F.lit(p)) for p, s in streams.items()]
    return reduce(DataFrame.unionByName, named)


@dataclass(frozen=True)
class LiveRun:
    spark: SparkSession
    folder: str
    #: source_id, r_lat, r_lon of all known sources.
    registry: DataFrame
    radius_km: float = 0.375
    tile_degrees: float = 0.1

    @property
    def tiles(self) -> Tiles:
        return Tiles(self.tile_degrees, 1.01 * self.radius_km / KM_PER_DEGREE)

    @property
    def state(self) -> TileState:
        return TileState(self.spark, self.folder)

    def place(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch``."""
        tables = Leftovers()
        try:
            with tables:
                self._place(batch, number)
        except Exception as error:
            # no paths or rows of the inputs in a document that is published
            self._say(number, "UNAVAILABLE", type(error).__name__, 0, 0)
            raise
        tables.release(self.spark.range(0))

    def _place(self, batch: DataFrame, number: int) -> None:
        rows = written(batch.select(*COLUMNS).withColumn("_day", F.to_date("ts")), "live")
        distinct = keep_first(rows, ["physical_key"], ["ts", "product"])
        if number:
            days = [r["_day"] for r in rows.select("_day").distinct().collect()]
            before = self.placed().where((F.col("_batch") < number) & F.col("_day").isin(days))
            distinct = distinct.join(before.select("physical_key"), "physical_key", "left_anti")
        distinct = written(distinct, "distinct")
        known = written(live.known_sources(distinct, self.registry, self.radius_km), "known")
        fresh = written(distinct.join(known, "physical_key", "left_anti"), "fresh")
        near = sorted(r["tile"] for r in fresh.select(F.explode(self.tiles.near(F.col("lat"), F.col("lon"))).alias("tile")).distinct().collect())
        leaders = written(self.state.read("leaders", live.LEADERS, near, number), "leaders")
        named, founded = live.provisional_sources(fresh, self.radius_km, leaders.drop("tile"))
        out = distinct.join(live.kinds_of(known, named), "physical_key")
        out.write.mode("overwrite").partitionBy("_day").parquet(f"{self.folder}/placed/_batch={number}")
        founded = written(founded.withColumn("tile", self.tiles.of(F.col("lat"), F.col("lon"))), "founded")
        touched = [r["tile"] for r in founded.select("tile").distinct().collect()]
        whole = founded.unionByName(self.state.read("leaders", live.LEADERS, touched, number))
        self.state.write("leaders", whole, number)
        self.state.prune("leaders", touched, number)
        self._say(number, "OK" if distinct.count() else "OK_NO_DETECTIONS", "", rows.count(), distinct.count())

    def _say(self, number: int, status: str, detail: str, rows: int, kept: int) -> None:
        kind = "batch long, status string, detail string, observations long, distinct_observations long"
        said = self.spark.createDataFrame([(number, status, detail, rows, kept)], kind)
        said.coalesce(1).write.mode("overwrite").json(f"{self.folder}/status/{number}")

    def placed(self) -> DataFrame:
        """All observations with source and kind, by batch and day."""
        kinds = ", ".join(("physical_key string", "ts timestamp", "lat double", "lon double", "product string", "source_id string", "kind string", "_batch long", "_day date"))
        return self.spark.read.schema(kinds).option("basePath", f"{self.folder}/placed").parquet(f"{self.folder}/placed")

    def status(self) -> DataFrame:
        return self.spark.read.json(f"{self.folder}/status/*")

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        query = stream.writeStream.foreachBatch(self.place).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
