"""Formation from a stream of observations and the staged run around it.

A micro-batch is placed by :func:`pointloom.operators.formation.assign` on top of the
state of the batches before it.  State lies in tiles: the distinct members of
sources by the tile they are in, and each source's sums by the tile of its first
member.  A batch reads the members near its rows, their sources' sums, and what
else those sources have in other tiles; it writes the tiles that it changed.  So
its work follows its rows and their surroundings, not the history.

Results and state are written by batch number in the shared folder, so a batch
that is repeated after a failure writes the same tables again.  Rows must come in
order: a batch with a row before the last moment raises, as a late row would have
changed sources that are formed already; :class:`pointloom.streaming.late.Gate`
keeps such rows apart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions.fields import event_state
from pointloom.operators import digest, formation, sessions
from pointloom.operators.dedup import dedup_by_key
from pointloom.operators.formation import FormationParams
from pointloom.plans.scratch import Leftovers, written
from pointloom.sources import sinks
from pointloom.streaming.state import Tiles, TileState


class OutOfOrder(ValueError):
    """An observation came after a later one, or twice."""


def require_order(batch: DataFrame, key: str, ts: str, after: tuple[int, str] | None = None) -> DataFrame:
    """``batch``, if its (ts, key) pairs are distinct and all after the last pair before it."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    first = batch.agg(F.min(F.struct(us.alias("us"), F.col(key).alias("key"))).alias("m")).first()["m"]
    if after is not None and first is not None and (first["us"], first["key"]) < after:
        raise OutOfOrder(f"observation {first['key']} comes after a later one")
    twice = batch.groupBy(us.alias("us"), key).count().where("count > 1").limit(1).collect()
    if twice or (after is not None and first is not None and (first["us"], first["key"]) == after):
        raise OutOfOrder(f"repeated observation: {twice[0][key] if twice else first['key']}")
    return batch


MEMBERS = "anchor string, home string, lat double, lon double, pixel double"
SUMS = "anchor string, lat_sum double, lon_sum double, n long, last_us long, tiles array<string>"


@dataclass(frozen=True)
class Former:
    """Forms sources batch by batch in ``folder``: results by batch, state by tile."""

    spark: SparkSession
    folder: str
    params: FormationParams = FormationParams()
    #: Rows after it are counted and skipped.
    as_of: str | None = None
    #: The side of a tile; what a batch rewrites around its rows.
    tile_degrees: float = 0.1
    #: A string column of the batches whose values form sources of their own.
    within: str | None = None

    def __post_init__(self):
        if self.params.pixel_aware:
            raise ValueError("a stream has no largest pixel to search by; form such sources from a table")

    @property
    def tiles(self) -> Tiles:
        return Tiles(self.tile_degrees, 1.01 * self.params.radius_m / formation.METRES)

    @property
    def state(self) -> TileState:
        return TileState(self.spark, self.folder)

    @property
    def apart(self) -> list[str]:
        return ["within"] if self.within else []

    @property
    def members(self) -> str:
        return MEMBERS + "".join(f", {c} string" for c in self.apart)

    def place(self, batch: DataFrame, number: int) -> None:
        """Place one micro-batch of (pk, ts, lat, lon); for ``foreachBatch``."""
        tables = Leftovers()
        with tables:
            self._place(batch, number)
        tables.release(self.spark.range(0))

    def _place(self, batch: DataFrame, number: int) -> None:
        spark = self.spark
        rows = batch.select("pk", F.col("ts").cast("timestamp").alias("ts"), "lat", "lon", *[F.col(self.within).alias(c) for c in self.apart])
        limit = F.lit(self.as_of).cast("timestamp")
        hidden = rows.where(F.col("ts") > limit).count() if self.as_of else 0
        rows = written(rows.where(F.col("ts") <= limit) if self.as_of else rows, "batch")
        after = None
        if number:
            last = spark.read.parquet(f"{self.folder}/last/{number - 1}").first()
            after = (last["us"], last["key"]) if last["us"] is not None else None
        require_order(rows, "pk", "ts", after)
        members, sums = self._around(rows, number)
        seeds = written(members.join(sums.drop("tile", "tiles"), "anchor"), "seeds")
        formed = formation.assign(rows, "pk", "ts", self.params, state=seeds, within="within" if self.within else None)
        formed.write.mode("overwrite").parquet(f"{self.folder}/formed/batch={number}")
        formed = spark.read.parquet(f"{self.folder}/formed/batch={number}")
        changed = self._keep(formed, seeds, number)
        top = formed.agg(F.max(F.struct("us", "key")).alias("m")).select("m.us", "m.key")
        if after is not None:
            top = top.select(F.coalesce("us", F.lit(after[0])).alias("us"), F.coalesce("key", F.lit(after[1])).alias("key"))
        counts = {"n_after_as_of": hidden, "n_state_read": seeds.count(), "n_state_written": changed}
        top.withColumns({n: F.lit(v).cast("long") for n, v in counts.items()}).write.mode("overwrite").parquet(f"{self.folder}/last/{number}")

    def _around(self, rows: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
        """Members near the rows, all members of their sources, and those sources' sums."""
        near = _distinct(rows.select(F.explode(self.tiles.near(F.col("lat"), F.col("lon"))).alias("tile")))
        there = self.state.read("members", self.members, near, number)
        named = written(there.select("anchor", "home").distinct(), "named")
        sums = written(self.state.read("sums", SUMS, _distinct(named.select(F.col("home").alias("tile"))), number).join(named.select("anchor"), "anchor", "left_semi"), "sums")
        others = set(_distinct(sums.select(F.explode("tiles").alias("tile")))) - set(near)
        away = self.state.read("members", self.members, sorted(others), number).join(named.select("anchor"), "anchor", "left_semi")
        return there.unionByName(away), sums

    def _keep(self, formed: DataFrame, seeds: DataFrame, number: int) -> int:
        """Writes the tiles that the batch changed; how many rows these are."""
        tile = self.tiles.of(F.col("lat"), F.col("lon"))
        homes = formed.where("key = anchor").select("anchor", tile.alias("home")).unionByName(seeds.select("anchor", "home")).distinct()
        own = formed.groupBy(*self.apart, "anchor", "lat", "lon").agg(F.max("pixel").alias("pixel")).join(homes, "anchor")
        own = written(own.withColumn("tile", tile), "own")
        touched = _distinct(own.select("tile"))
        before = self.state.read("members", self.members, touched, number)
        members = before.unionByName(own).groupBy(*self.apart, "anchor", "home", "lat", "lon", "tile").agg(F.max("pixel").alias("pixel"))
        members = written(members, "members")
        self.state.write("members", members, number)

        at_home = _distinct(own.select(F.col("home").alias("tile")))
        added = formed.groupBy("anchor").agg(
            F.sum("lat").alias("lat_sum"), F.sum("lon").alias("lon_sum"), F.count("*").alias("n"), F.max("us").alias("last_us")
        )
        places = own.groupBy("anchor").agg(F.first("home").alias("tile"), F.collect_set("tile").alias("tiles"))
        old = self.state.read("sums", SUMS, at_home, number)
        sums = old.unionByName(added.join(places, "anchor")).groupBy("anchor", "tile").agg(
            *[F.sum(c).alias(c) for c in ("lat_sum", "lon_sum", "n")], F.max("last_us").alias("last_us"),
            F.array_distinct(F.flatten(F.collect_list("tiles"))).alias("tiles"),
        )
        sums = written(sums, "sums")
        self.state.write("sums", sums, number)
        self.state.prune("members", touched, number)
        self.state.prune("sums", at_home, number)
        return members.count() + sums.count()

    def active(self, as_of: str) -> DataFrame:
        """(anchor, n, last_us, state): whether each source was seen within the gap of an event before ``as_of``."""
        every = self.spark.read.schema(f"{SUMS}, tile string, batch long").parquet(f"{self.folder}/sums")
        newest = every.groupBy("tile").agg(F.max("batch").alias("batch"))
        state = event_state(F.timestamp_micros("last_us"), F.lit(as_of).cast("timestamp"), self.params.gap_hours)
        return every.join(newest, ["tile", "batch"]).select("anchor", "n", "last_us", state.alias("state"))

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Place what the stream holds, batch after batch, and stop."""
        query = stream.writeStream.foreachBatch(self.place).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()

    def formed(self) -> DataFrame:
        """All placements so far, with source ids."""
        rows = self.spark.read.option("basePath", f"{self.folder}/formed").parquet(f"{self.folder}/formed").drop("batch")
        return formation.named_sources(rows)

    def hidden(self) -> int:
        """Rows that were skipped because they lie after ``as_of``."""
        return self.spark.read.parquet(f"{self.folder}/last/*").agg(F.sum("n_after_as_of")).first()[0] or 0


def _distinct(tiles: DataFrame) -> list[str]:
    """The tiles around one batch, as many as its rows touch."""
    return sorted(r["tile"] for r in tiles.distinct().collect())


def emitted(named: DataFrame, p: FormationParams = FormationParams()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, events, assignments) of a formation."""
    rows = named.select("source_id", F.col("key").alias("pk"), "lat", "lon", F.timestamp_micros("us").alias("ts"))
    split = sessions.sessionize(rows, "source_id", "ts", ["pk"], p.gap_hours)
    split = split.withColumn("_digits", F.substring("source_id", 5, 40)).withColumn("event_id", sessions.event_id("_digits", "session"))
    events = split.groupBy("source_id", "event_id").agg(
        F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon")
    )
    return formation.source_table(rows), events, split.select("pk", "source_id", "event_id")


def digests(named: DataFrame, p: FormationParams = FormationParams()) -> dict[str, str]:
    """Order-free digests of sources, events and assignments, equal for equal formations."""
    sources, events, assignments = emitted(named, p)
    line = lambda df, names: digest.multiset_digest(df, F.concat_ws("|", *[F.col(n).cast("string") for n in names]))
    return {
        "sources": line(sources, ["source_id", "n", "lat_min", "lat_max", "lon_min", "lon_max"]),
        "events": line(events, ["source_id", "event_id", "n", "start", "end"]),
        "assignments": line(assignments, ["pk", "source_id", "event_id"]),
    }


def grade_mismatches(valid: DataFrame, grade: Column, version: Column) -> DataFrame:
    """(source_file, n): rows whose version says another grade than their file's name."""
    says_nrt = F.contains(F.upper(F.coalesce(version, F.lit(""))), F.lit("NRT"))
    return valid.where(says_nrt != (grade == "NRT")).groupBy("source_file").agg(F.count("*").alias("n"))


def run_staged(
    validated: DataFrame, folder: str, p: FormationParams = FormationParams(), keep: Column | None = None,
    as_of: str | None = None,
) -> dict:
    """Ledgers, days, duplicates, formation and outputs of validated observations.

    ``keep`` filters observations before they are staged (P12).  A physical key
    never spans days, so duplicates are settled within days.  Returns counts and
    digests; the tables are in ``folder``.
    """
    spark = validated.sparkSession
    sinks.write_ledgers(validated, f"{folder}/ledgers")
    valid = spark.read.parquet(f"{folder}/ledgers/observations")
    kept = valid if keep is None else valid.where(keep)
    sinks.stage_by_day(kept, f"{folder}/days")
    days = spark.read.parquet(f"{folder}/days")
    compared = ["frp_mw", "brightness_k", "confidence_class", "day_night"]
    rank = [F.desc(sum((F.col(c).isNotNull().cast("int") for c in compared), F.lit(0))), "source_file", "row_number", "observation_id"]
    rows, aliases = dedup_by_key(days, "physical_key", rank, compared, {"frp_mw", "brightness_k"}, "source_file", "observation_id")
    aliases.write.mode("overwrite").json(f"{folder}/aliases")
    rows = rows.select(F.col("physical_key").alias("pk"), F.col("timestamp_utc").alias("ts"), "lat", "lon")
    seen = rows.where(F.col("ts") <= F.lit(as_of).cast("timestamp")) if as_of else rows
    seen = written(seen, "observations")
    named = formation.named_sources(written(formation.assign(seen, "pk", "ts", p), "formed"))
    sinks.write_formation(*emitted(named, p), folder)
    formation.ambiguities(named).write.mode("overwrite").json(f"{folder}/ambiguities")
    return {
        "n_valid": valid.count(), "n_dropped_by_filter": valid.count() - kept.count(), "n_alias_rows": aliases.count(),
        "diagnostics": formation.diagnostics(named, p).first().asDict(), "digests": digests(named, p),
    }


__all__ = [
    "Former", "OutOfOrder", "digests", "emitted", "grade_mismatches", "require_order", "run_staged",
]
