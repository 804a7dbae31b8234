"""Rows that come late or again: two outputs under one batch number.

A batch closes all moments before the latest event time of the batches before it,
less the allowed lateness.  Rows of a closed moment are late; rows whose key an
earlier row had, in this batch or among what is still open, are repeated.  Both go
to the dead letters with their reason, the others are kept.  Kept rows, dead
letters and the closed moment are written by batch number, so a batch that is
repeated after a failure replaces its own rows and writes nothing twice.

A key must name the day (as a physical key does): kept rows are partitioned by
day, and only days that are still open are read again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.plans.scratch import Leftovers, written


@dataclass(frozen=True)
class Gate:
    spark: SparkSession
    folder: str
    key: list[str]
    ts: str
    #: The order in which rows of one key within a batch come first.
    order: list[str]
    lateness: str = "2 days"

    def closed_before(self, number: int):
        """The moment that the batches before ``number`` closed, as microseconds; None for the first."""
        if not number:
            return None
        return self.spark.read.parquet(f"{self.folder}/closed/{number - 1}").first()["us"]

    def place(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch``."""
        tables = Leftovers()
        with tables:
            self._place(batch, number)
        tables.release(self.spark.range(0))

    def _place(self, batch: DataFrame, number: int) -> None:
        us = F.unix_micros(F.col(self.ts).cast("timestamp"))
        rows = written(batch.withColumn("_us", us).withColumn("_day", F.to_date(F.col(self.ts).cast("timestamp"))), "gate")
        closed = self.closed_before(number)
        late = F.lit(False) if closed is None else F.col("_us") < closed
        first = F.row_number().over(Window.partitionBy(*self.key).orderBy("_us", *self.order)) == 1
        timely = rows.where(~late).withColumn("_again", ~first)
        if number:
            open_ = self.kept(number).where(F.col("_day") >= F.to_date(F.timestamp_micros(F.lit(closed or 0).cast("long"))))
            known = open_.select(*self.key).distinct().withColumn("_known", F.lit(True))
            timely = timely.join(known, self.key, "left").withColumn("_again", F.col("_again") | F.col("_known").isNotNull()).drop("_known")
        timely = written(timely, "timely")
        out = lambda kind: f"{self.folder}/{kind}/_batch={number}"
        kept = timely.where("not _again").drop("_again", "_us")
        kept.write.mode("overwrite").partitionBy("_day").parquet(out("kept"))
        dead = self._dead(rows.where(late), "LATE").unionByName(self._dead(timely.where("_again").drop("_again"), "REPEATED"))
        dead.write.mode("overwrite").parquet(out("dead"))
        least = F.unix_micros(F.timestamp_micros(F.max("_us")) - F.expr(f"interval {self.lateness}"))
        top = rows.agg(least.alias("us"))
        if closed is not None:
            top = top.select(F.greatest(F.col("us"), F.lit(closed)).alias("us"))
        top.write.mode("overwrite").parquet(f"{self.folder}/closed/{number}")

    @staticmethod
    def _dead(rows: DataFrame, reason: str) -> DataFrame:
        return rows.drop("_us", "_day").withColumn("reason", F.lit(reason))

    def kept(self, before: int | None = None) -> DataFrame:
        """Kept rows of all batches, or of those before one, with their day and batch."""
        rows = self.spark.read.option("basePath", f"{self.folder}/kept").parquet(f"{self.folder}/kept")
        return rows if before is None else rows.where(F.col("_batch") < before)

    def dead(self) -> DataFrame:
        """Late and repeated rows of all batches, with reason and batch."""
        return self.spark.read.option("basePath", f"{self.folder}/dead").parquet(f"{self.folder}/dead")

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        query = stream.writeStream.foreachBatch(self.place).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()

