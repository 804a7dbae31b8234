"""Stream state in tiles of the map, of which a batch reads and replaces only those near its rows.

A kind of state is a Parquet table partitioned by tile and then by the batch that
wrote it.  A batch reads of each tile the newest version from before itself, so a
batch that is repeated after a failure reads what it read the first time and
overwrites what it wrote.  The version before the newest stays until the next
batch that touches the tile; older ones go.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tiles:
    """Square tiles of ``degrees``; ``reach`` is how far a row looks, in degrees of latitude."""

    degrees: float
    reach: float

    def __post_init__(self):
        if self.degrees <= 2 * self.reach:
            raise ValueError("a tile must be wider than twice the reach")

    def of(self, lat: Column, lon: Column) -> Column:
        return F.concat_ws("_", *[F.floor(v / self.degrees).cast("long").cast("string") for v in (lat, lon)])

    def near(self, lat: Column, lon: Column) -> Column:
        """Tiles that hold everything within the reach: rows of tiles up and down, in each what the meridians span."""
        low, high = (F.floor((lat + d) / self.degrees).cast("long") for d in (-self.reach, self.reach))
        widest = F.least(F.lit(89.9), F.abs(lat) + self.reach)
        across = self.reach / F.cos(F.radians(widest))
        west, east = (F.floor((lon + d) / self.degrees).cast("long") for d in (-across, across))
        rows = F.transform(
            F.sequence(low, high),
            lambda y: F.transform(F.sequence(west, east), lambda x: F.concat_ws("_", y.cast("string"), x.cast("string"))),
        )
        return F.flatten(rows)


@dataclass(frozen=True)
class TileState:
    """Tables of state below ``folder``, which all executors share."""

    spark: SparkSession
    folder: str

    def _versions(self, kind: str) -> dict[str, list[int]]:
        """Batches that wrote each tile, in order; one listing of the folder, however many tiles there are."""
        jvm = self.spark._jvm
        home = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        files = home.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(home):
            return {}
        paths, said = jvm.org.apache.hadoop.fs.FileUtil.stat2Paths, jvm.org.apache.commons.lang3.ArrayUtils.toString
        found: dict[str, list[int]] = {}
        # as one text: a call for each path would cost more than the listing
        for tile, number in re.findall(r"/tile=([^/,]+)/batch=(\d+)(?=[,}])", said(paths(files.listStatus(paths(files.listStatus(home)))))):
            found.setdefault(tile, []).append(int(number))
        return {tile: sorted(numbers) for tile, numbers in found.items()}

    def read(self, kind: str, schema: str, tiles: Iterable[str], before: int) -> DataFrame:
        """The tiles' rows as of before a batch, with the column ``tile``; tiles without any are left out."""
        paths, known = [], self._versions(kind)
        for tile in tiles:
            found = [v for v in known.get(tile, []) if v < before]
            if found:
                paths.append(f"{self.folder}/{kind}/tile={tile}/batch={found[-1]}")
        full = f"{schema}, tile string"
        if not paths:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(f"{full}, batch long").option("basePath", f"{self.folder}/{kind}").parquet(*paths).drop("batch")

    def write(self, kind: str, rows: DataFrame, number: int) -> None:
        """Replaces the tiles that ``rows`` name by a version of this batch, and deletes those that no batch can read again."""
        (
            rows.withColumn("batch", F.lit(number)).repartition("tile").write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("tile", "batch").parquet(f"{self.folder}/{kind}")
        )

    def prune(self, kind: str, tiles: Iterable[str], number: int) -> None:
        """Deletes versions that are older than the newest from before the batch."""
        known = self._versions(kind)
        for tile in tiles:
            for old in [v for v in known.get(tile, []) if v < number][:-1]:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}/tile={tile}/batch={old}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
