"""Sharding by sampled splitters.

Records are sorted in spirit only: keys (a hash of the text, so that equal texts
stay together) are sampled with probability in proportion to size, quantiles of
the sample are the splitters, and records are partitioned into the ranges between
them.  The true size of each range is then summed.  A range larger than
``most_share`` of a shard is subdivided by a second hash, of the row: only a text
whose copies (or repeated rows) fill a good part of a shard is spread over several.
Ranges go to shards largest first, each to the emptiest shard, so shards are near
equal in bytes and groups of equal texts stay whole below that size.

Everything is DataFrame work; the driver sees the splitters and one row for each
range (``ranges`` plus the subdivisions, whose number is bounded by the parameters).

Cases: a null text has no bytes and counts its overhead of 1; repeated rows are
records of their own, in slots of their own; a null id is allowed; of a very long
text only size and hashes are kept, and one larger than a shard is a shard's bulk;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.plans.numbering import number_within
from pointloom.plans.ranges import range_of
from pointloom.plans.scratch import written


@dataclass(frozen=True)
class ShardParams:
    shards: int = 8
    ranges: int = 512
    #: Expected size of the sample the splitters are read from.
    sample: int = 16_384
    #: A range may hold so much of a shard before it is subdivided ...
    most_share: float = 0.5
    #: ... into parts of about so much of a shard.
    part_share: float = 1 / 16
    overhead: int = 1


def splitters(records: DataFrame, total: int, params: ShardParams) -> list[int]:
    """Sorted bounds of the key ranges.

    A record is drawn with probability size * sample / total (at most 1) and
    weighs 1 or, if that exceeds 1, as much.  A key that fills a whole quantile
    gets a range of its own.
    """
    expected = F.col("size") * (params.sample / max(total, 1))
    draw = F.pmod(F.xxhash64("_sub", F.lit("draw")), F.lit(1 << 52)) / float(1 << 52)
    drawn = records.where(draw < expected).withColumn(
        "_weight", F.greatest(F.lit(1), F.round(expected).cast("long"))
    )
    shares = [k / params.ranges for k in range(1, params.ranges)]
    cuts = drawn.agg(F.percentile("_key", F.array(*map(F.lit, shares)), F.col("_weight")).alias("c")).first()["c"]
    bounds: list[int] = []
    for cut in map(int, cuts or []):
        if bounds and cut <= bounds[-1]:
            if cut == bounds[-1] and (len(bounds) < 2 or bounds[-1] - 1 != bounds[-2]):
                bounds.append(cut + 1)
            continue
        bounds.append(cut)
    return bounds


def assign(sizes: list[tuple[tuple[int, int], int]], shards: int) -> dict[tuple[int, int], int]:
    """Shard of each part: largest first, to the emptiest shard."""
    load = [(0, s) for s in range(shards)]
    out = {}
    for part, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        filled, shard = heapq.heappop(load)
        out[part] = shard
        heapq.heappush(load, (filled + size, shard))
    return out


def shard(
    docs: DataFrame, params: ShardParams, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every record, near equal in bytes."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    # 52 bits of the hash are kept, which quantiles in double precision hold exactly
    records = written(
        docs.select(
            id_col,
            (F.octet_length(text) + params.overhead).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(text), 12).alias("_key"),
            F.xxhash64(F.col(id_col), text).alias("_sub"),
            # tells repeated rows apart; the table is written once, so it stays as it is
            F.xxhash64(F.col(id_col), text, F.monotonically_increasing_id()).alias("_row"),
        ),
        "records",
    )
    total = records.agg(F.sum("size")).first()[0] or 0
    ranged = records.withColumn("_range", range_of(F.col("_key"), splitters(records, total, params)))
    by_range = {r["_range"]: r["s"] for r in ranged.groupBy("_range").agg(F.sum("size").alias("s")).collect()}
    shard_size = max(total / params.shards, 1)
    parts = {
        r: math.ceil(s / (shard_size * params.part_share))
        for r, s in by_range.items()
        if s > shard_size * params.most_share
    }
    divided = F.lit(0)
    for r, n in sorted(parts.items()):
        divided = F.when(F.col("_range") == r, F.pmod(F.col("_row"), F.lit(n)).cast("int")).otherwise(divided)
    ranged = ranged.withColumn("_part", divided)
    sums = ranged.groupBy("_range", "_part").agg(F.sum("size").alias("s")).collect()
    shards = assign([((r["_range"], r["_part"]), r["s"]) for r in sums], params.shards)
    # one row for each range or part of one: a number set by the parameters
    table = F.broadcast(
        spark.createDataFrame([(*k, v) for k, v in shards.items()], "_range int, _part int, shard int")
    )
    placed = ranged.join(table, ["_range", "_part"]).select(
        id_col, "size", "text_crc32", "_row", "shard"
    )
    return number_within(placed, ["shard"], ["_row"], "slot").drop("_row")
