import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm import odd
from xxhash import xxh64_intdigest

from pointloom.llm import sharding


def check(rows, texts):
    sizes = sorted((str(k), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in texts)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sizes
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r["shard"] < 8
        slots[r["shard"]].append(r["slot"])
    for found in slots.values():
        assert sorted(found) == list(range(len(found)))


def test_odd_documents(spark):
    rows = sharding.shard(odd.table(spark), sharding.ShardParams()).collect()
    check(rows, [r[:2] for r in odd.rows()])


def test_empty_table(spark):
    assert sharding.shard(odd.empty(spark), sharding.ShardParams()).count() == 0


def test_documents_are_near_equal_and_copies_stay_together(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.shard(docs, sharding.ShardParams()).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    load = Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
    assert max(load.values()) - min(load.values()) < 0.05 * sum(load.values()) / 8
    shards = defaultdict(set)
    for r in rows:
        shards[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(s) == 1 for s in shards.values())


def test_a_hot_text_is_subdivided(spark):
    rows = [(k, "copy " * 50 if k % 3 == 0 else f"text {k} " * 25) for k in range(3000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), sharding.ShardParams()).collect()
    check(got, rows)
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert max(load.values()) < 1.1 * sum(load.values()) / 8


def test_largest_parts_go_first():
    shards = sharding.assign([((0, 0), 5), ((1, 0), 4), ((2, 0), 3), ((3, 0), 3)], 2)
    assert shards == {(0, 0): 0, (1, 0): 1, (2, 0): 1, (3, 0): 0}


def test_smallest_table_runs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(3)
    assert sharding.shard(docs, sharding.ShardParams()).count() == 3


def test_repeated_rows_are_spread_too(spark):
    rows = [(1, "copy " * 50) if k % 3 == 0 else (k, f"text {k} " * 25) for k in range(3000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), sharding.ShardParams()).collect()
    check(got, rows)
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert max(load.values()) < 1.1 * sum(load.values()) / 8


def test_splitters_equal_brute_force(spark):
    """Draws, weights and quantiles in plain Python; each range's bytes from the bounds."""
    params = sharding.ShardParams(ranges=16, sample=300)
    draw = np.random.default_rng(6)
    rows = [(int(k), int(s), int(u)) for k, s, u in zip(
        draw.integers(0, 2**40, 900) * (draw.random(900) < 0.8), draw.integers(1, 4000, 900), draw.integers(-2**60, 2**60, 900), strict=True)]
    total = sum(s for _, s, _ in rows)
    records = spark.createDataFrame(rows, "_key long, size long, _sub long")
    sample = []
    for key, size, sub in rows:
        expected = size * (params.sample / total)
        h = xxh64_intdigest(b"draw", xxh64_intdigest(struct.pack("<q", sub), 42))
        h -= (h >> 63) << 64
        if (h % (1 << 52)) / (1 << 52) < expected:
            sample += [key] * max(1, round(expected))
    cuts = [int(x) for x in np.quantile(np.array(sorted(sample), float), [k / params.ranges for k in range(1, params.ranges)])]
    bounds = []
    for cut in cuts:  # a key that fills a quantile gets a range of its own
        if not bounds or cut > bounds[-1]:
            bounds.append(cut)
        elif cut == bounds[-1]:
            bounds.append(cut + 1)
    assert sharding.splitters(records, total, params) == bounds
    ranged = records.groupBy(sharding.range_of(F.col("_key"), bounds).alias("r")).agg(F.sum("size").alias("s")).collect()
    wanted = Counter()
    for key, size, _ in rows:
        wanted[sum(b <= key for b in bounds)] += size
    assert {r["r"]: r["s"] for r in ranged} == wanted
