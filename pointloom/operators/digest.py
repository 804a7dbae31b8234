"""Order-independent digests and canonical JSON."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMBS = 8


def multiset_digest(df: DataFrame, line: Column) -> str:
    """Sum of the rows' SHA-256 modulo 2**256, as hex: equal for any order of the same rows.

    Spark sums eight 32-bit limbs; the carries are done on the eight sums.
    """
    h = F.sha2(line, 256)
    sums = df.select(
        *[F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("decimal(20,0)").alias(f"l{k}") for k in range(LIMBS)]
    ).agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)]).first()
    total = sum(int(sums[k] or 0) << (32 * (LIMBS - 1 - k)) for k in range(LIMBS))
    return f"{total % 2**256:064x}"


def limb_sums(df: DataFrame, line: Column) -> DataFrame:
    """The eight limb sums as one row of longs."""
    h = F.sha2(line, 256)
    limb = lambda k: F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long")
    return df.agg(*[F.sum(limb(k)).alias(f"limb{k}") for k in range(LIMBS)])


def canonical_json(columns: dict[str, Column]) -> Column:
    """Compact JSON of columns with sorted keys; nulls are written."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})


def manifest(inputs: dict[str, str], params: dict, outputs: dict[str, str]) -> dict:
    """A run manifest and the hash of its stable part."""
    stable = {"inputs": dict(sorted(inputs.items())), "params": params, "outputs": dict(sorted(outputs.items()))}
    text = json.dumps(stable, sort_keys=True, separators=(",", ":"), default=str)
    return stable | {"manifest_hash": hashlib.sha256(text.encode()).hexdigest()}


def file_hashes(spark, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
