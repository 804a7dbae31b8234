"""Joins with tables that are usually small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a table, written as JSON, that a broadcast may hold at most.
MOST_BYTES = 8 << 20


def broadcast_if_small(
    df: DataFrame, most_rows: int = 20_000, most_bytes: int = MOST_BYTES
) -> DataFrame:
    """``df`` marked for broadcast if its rows and bytes are within bounds, else as it is.

    Both are measured on the first ``most_rows + 1`` rows only; a larger table is
    left to a shuffled join with adaptive skew handling.
    """
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    found = df.limit(most_rows + 1).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")
    ).first()
    return F.broadcast(df) if found["n"] <= most_rows and found["bytes"] <= most_bytes else df


def join_heavy(rows: DataFrame, table: DataFrame, key: str, weight: str, most: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row for each key and how many rows it has (``weight``).

    Fewer than ``most`` keys can have more than that share of all rows each; these
    are broadcast, the others are shuffled, so no key's rows meet in one task.
    Both sides are read twice and should be written tables.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) > total / most
    head = table.where(heavy)
    tail = rows.join(F.broadcast(head.select(key)), key, "left_anti").join(table.where(~heavy), key)
    return rows.join(F.broadcast(head), key).unionByName(tail)


def join_sized(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """Like :func:`join_heavy`, but a table within the bounds of a broadcast is broadcast whole."""
    marked = broadcast_if_small(table)
    return join_heavy(rows, table, key, weight) if marked is table else rows.join(marked, key)
