"""Joins of tables by id, with the checks that go with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.plans.joins import broadcast_if_small


def exclude(rows: DataFrame, ids: DataFrame, *keys: str) -> DataFrame:
    """``rows`` whose keys are not in ``ids``: held-out, reviewed or pilot ids (J10, P17).  Null keys stay."""
    return rows.join(broadcast_if_small(ids.select(*keys).distinct()), list(keys), "left_anti")


def restrict(rows: DataFrame, ids: DataFrame, *keys: str) -> DataFrame:
    """``rows`` whose keys are in ``ids``."""
    return rows.join(broadcast_if_small(ids.select(*keys).distinct()), list(keys), "left_semi")


def with_context(rows: DataFrame, key: str, **tables: DataFrame) -> DataFrame:
    """``rows`` with a struct column for each table, null where it has no row of that key.

    A table has one row for each key; a repeated key is an error.
    """
    for name, table in tables.items():
        one = table.groupBy(key).agg(
            F.first(F.struct(*[F.col(f"`{c}`") for c in table.columns if c != key])).alias(name), F.count("*").alias("_n")
        )
        said = F.concat(F.lit(f"repeated key in {name}: "), F.col(key).cast("string"))
        once = F.when(F.col("_n") == 1, True).otherwise(F.raise_error(said))
        rows = rows.join(one.select(key, F.when(once, F.col(name)).alias(name)), key, "left")
    return rows


def missing(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``rows`` that ``table`` has no row of."""
    return rows.select(key).distinct().join(table.select(key), key, "left_anti")


def complete(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join in which every row must find its key; a key without a row in ``table`` raises."""
    tagged = table.withColumn("_known", F.lit(True))
    joined = rows.join(tagged, key, "left")
    said = F.concat(F.lit("key without a row: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    # the test guards a column that the result keeps, so that it cannot be pruned
    guarded = F.when(F.col("_known"), F.col(key)).otherwise(F.raise_error(said))
    return joined.withColumn(key, guarded).drop("_known")


def set_parts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(part, n): distinct keys on both sides, on the left or right only, and on either."""
    sides = left.select(key).withColumn("_s", F.lit(1)).unionByName(right.select(key).withColumn("_s", F.lit(2)))
    each = sides.groupBy(key).agg(F.min("_s").alias("lo"), F.max("_s").alias("hi"))
    parts = each.agg(
        F.count_if(F.col("lo") < F.col("hi")).alias("both"), F.count_if(F.col("hi") == 1).alias("left_only"),
        F.count_if(F.col("lo") == 2).alias("right_only"), F.count("*").alias("either"),
    )
    return parts.select(F.expr("stack(4, 'both', both, 'left_only', left_only, 'right_only', right_only, 'either', either) AS (part, n)"))


def require_same_ids(left: DataFrame, right: DataFrame, key: str) -> None:
    """Raise if the two tables do not have the same ids."""
    n = {r["part"]: r["n"] for r in set_parts(left, right, key).collect()}
    if n["left_only"] or n["right_only"]:
        raise ValueError(f"ids differ: {n['left_only']} on the left only, {n['right_only']} on the right only")


def by_role(items: DataFrame, key: str, role: str, roles: Sequence[str], *fields: str) -> DataFrame:
    """One row a key with an array of (fields) for each role, in order of the fields."""
    row = F.struct(*fields)
    lists = [F.sort_array(F.collect_list(F.when(F.col(role) == r, row))).alias(r.lower()) for r in roles]
    return items.groupBy(key).agg(*lists)


def filled_in(ledger: DataFrame, decisions: DataFrame, keys: Sequence[str], *fields: str) -> DataFrame:
    """``ledger`` with blank fields taken from the matching decision; what is there stays."""
    given = decisions.select(*keys, *[F.col(f).alias(f"_new_{f}") for f in fields])
    blank = lambda f: F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) == ""
    chosen: dict[str, Column] = {f: F.when(blank(f), F.coalesce(f"_new_{f}", f)).otherwise(F.col(f)) for f in fields}
    return ledger.join(given, list(keys), "left").withColumns(chosen).drop(*[f"_new_{f}" for f in fields])
