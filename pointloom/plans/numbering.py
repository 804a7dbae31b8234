"""Gapless numbers within groups without one task per group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number_within(
    df: DataFrame, groups: list[str], order: list[str], out: str, salts: int | None = None
) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... in column ``out``.

    A group is split into ``salts`` parts (twice the shuffle partitions, 64 at
    least, unless given) by a hash of the order columns; parts are numbered on
    their own and shifted by the rows of the parts before them, so a group with a
    third of all rows is the work of many tasks.  Rows that agree in all order
    columns are numbered in any order.  ``df`` is read twice and should be a
    written table.
    """
    if salts is None:
        salts = max(64, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    keys = [*groups, "_part"]
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        salted.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    same = reduce(
        lambda a, b: a & b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    joined = salted.alias("a").join(shifts.alias("b"), same).select("a.*", "b._shift")
    return joined.withColumn(
        out, (F.row_number().over(inside) - 1 + F.col("_shift")).cast("long")
    ).drop("_part", "_shift")
