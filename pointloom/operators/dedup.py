"""Deduplication rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def conflicts(fields: list[str], numeric: set[str], tolerance: float = 1e-6) -> Column:
    """Fields in which an alias differs from its canonical row; a null is no conflict.

    Reads struct columns ``_canonical`` and ``_own``.
    """
    tests = []
    for f in fields:
        a, b = F.col(f"_canonical.{f}"), F.col(f"_own.{f}")
        differs = F.abs(a - b) > tolerance if f in numeric else a != b
        tests.append(F.when(differs, F.lit(f)))
    return F.array_compact(F.array(*tests))


def dedup_by_key(
    df: DataFrame, key: str, rank: list, compared: list[str], numeric: set[str], file_col: str, id_col: str
) -> tuple[DataFrame, DataFrame]:
    """(canonical rows, alias ledger) of physical duplicates.

    The canonical row is the first by ``rank``, a total order (richness downwards,
    file, row, id).  The ledger tells each alias's relation: ATTRIBUTE_CONFLICT
    wins over SAME_FILE_REPEAT, which wins over IDENTICAL_COPY.
    """
    order = Window.partitionBy(key).orderBy(*rank)
    own = F.struct(*[F.col(c) for c in dict.fromkeys([*compared, file_col, id_col])])
    ranked = df.withColumns({"_rank": F.row_number().over(order), "_own": own}).withColumn(
        "_canonical", F.first("_own").over(order)
    )
    canonical = ranked.where("_rank = 1").drop("_rank", "_own", "_canonical")
    fields = conflicts(compared, numeric)
    relation = (
        F.when(F.size(fields) > 0, "ATTRIBUTE_CONFLICT")
        .when(F.col(f"_canonical.{file_col}") == F.col(f"_own.{file_col}"), "SAME_FILE_REPEAT")
        .otherwise("IDENTICAL_COPY")
    )
    aliases = ranked.where("_rank > 1").select(
        F.col(key),
        F.col(f"_canonical.{id_col}").alias("canonical_id"),
        F.col(f"_own.{id_col}").alias("alias_id"),
        F.col(f"_canonical.{file_col}").alias("canonical_file"),
        F.col(f"_own.{file_col}").alias("alias_file"),
        relation.alias("relation"),
        fields.alias("conflicts"),
    )
    return canonical, aliases


def file_pairs(aliases: DataFrame) -> DataFrame:
    """Aliases by canonical file, alias file and relation."""
    return aliases.groupBy("canonical_file", "alias_file", "relation").agg(F.count("*").alias("n"))


def usable_records(df: DataFrame, id_col: str, compared: list[str]) -> DataFrame:
    """Distinct records; ids whose copies differ are rejected as a whole."""
    versions = df.groupBy(id_col).agg(F.count_distinct(F.to_json(F.struct(*compared), {"ignoreNullFields": "false"})).alias("_n"))
    return df.join(versions.where("_n = 1").select(id_col), id_col, "left_semi").dropDuplicates([id_col])
