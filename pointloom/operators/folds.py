"""Folds of whole groups with the class shares of all rows.

Groups with the same counts of each class are interchangeable, so they are one
vector with a multiplicity.  Each fold gets as many groups of a vector as divide
evenly; the rest are dealt one by one, the most uneven vectors first, to the fold
that leaves the classes spread most evenly.  Spark numbers a vector's groups by a
hash and gives them their folds; only vectors and multiplicities are gathered.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.plans.joins import broadcast_if_small
from pointloom.plans.numbering import number_within
from pointloom.plans.scratch import written

#: Distinct vectors that are dealt in memory; more mean that the label is not a class.
MOST_VECTORS = 200_000


def class_vectors(df: DataFrame, label: str, group: str) -> DataFrame:
    """(group, vector): how many rows of each class a group has, sorted by class."""
    counts = df.groupBy(group, F.col(label).cast("string").alias("_c")).agg(F.count("*").alias("_n"))
    return counts.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("_c", "_n"))).alias("vector"))


def dealt(vectors: list[tuple[tuple[int, ...], int]], folds: int) -> list[list[int]]:
    """The fold of each group of each vector: ``vectors`` hold counts by class and a multiplicity."""
    classes = len(vectors[0][0]) if vectors else 0
    held = [[0] * classes for _ in range(folds)]
    total = [sum(v[c] * m for v, m in vectors) or 1 for c in range(classes)]

    def cost(vector: tuple[int, ...], fold: int) -> float:
        """Of the classes that the vector has: how much less even they become; the mean stays whatever the fold."""
        return sum(((held[fold][c] + n) ** 2 - held[fold][c] ** 2) / total[c] ** 2 for c, n in enumerate(vector) if n)

    def unevenness(vector: tuple[int, ...]) -> float:
        mean = sum(vector) / classes
        return math.sqrt(sum((n - mean) ** 2 for n in vector) / classes)

    order = sorted(range(len(vectors)), key=lambda k: (-unevenness(vectors[k][0]), vectors[k][0]))
    out: list[list[int]] = [[] for _ in vectors]
    for k in order:
        vector, times = vectors[k]
        own = [f for f in range(folds)] * (times // folds)
        for f in own:
            for c, n in enumerate(vector):
                held[f][c] += n
        for _ in range(times % folds):
            fold = min(range(folds), key=lambda f: (cost(vector, f), sum(held[f]), f))
            own.append(fold)
            for c, n in enumerate(vector):
                held[fold][c] += n
        out[k] = own
    return out


def stratified_folds(df: DataFrame, label: str, group: str, folds: int = 5, seed: int = 0) -> DataFrame:
    """(group, fold): each group has one fold, and each class is spread over the folds as evenly as the groups allow.

    The share of a class in a fold differs from the class's share in all rows by at
    most one largest group of rows for each class on the way; the tests state it.
    Null labels are a class, null groups one group; ``seed`` reorders equal groups.
    """
    spark = df.sparkSession
    known = df.select(F.coalesce(F.col(label).cast("string"), F.lit("")).alias("_label"), F.col(group))
    vectors = written(class_vectors(known, "_label", group).withColumn("_h", F.xxhash64(F.lit(seed), group)), "vectors")
    counted = vectors.groupBy("vector").agg(F.count("*").alias("times")).limit(MOST_VECTORS + 1).collect()
    if len(counted) > MOST_VECTORS:
        raise ValueError(f"more than {MOST_VECTORS} different class counts")
    names = sorted({c for r in counted for c, _ in r["vector"]})
    full = [(tuple(dict(map(tuple, r["vector"])).get(c, 0) for c in names), r["times"]) for r in counted]
    rows = []
    for r, (_, times), own in zip(counted, full, dealt(full, folds), strict=True):
        # the even part is by number; the list holds the rest only
        rows.append((r["vector"], times - times % folds, own[times - times % folds :]))
    kind = vectors.schema["vector"].dataType.simpleString()
    plan = spark.createDataFrame(rows, f"vector {kind}, even long, rest array<int>")
    placed = number_within(vectors, ["vector"], ["_h", group], "_k").join(broadcast_if_small(plan), "vector")
    fold = F.when(F.col("_k") < F.col("even"), F.col("_k") % folds).otherwise(F.get("rest", (F.col("_k") - F.col("even")).cast("int")))
    return placed.select(group, fold.cast("int").alias("fold"))
