"""How far the sources of a language differ in their words.

Each term of a language becomes one wide row: an array with an entry for each
source, by the source's index, that has the term.  Higher-order functions turn the
counts of such a row into probabilities and emit one contribution for each two
sources that both have the term; Spark sums these before and after the shuffle.
What a term adds where one of the two sources lacks it depends only on the other
one's count, so it comes from the histogram of each source's counts; together the
sum runs over all kept terms, and the work follows the entries that are not zero.

A probability is ``1 + floor(10**9 * (count + 2) / (N + 2 V))`` and a divergence
``floor((p - q)**2 / (p + q))``, both in whole numbers (exact while a language has
fewer than 9 * 10**13 words).

Cases: a null text, language or source is ``''``; a text without terms only names
its group; a very long text is split in one task; a language without a kept term
has pairs of value 0; ties go by the item's bytes; repeated rows are separate
documents; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.plans.joins import broadcast_if_small
from pointloom.plans.scratch import written

#: ASCII letters and all bytes of other characters, so no character is cut.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
#: Entries that a task counts before it hands them on.
MOST_COUNTED = 300_000
SCALE = (10**4, 10**5)  # their product is the scale of a probability


@dataclass(frozen=True)
class DivergenceParams:
    least_docs: int = 10
    most_terms: int = 10


def term_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, several rows for one term."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", text_col)])
    names = ["lang", "source", "term", "n", "docs"]

    def emit(found: dict[tuple[str, str], tuple[Counter, Counter]]):
        for (lang, source), (times, holders) in found.items():
            terms = pa.array(list(times), pa.binary()).cast(pa.string())
            size = len(times)
            columns = [
                pa.array([lang] * size, pa.string()),
                pa.array([source] * size, pa.string()),
                terms,
                pa.array(list(times.values()), pa.int64()),
                pa.array([holders[t] for t in times], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    def count(batches):
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            groups = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for key, text in zip(groups, batch.column(2), strict=True):
                terms = TERM.findall(text.as_buffer().to_pybytes().lower())  # of bytes: A-Z only
                times, holders = found.setdefault(key, (Counter(), Counter()))
                times.update(terms)
                holders.update(set(terms))
            if sum(len(times) for times, _ in found.values()) > MOST_COUNTED:
                yield from emit(found)
                found = {}
        yield from emit(found)

    return rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def _div(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


def probability(count: Column, whole: Column) -> Column:
    """1 + floor(10**9 * (count + 2) / whole), by long division in two steps."""
    first = (count + 2) * F.lit(SCALE[0]).cast("long")
    return 1 + _div(first, whole) * SCALE[1] + _div((first % whole) * SCALE[1], whole)


def divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def wide_vectors(docs: DataFrame, groups: DataFrame, params: DivergenceParams) -> DataFrame:
    """(lang, term, total, counts): the kept terms, each with (i, n) of the sources that have it, by index."""
    partial = term_counts(docs).join(broadcast_if_small(groups), ["lang", "source"])
    # hashed by language and term once, which serves both steps
    summed = (
        partial.repartition("lang", "term")
        .groupBy("lang", "term", "i")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    return (
        summed.groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("i", "n"))).alias("counts"))
        .where(F.col("docs") >= params.least_docs)
        .drop("docs")
    )


def audit(docs: DataFrame, params: DivergenceParams = DivergenceParams()) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source, and the terms a source has more of than its language."""
    named = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    order = Window.partitionBy("lang").orderBy("source")
    groups = written(named.withColumn("i", F.row_number().over(order) - 1), "groups")
    vectors = written(wide_vectors(docs, groups, params), "vectors")

    entries = vectors.select("lang", F.explode("counts").alias("e")).select("lang", "e.i", "e.n")
    sums = entries.groupBy("lang", "i").agg(F.sum("n").alias("_sum"))
    kept = vectors.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("_all"))
    sized = groups.join(sums, ["lang", "i"], "left").join(kept, "lang", "left")
    v = F.coalesce("v", F.lit(0))
    whole = F.coalesce("_sum", F.lit(0)) + 2 * v
    # without a kept term there is nothing to divide; the sums below are 0 then
    sized = sized.select("lang", "source", "i", v.alias("v"), F.when(v > 0, whole).alias("whole"), (F.col("_all") + 2 * v).alias("lang_whole"))
    sized = written(sized.withColumn("zero", probability(F.lit(0).cast("long"), F.col("whole"))), "sized")
    wide = sized.groupBy("lang").agg(
        F.array_sort(F.collect_list(F.struct("i", "whole", "zero"))).alias("_s"), F.first("lang_whole").alias("lang_whole")
    )
    # one row for each language, as long as its sources are many
    shared = vectors.join(broadcast_if_small(wide), "lang")

    def entry(e: Column) -> Column:
        of = F.get(F.col("_s"), e["i"])
        return F.struct(e["i"].alias("i"), probability(e["n"], of["whole"]).alias("p"), of["zero"].alias("z"))

    pointed = shared.select("lang", "term", "total", "lang_whole", F.transform("counts", entry).alias("ps"))
    both = _met(pointed)
    one = _alone(pointed, sized)
    return _pairs(sized, both, one).unionByName(_terms(pointed, sized, params.most_terms))


def _met(pointed: DataFrame) -> DataFrame:
    """(lang, a, b, met), a < b: over the terms that both have, what they add beyond the terms' lone parts."""

    def partners(e: Column, k: Column) -> Column:
        later = F.slice(F.col("ps"), k + 2, F.size("ps"))
        return F.transform(later, lambda o: F.struct(e["i"].alias("a"), e["p"].alias("p"), e["z"].alias("y"), o["i"].alias("b"), o["p"].alias("q"), o["z"].alias("z")))

    pairs = pointed.select("lang", F.explode(F.flatten(F.transform("ps", partners))).alias("x")).select("lang", "x.*")
    p, q, y, z = map(F.col, "pqyz")
    more = divergence(p, q) - divergence(p, z) - divergence(y, q) + divergence(y, z)
    return pairs.groupBy("lang", "a", "b").agg(F.sum(more).alias("met"))


def _alone(pointed: DataFrame, sized: DataFrame) -> DataFrame:
    """(lang, a, b, lone): over the terms that a has, as if b had none of them, beyond two zeros."""
    entries = pointed.select("lang", F.explode("ps").alias("e")).select("lang", F.col("e.i").alias("a"), "e.p", F.col("e.z").alias("y"))
    histogram = entries.groupBy("lang", "a", "y", "p").agg(F.count("*").alias("terms"))
    other = sized.where("v > 0").select("lang", F.col("i").alias("b"), F.col("zero").alias("z"))
    met = histogram.join(broadcast_if_small(other), "lang").where("a <> b")
    more = F.col("terms") * (divergence(F.col("p"), F.col("z")) - divergence(F.col("y"), F.col("z")))
    return met.groupBy("lang", "a", "b").agg(F.sum(more).alias("lone"))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value").withColumn("rank", F.row_number().over(by))


def _pairs(sized: DataFrame, both: DataFrame, one: DataFrame) -> DataFrame:
    a = sized.select("lang", "source", F.col("i").alias("a"), "v", F.col("zero").alias("y"))
    b = sized.select("lang", F.col("source").alias("item"), F.col("i").alias("b"), F.col("zero").alias("z"))
    pairs = a.join(b, "lang").where("a <> b").withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b"))
    met = both.select("lang", F.col("a").alias("lo"), F.col("b").alias("hi"), "met")
    there = one.select("lang", "a", "b", "lone")
    back = one.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("lone").alias("back"))
    joined = pairs.join(met, ["lang", "lo", "hi"], "left").join(there, ["lang", "a", "b"], "left").join(back, ["lang", "a", "b"], "left")
    base = F.when(F.col("v") > 0, F.col("v") * divergence(F.col("y"), F.col("z"))).otherwise(0)
    parts = [F.coalesce(c, F.lit(0)) for c in ("met", "lone", "back")]
    return _ranked(joined.withColumn("value", (base + parts[0] + parts[1] + parts[2]).cast("long")), "pair")


def _terms(pointed: DataFrame, sized: DataFrame, most: int) -> DataFrame:
    q = probability(F.col("total"), F.col("lang_whole"))
    rows = pointed.select("lang", F.col("term").alias("item"), q.alias("q"), F.explode("ps").alias("e")).select("lang", "item", "q", "e.i", "e.p")
    over = rows.where("p > q").withColumn("value", divergence(F.col("p"), F.col("q")))
    named = over.join(broadcast_if_small(sized.select("lang", "i", "source")), ["lang", "i"])
    return _ranked(named, "term").where(F.col("rank") <= most)
