"""A training corpus from raw documents: filter, deduplicate, mix and pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  Stages are written as Parquet in between, and
the tables that a stage wrote for itself are deleted when the next one begins.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import mixing, packing, quality, rules, shingles
from pointloom.plans.scratch import Leftovers, written
from pointloom.plans.session import arrow_batches

_LEFT = Leftovers()


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``work``, after which the tables of the stage before it are deleted unless ``docs`` still read them."""

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _LEFT.release(docs)
        with _LEFT:
            return work(spark, docs, sf_dir)

    return run_stage


def _carried(docs: DataFrame) -> DataFrame:
    """Each document whole as ``_row``, beside the columns that a stage reads.

    Whatever other columns there are, their names cannot clash with a stage's own.
    """
    return docs.select(F.struct("*").alias("_row"), "doc_id", "text", "source", "lang")


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality reaches the threshold.

    A null text is empty evidence; rows are carried whole beside their evidence, so
    each text is searched once.  An empty table gives an empty result.
    """
    params = quality.QualityParams()
    arrow_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    evident = quality.with_evidence(_carried(docs), quality.fit(docs, labels, params))
    scored = written(evident.drop("text", "source", "lang"), "scored")
    rates, overall = quality.site_rates(scored.select("_host", "_path", "_p"), params)
    return quality.judge(scored, written(rates, "rates"), overall, params).where("_kept").select("_row.*")


@_stage
def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and resemble their language.

    A null text has no words and goes; a null language is the language ``""``.
    """
    params = rules.RuleParams()
    words = written(rules.common_words(docs, params), "words")
    measured = written(
        rules.measure(_carried(docs), words, params).select("_row", *rules.MEASURES), "measures"
    )
    refs = written(rules.references(measured, params), "references")
    return rules.judge(measured, refs, params).where("_r_kept").select("_row.*")


@_stage
def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group linked by 0.8 of their five-word shingles.

    SimHash and its trie walk give the first links, MinHash bands those it misses; each is held against the exact similarity.
    Texts without a word (nulls among them) are one group; of repeated rows one stays.
    """
    arrow_batches(spark)
    return shingles.one_of_each(docs)


@_stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of documents whose tokens have the target marginals.

    A null source or language is a category of its own; a null text has no tokens.
    """
    return mixing.mix(_carried(docs), mixing.MixParams()).where("_m_kept").select("_row.*")


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens; a null text is its end token alone."""
    return packing.pack(docs, packing.PackingParams(packing.public_path()))


STAGES = [
    ("quality_classifier", quality_stage),
    ("quality_rules", rules_stage),
    ("simhash_near_dedup", dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: XXH64, the tokenizer and the fitted models have no SQL form; the tests hold
#: the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        result = stage(spark, docs, sf_dir)
        with _LEFT:
            docs = written(result, name)
    return STAGES[-1][1](spark, docs, sf_dir)
