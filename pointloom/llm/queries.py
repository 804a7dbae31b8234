"""Queries of the corpus operators over the driver tables, with DuckDB SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import (
    alignment,
    chat,
    divergence,
    langid,
    licenses,
    mixing,
    oracles,
    packing,
    quality,
    rules,
    sharding,
    simhash,
    sketch,
    substrings,
)
from pointloom.plans.scratch import written
from pointloom.plans.session import arrow_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    arrow_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mixing.mix(docs, mixing.MixParams()).select(
        "doc_id",
        F.col("_m_source").alias("source"),
        F.col("_m_lang").alias("lang"),
        F.col("_m_topic").alias("topic"),
        F.col("_m_tokens").alias("tokens"),
        F.round("_m_factor", 9).alias("factor"),
        F.round("_m_probability", 9).alias("probability"),
        F.col("_m_kept").alias("kept"),
        F.col("_m_fit_error").alias("fit_error"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = packing.PackingParams(packing.public_path())
    return packing.pack(_table(spark, sf_dir, "documents"), params)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = quality.QualityParams()
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), params)
    scored = written(quality.with_evidence(docs, model).drop("text"), "evidence")
    rates, overall = quality.site_rates(scored, params)
    return quality.judge(scored, written(rates, "rates"), overall, params).select(
        "doc_id",
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.round("_p", 6).alias("own_probability"),
        F.round("_path_rate", 6).alias("path_rate"),
        F.round("_posterior", 6).alias("posterior"),
        F.col("_kept").alias("kept"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = rules.RuleParams()
    docs = _table(spark, sf_dir, "documents")
    words = written(rules.common_words(docs, params), "words")
    measured = written(rules.measure(docs, words, params).select("doc_id", *rules.MEASURES), "measures")
    refs = written(rules.references(measured, params), "references")
    return rules.verdicts(rules.judge(measured, refs, params))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("detections")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(oracles.SAID).alias("text"),
    )
    return chat.digest(chat.format_conversations(turns.unionByName(extra)))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return sharding.shard(docs, sharding.ShardParams()).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.compare_neighbours(_table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = langid.LangIdParams()
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs.where(~langid.held_out()), params), params)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op12_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.remove_repeats(_table(spark, sf_dir, "documents")))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [packing.public_path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.align(_table(spark, sf_dir, "documents"), alignment.AlignParams(*paths))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_packing": op2_packing,
    "op3_quality": op3_quality,
    "op4_quality_rules": op4_quality_rules,
    "op5_licenses": op5_licenses,
    "op6_sharding": op6_sharding,
    "op7_simhash": op7_simhash,
    "op8_sketch": op8_sketch,
    "op9_chat": op9_chat,
    "op10_langid": op10_langid,
    "op11_source_divergence": op11_source_divergence,
    "op12_suffix_array": op12_suffix_array,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES: dict[str, str] = {"op4_quality_rules": oracles.op4(), "op9_chat": oracles.OP9, "op11_source_divergence": oracles.OP11, "op12_suffix_array": oracles.OP12}
