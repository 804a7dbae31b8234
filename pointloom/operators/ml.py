"""Feature table, gate, training and withheld metrics."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators.folds import stratified_folds
from pointloom.operators.research import label_gate


def with_missing_flags(df: DataFrame, features: list[str]) -> DataFrame:
    """An indicator beside each feature, so that a filled value stays told from a known one."""
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("double") for c in features})


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """``df`` with weight n / (classes * n of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    totals = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    weighted = counts.crossJoin(F.broadcast(totals)).select(label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return df.join(F.broadcast(weighted), label)  # one row for each class


def split(df: DataFrame, label: str, group: str, folds: int = 5, held: int = 0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test) by stratified folds of whole groups."""
    folded = df.join(stratified_folds(df, label, group, folds, seed), group)
    return folded.where(F.col("fold") != held).drop("fold"), folded.where(F.col("fold") == held).drop("fold")


def train(df: DataFrame, features: list[str], label: str, group: str, kind: str = "logistic", trees: int = 300, seed: int = 7, least: int = 30, least_groups: int = 8) -> PipelineModel | None:
    """A fitted pipeline, or None while the label gate is closed."""
    gate = label_gate(df, label, group, least, least_groups).agg(F.max("gate_open")).first()[0]
    if not gate:
        return None
    flagged = balanced_weights(with_missing_flags(df, features), label)
    filled = [f"{c}_filled" for c in features]
    stages = [
        StringIndexer(inputCol=label, outputCol="label_index"),
        Imputer(strategy="median", inputCols=features, outputCols=filled),
        VectorAssembler(inputCols=[*filled, *[f"{c}_missing" for c in features]], outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True),
    ]
    common = {"labelCol": "label_index", "featuresCol": "features", "weightCol": "weight"}
    model = LogisticRegression(**common) if kind == "logistic" else RandomForestClassifier(numTrees=trees, seed=seed, **common)
    return Pipeline(stages=[*stages, model]).fit(flagged)


def confusion(predicted: DataFrame, truth: str = "label_index", guess: str = "prediction") -> DataFrame:
    return predicted.groupBy(truth, guess).agg(F.count("*").alias("n"))


def reported(predicted: DataFrame, least_per_class: int = 10) -> dict:
    """Accuracy, and recall of each class with enough rows; the rest is withheld."""
    table = confusion(predicted).collect()
    total = sum(r["n"] for r in table)
    right = sum(r["n"] for r in table if r["label_index"] == r["prediction"])
    by: dict[float, list[int]] = {}
    for r in table:
        own = by.setdefault(r["label_index"], [0, 0])
        own[0] += r["n"]
        own[1] += r["n"] * (r["label_index"] == r["prediction"])
    recall = {k: (hit / n if n >= least_per_class else None) for k, (n, hit) in sorted(by.items())}
    return {"n": total, "accuracy": right / total if total else None, "recall": recall}


def predict(df: DataFrame, features: list[str], model: PipelineModel | None, fallback: DataFrame, key: str) -> DataFrame:
    """(key, label, basis): the model's answer, or the heuristic one while there is no model."""
    if model is None:
        return df.select(key).join(fallback.select(key, F.col("top").alias("label")), key, "left").select(
            key, F.coalesce("label", F.lit("UNKNOWN")).alias("label"), F.lit("HEURISTIC").alias("basis")
        )
    out = model.transform(with_missing_flags(df, features))
    return out.select(key, F.col("prediction").cast("string").alias("label"), F.lit("MODEL").alias("basis"))
