"""Quality by hierarchical empirical Bayes: a document's own evidence and its site's record.

A document classifier gives each document a probability: naive Bayes over hashed
runs of three characters, learnt from labelled documents, and features of the
text's shape go into a logistic regression.  For its fit the n-gram evidence of a
labelled document comes from the other half of the labelled documents, so the
regression sees it as it will be for new ones.  Hosts and paths within hosts have
rates of good documents; a host's rate is shrunk toward the global one and a
path's toward its host's, the more the fewer documents there are.  The strength of
each prior is estimated from the data by the method of moments.  A document's
posterior log-odds are its own, moved by how far its path's rate, without the
document itself, differs from the global one.

Rates are grouped sums, so a hot host costs no more than any other; path rates
come back to the documents by a broadcast if they are few, else by a join that
keeps the rows of heavy paths apart.

Cases: a null text is empty; a null host or path is a site of its own; documents
without labels are only scored; of repeated ids among the labelled one text
counts; without labels of both kinds the classifier says 0.5 for all; a very long
text is hashed in pieces; repeated rows are scored alike; columns with names of
the operator's own (``_p``, ``_host``, ...) are replaced; an empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.plans.joins import broadcast_if_small, join_sized
from pointloom.plans.scratch import drop, written


@dataclass(frozen=True)
class QualityParams:
    #: Labelled documents the classifier is fitted on, half of them good ones; more are thinned by a hash of the id.
    most_labelled: int = 20_000
    ridge: float = 0.1
    #: How much of the site's log-odds a document takes over.
    site_weight: float = 0.5
    least_probability: float = 0.4
    #: Bounds of the estimated prior strengths, in documents.
    least_prior: float = 1.0
    most_prior: float = 1e6


#: Character classes, each removed from what the ones before it left.
SHAPES = [
    ("lower", r"[a-z]+"),
    ("space", r"[\x20\x09-\x0D]+"),
    ("upper", r"[A-Z]+"),
    ("stops", r"[.,;:?]+"),
    ("digits", r"[0-9]+"),
    ("bars", r"\|+"),
    ("shouts", r"!+"),
    ("symbols", r"[\x00-\x7F]+"),
]
NAMES = ["upper", "stops", "digits", "bars", "shouts", "symbols", "distinct", "long_words", "short", "grams"]
#: N-grams: their length in characters, the number of hashes, and the counts added to each.
GRAM, BINS, SMOOTHING = 3, 1 << 14, 1.0
#: Characters that are hashed at a time.
CHUNK = 1 << 19


def gram_hashes(text: str):
    """Hashes, below ``BINS``, of all runs of ``GRAM`` characters, a piece of the text at a time."""
    for at in range(0, max(1, len(text) - GRAM + 1), CHUNK):
        part = text[at : at + CHUNK + GRAM - 1]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        if len(codes) < GRAM:
            return
        count = len(codes) - GRAM + 1
        value = np.zeros(count, np.uint64)
        for k in range(GRAM):
            value = value * np.uint64(0x100000001B3) + codes[k : k + count]
        yield ((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % BINS


def gram_evidence(texts: pd.Series, weights: np.ndarray) -> pd.Series:
    """Mean weight of each text's n-grams, 0 without any."""
    out = np.zeros(len(texts))
    for k, text in enumerate(texts):
        total, count = 0.0, 0
        for hashed in gram_hashes(text or ""):
            total += float(weights[hashed].sum(dtype=np.float64))
            count += len(hashed)
        out[k] = total / max(count, 1)
    return pd.Series(out)


def with_features(docs: DataFrame, text_col: str, weights: np.ndarray) -> DataFrame:
    """``docs`` with features of the whole text in columns ``_f_*``; ``weights`` are those of the n-grams."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # BINS numbers

    @F.pandas_udf("double")
    def grams(texts: pd.Series) -> pd.Series:
        return gram_evidence(texts, shared.value)

    out = docs.withColumn("_s_0", F.coalesce(F.col(text_col), F.lit("")))
    out = out.withColumn("_f_grams", grams("_s_0"))
    for k, (_, pattern) in enumerate(SHAPES):
        out = out.withColumn(f"_s_{k + 1}", F.regexp_replace(f"_s_{k}", pattern, ""))
    out = out.withColumn("_s_words", F.array_remove(F.split("_s_0", r"[\x20\x09-\x0D]+"), ""))
    chars = F.greatest(F.length("_s_0"), F.lit(1))
    n_words = F.greatest(F.size("_s_words"), F.lit(1))
    found = {
        f"_f_{name}": (F.length(f"_s_{k}") - F.length(f"_s_{k + 1}")) / chars
        for k, (name, _) in enumerate(SHAPES)
        if name in NAMES
    }
    found["_f_distinct"] = F.size(F.array_distinct("_s_words")) / n_words
    letters = F.length("_s_0") - (F.length("_s_1") - F.length("_s_2"))
    found["_f_long_words"] = F.least(F.lit(1.0), letters / n_words / 20)
    found["_f_short"] = 1 / F.log2(F.lit(2) + n_words)
    drop = ["_s_words", *[f"_s_{k}" for k in range(len(SHAPES) + 1)]]
    return out.withColumns(found).drop(*drop)


@dataclass(frozen=True)
class QualityModel:
    weights: list[float]
    intercept: float
    grams: np.ndarray = field(default_factory=lambda: np.zeros(BINS, np.float32))


def gram_weights(counts: np.ndarray) -> np.ndarray:
    """Log-odds of each hash from its counts (bad, good)."""
    shares = np.log(counts + SMOOTHING) - np.log((counts + SMOOTHING).sum(axis=1, keepdims=True))
    return (shares[1] - shares[0]).astype(np.float32)


def gram_counts(rows: DataFrame) -> np.ndarray:
    """Counts of each half, label and hash over (_half, _y, text) rows."""

    def count(batches):
        sums = np.zeros((2, 2, BINS), np.int64)
        for batch in batches:
            for half, y, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for hashed in gram_hashes(text or ""):
                    sums[half, y] += np.bincount(hashed, minlength=BINS)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.reshape(-1)[at])], ["at", "n"])

    found = rows.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(4 * BINS)
    out[found["at"].to_numpy(int)] = found["n"].to_numpy()
    return out.reshape(2, 2, BINS)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float, grams: np.ndarray | None = None) -> QualityModel:
    """Ridge logistic regression by Newton steps on standardised features.

    The intercept is not penalised; the weights returned are those of the raw features.
    """
    more = {} if grams is None else {"grams": grams}
    if not len(y) or y.min() == y.max():
        return QualityModel([0.0] * x.shape[1], 0.0, **more)
    center, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    full = np.hstack([(x - center) / scale, np.ones((len(x), 1))])
    penalty = np.diag([ridge] * x.shape[1] + [1e-9])
    beta = np.zeros(full.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(full @ beta, -30, 30)))
        gradient = full.T @ (y - p) - penalty @ beta
        hessian = (full * (p * (1 - p))[:, None]).T @ full + penalty
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    weights = beta[:-1] / scale
    return QualityModel(weights.tolist(), float(beta[-1] - weights @ center), **more)


def labelled(docs: DataFrame, labels: DataFrame, params: QualityParams, id_col: str, text_col: str) -> DataFrame:
    """(_y, _half, text) of about ``most_labelled`` documents at most, one for each id."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull())
    known = known.groupBy(id_col).agg(F.max("quality").cast("int").alias("_y"))
    n = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    few = min(n.values(), default=0)
    share = F.lit(1.0)
    for y, count in n.items():  # half for each label; what one does not need the other gets
        most = max(params.most_labelled / 2, params.most_labelled - few)
        share = F.when(F.col("_y") == y, min(1.0, most / count)).otherwise(share)
    draw = F.pmod(F.xxhash64(id_col), F.lit(1 << 20))
    kept = known.where(draw < share * (1 << 20)).withColumn("_half", F.pmod(F.xxhash64(id_col, F.lit("half")), F.lit(2)).cast("int"))
    # about ``most_labelled`` rows
    joined = docs.select(id_col, F.col(text_col).alias("_text")).join(broadcast_if_small(kept, 2 * params.most_labelled), id_col)
    return joined.groupBy(id_col).agg(F.max("_y").alias("_y"), F.max("_half").alias("_half"), F.max("_text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, params: QualityParams, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Fit on documents with a label ``quality`` (0 or 1): about ``most_labelled`` at most."""
    rows = written(labelled(docs, labels, params, id_col, text_col).select("_half", "_y", "text"), "labelled")
    counts = gram_counts(rows)
    columns = [f"_f_{n}" for n in NAMES]
    halves = [
        with_features(rows.where(F.col("_half") == half), "text", gram_weights(counts[1 - half]))
        .select(*[F.col(c).cast("double") for c in columns], F.col("_y").cast("double"))
        for half in (0, 1)
    ]
    table = halves[0].union(halves[1]).toPandas()
    drop(rows)
    grams = gram_weights(counts.sum(axis=0))
    return fit_logistic(table[columns].to_numpy(), table["_y"].to_numpy(), params.ridge, grams)


def probability(model: QualityModel) -> Column:
    """The classifier's probability from the columns ``_f_*``."""
    odds = F.lit(model.intercept)
    for weight, name in zip(model.weights, NAMES, strict=True):
        odds = odds + F.col(f"_f_{name}") * weight
    odds = F.greatest(F.lit(-12.0), F.least(F.lit(12.0), odds))
    return 1 / (1 + F.exp(-odds))


def with_evidence(
    docs: DataFrame, model: QualityModel, text_col: str = "text", host: Column | None = None,
    path: Column | None = None,
) -> DataFrame:
    """``docs`` with _host, _path and _p, the document's own probability."""
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    sites = {
        "_host": F.coalesce(host.cast("string"), F.lit("")),
        "_path": F.coalesce(path.cast("string"), F.lit("")),
        "_p": probability(model),
    }
    return with_features(docs, text_col, model.grams).withColumns(sites).drop(*[f"_f_{n}" for n in NAMES])


def logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def prior_strength(rates: DataFrame, center: Column, params: QualityParams) -> float:
    """Documents that the prior is worth: within-group variance over between-group variance.

    ``rates`` has _n and _s (documents and summed probabilities of each group) and
    whatever ``center`` reads.
    """
    mean = F.col("_s") / F.col("_n")
    row = rates.where("_n > 1").agg(
        F.sum("_n").alias("n"),
        F.count("*").alias("k"),
        F.sum(F.col("_n") * F.pow(mean - center, F.lit(2))).alias("between"),
        F.sum(F.col("_n") * center * (1 - center)).alias("within"),
    ).first()
    if not row["k"] or not row["n"]:
        return params.most_prior
    variance = row["within"] / row["n"]
    per_group = row["n"] / row["k"]
    spread = (row["between"] / row["k"] - variance) / per_group
    return float(min(params.most_prior, max(params.least_prior, variance / spread if spread > 0 else params.most_prior)))


def site_rates(scored: DataFrame, params: QualityParams) -> tuple[DataFrame, float]:
    """(host, path) rows with _n, _s and the host's shrunk rate; the global rate.

    ``scored`` has _host, _path and _p.
    """
    paths = scored.groupBy("_host", "_path").agg(F.count("*").alias("_n"), F.sum("_p").alias("_s"))
    hosts = paths.groupBy("_host").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    total = hosts.agg(F.sum("_n").alias("n"), F.sum("_s").alias("s")).first()
    overall = (total["s"] / total["n"]) if total["n"] else 0.5
    strength = prior_strength(hosts, F.lit(overall), params)
    shrunk = hosts.select("_host", ((F.col("_s") + strength * overall) / (F.col("_n") + strength)).alias("_host_rate"))
    joined = paths.join(shrunk, "_host")
    within = prior_strength(joined, F.col("_host_rate"), params)
    return joined.withColumn("_strength", F.lit(within)), overall


def judge(scored: DataFrame, rates: DataFrame, overall: float, params: QualityParams) -> DataFrame:
    """``scored`` with _path_rate (of the path's other documents), _posterior and _kept; ``rates`` is a written table."""
    keyed = rates.select(F.struct("_host", "_path").alias("_site"), "_n", "_s", "_host_rate", "_strength")
    joined = join_sized(scored.withColumn("_site", F.struct("_host", "_path")), keyed, "_site", "_n").drop("_site")
    others = F.greatest(F.lit(0.0), F.col("_s") - F.col("_p"))
    rate = (others + F.col("_strength") * F.col("_host_rate")) / (
        F.greatest(F.col("_n") - 1, F.lit(0)) + F.col("_strength")
    )
    odds = logit(F.col("_p")) + params.site_weight * (logit(rate) - logit(F.lit(overall)))
    return (
        joined.withColumns({"_path_rate": rate, "_posterior": 1 / (1 + F.exp(-odds))})
        .withColumn("_kept", F.col("_posterior") >= params.least_probability)
        .drop("_n", "_s", "_host_rate", "_strength")
    )
