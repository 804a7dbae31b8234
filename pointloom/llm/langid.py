"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else is a space; runs of one to three
characters with a letter in them are hashed into ``bins``.  Counts by language
come from all labelled documents, summed by Spark; the matrix of
log-probabilities (languages x bins, a bounded number of languages) is broadcast,
and batches are scored in numpy: one gather and one segmented sum a language.

Cases: a null text or one without a letter is ``und`` with score 0; without any
labelled document every text is ``und``; a null id is held out; a very long text is
read in pieces that overlap, so memory is bounded; ties go to the first language
in order of name; repeated rows are counted and scored each; columns other than
id, text and language are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that are scored at a time.
CHUNK = 1 << 19


@dataclass(frozen=True)
class LangIdParams:
    bins: int = 1 << 13
    longest: int = 3
    smoothing: float = 0.5
    #: The matrix has a row for each language; more languages than this are an error.
    most_languages: int = 1000
    #: Evidence is scaled down to that of so many n-grams for the score.
    score_grams: int = 30


@lru_cache(1)
def letters() -> np.ndarray:
    """Lower-case code of each letter's code point, 0 for all else."""
    table = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def grams(texts: list[str], params: LangIdParams, lead: str = "  "):
    """(hashes, starts of texts): n-grams of all texts; ``bins`` stands for none.

    A gram belongs to the text that its last character lies in.  ``lead`` is put
    before each text, so that grams keep within it; grams that end in it are none.
    """
    joined = "".join(lead + t for t in texts)
    codes = letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
    codes = codes.astype(np.uint64)
    starts = np.cumsum([0] + [len(t) + len(lead) for t in texts[:-1]])
    leads = (starts[:, None] + np.arange(len(lead))).reshape(-1)
    found = []
    for n in range(1, params.longest + 1):
        value = np.full(len(codes), n, np.uint64)
        any_letter = np.zeros(len(codes), np.uint64)
        for back in range(n):
            shifted = codes if back == 0 else np.concatenate([np.zeros(back, np.uint64), codes[:-back]])
            value = value * np.uint64(0x100000001B3) + shifted
            any_letter |= shifted
        value = (value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        value = value % np.uint64(params.bins)
        any_letter[leads] = 0
        found.append(np.where(any_letter > 0, value, np.uint64(params.bins)).astype(np.int32))
    return found, starts


def pieces(texts: list[str], params: LangIdParams):
    """(numbers of the texts, hashes, starts) of CHUNK characters or so at a time.

    A text longer than that comes in several pieces, each led by the characters before it.
    """
    before = params.longest - 1
    numbers, held, size = [], [], 0
    for k, text in enumerate(texts):
        if len(text) <= CHUNK:
            numbers.append(k)
            held.append(text)
            size += len(text)
            if size >= CHUNK:
                yield numbers, *grams(held, params, " " * before)
                numbers, held, size = [], [], 0
            continue
        for at in range(0, len(text), CHUNK):
            lead = text[max(0, at - before) : at] if at else " " * before
            yield [k], *grams([text[at : at + CHUNK]], params, lead)
    if numbers:
        yield numbers, *grams(held, params, " " * before)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


@dataclass(frozen=True)
class LangIdModel:
    languages: list[str]
    log_probs: np.ndarray  # languages x (bins + 1); the last column is 0


def learn(
    labelled: DataFrame, params: LangIdParams, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang",
) -> LangIdModel:
    """Fit on all ``labelled`` rows that have a text and a language."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = rows.select(lang_col).distinct().limit(params.most_languages + 1).count()
    if known > params.most_languages:
        raise ValueError(f"more than {params.most_languages} languages: raise most_languages, a row of the matrix each")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            for lang in set(langs):
                own = [t for t, l in zip(texts, langs, strict=True) if l == lang]
                into = sums.setdefault(lang, np.zeros(params.bins + 1, np.int64))
                for _, found, _ in pieces(own, params):
                    for hashed in found:
                        into += np.bincount(hashed, minlength=params.bins + 1)
        for lang, into in sums.items():
            bins = np.flatnonzero(into[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(bins), pa.string()), pa.array(bins, pa.int32()), pa.array(into[bins])],
                ["lang", "bin", "n"],
            )

    # at most most_languages * bins rows
    counts = (
        rows.select(F.col(lang_col), F.col(text_col))
        .mapInArrow(count, "lang string, bin int, n long")
        .groupBy("lang", "bin")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    languages = sorted(counts["lang"].unique())
    table = np.full((len(languages), params.bins + 1), params.smoothing)
    place = {lang: k for k, lang in enumerate(languages)}
    table[counts["lang"].map(place).to_numpy(int), counts["bin"].to_numpy(int)] += counts["n"].to_numpy()
    logs = np.log(table / table[:, :-1].sum(axis=1, keepdims=True)) if languages else table
    logs[:, -1] = 0
    return LangIdModel(languages, logs.astype(np.float32))


def score(texts: list[str], model: LangIdModel, params: LangIdParams):
    """(language or und, score) of each text."""
    evidence = np.zeros((len(model.languages), len(texts)))
    used = np.zeros(len(texts))
    for numbers, found, starts in pieces(texts, params):
        for hashed in found:
            used[numbers] += np.add.reduceat((hashed < params.bins).astype(np.int64), starts)
            for k, row in enumerate(model.log_probs):
                evidence[k, numbers] += np.add.reduceat(row[hashed].astype(np.float64), starts)
    if not len(texts):
        return [], []
    scaled = evidence * np.minimum(1, params.score_grams / np.maximum(used, 1))
    odds = np.exp(scaled - scaled.max(axis=0))
    odds /= odds.sum(axis=0)
    best = evidence.argmax(axis=0)
    langs = [model.languages[k] if n else "und" for k, n in zip(best.tolist(), used, strict=True)]
    return langs, np.where(used > 0, odds[best, np.arange(len(texts))], 0.0).tolist()


def identify(
    docs: DataFrame, model: LangIdModel, params: LangIdParams, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row."""
    fields = [
        docs.schema[id_col],
        T.StructField("held_out", T.BooleanType()),
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        known = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            if known.languages:
                langs, scores = score(texts, known, params)
            else:
                langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                [f.name for f in fields],
            )

    rows = docs.select(id_col, held_out(id_col).alias("held_out"), text_col)
    return rows.mapInArrow(predict, T.StructType(fields))


def accuracy(predicted: pd.DataFrame, truth: pd.DataFrame, id_col: str = "doc_id") -> float:
    """Share of held-out documents whose language is found."""
    both = predicted[predicted["held_out"]].merge(truth.dropna(subset=["lang"]), on=id_col)
    return float((both["lang_pred"] == both["lang"]).mean())
