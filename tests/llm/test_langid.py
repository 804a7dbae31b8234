import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tests.llm import odd

from pointloom.llm import langid

PARAMS = langid.LangIdParams()


def test_held_out_documents_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(docs.where(~langid.held_out()), PARAMS)
    rows = langid.identify(docs, model, PARAMS)
    assert langid.accuracy(rows.toPandas(), docs.select("doc_id", "lang").toPandas()) > 0.95
    for r in rows.collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1


def plain_grams(text, params=PARAMS):
    """Hashed n-grams in plain integers: runs that end at each character."""
    codes = [0, 0]
    for c in text:
        low = c.lower()
        codes.append((ord(low) if len(low) == 1 else ord(c)) if c.isalpha() else 0)
    for end in range(2, len(codes)):
        for n in range(1, params.longest + 1):
            run = codes[end - n + 1 : end + 1]
            if any(run):
                x = n
                for code in reversed(run):
                    x = (x * 0x100000001B3 + code) % 2**64
                yield (x * 0x9E3779B97F4A7C15 % 2**64 >> 40) % params.bins


def plain_model(rows, params=PARAMS):
    counts = defaultdict(Counter)
    for lang, text in rows:
        counts[lang].update(plain_grams(text, params))
    return {
        lang: (c, math.log(sum(c.values()) + params.smoothing * params.bins)) for lang, c in counts.items()
    }


def plain_scores(text, model, params=PARAMS):
    grams = list(plain_grams(text, params))
    sums = {
        lang: sum(math.log(c[g] + params.smoothing) - total for g in grams) for lang, (c, total) in model.items()
    }
    scale = min(1, params.score_grams / max(len(grams), 1))
    top = max(sums.values())
    odds = {lang: math.exp((v - top) * scale) for lang, v in sums.items()}
    best = min(lang for lang, v in sums.items() if v == top)
    return (best, odds[best] / sum(odds.values())) if grams else ("und", 0.0)


def test_model_and_scores_equal_brute_force(spark):
    """Naive Bayes with counters over the whole table, one text after the other."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 2500")
    rows = docs.collect()
    learned = docs.where(~langid.held_out())
    model = langid.learn(learned, PARAMS)
    plain = plain_model([(r["lang"], r["text"]) for r in learned.collect() if r["lang"] and r["text"]])
    assert model.languages == sorted(plain)
    got = {r["doc_id"]: r for r in langid.identify(docs, model, PARAMS).collect()}
    for r in rows:
        lang, sure = plain_scores(r["text"] or "", plain)
        assert got[r["doc_id"]]["lang_pred"] == lang
        assert got[r["doc_id"]]["score"] == pytest.approx(sure, abs=1e-4)


def test_long_texts_in_pieces_have_the_grams_of_the_whole(monkeypatch):
    text = "Ein längerer Text, 12 Wörter lang; mit É und ß. " * 9
    wanted = Counter(plain_grams(text))
    for size in (1, 2, 7, 50, 10_000):
        monkeypatch.setattr(langid, "CHUNK", size)
        got = Counter()
        for numbers, found, _ in langid.pieces(["kurz", text, "x"], PARAMS):
            if 1 in numbers:
                texts = [["kurz", text, "x"][k] for k in numbers]
                got.update(h for hashed in found for h in hashed.tolist() if h < PARAMS.bins)
                for other in texts:
                    if other != text:
                        got.subtract(plain_grams(other))
        assert +got == wanted


def test_too_many_languages_are_an_error(spark):
    docs = spark.createDataFrame([(k, "text", f"l{k}") for k in range(5)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.learn(docs, langid.LangIdParams(most_languages=4))


def test_odd_documents(spark):
    docs = odd.table(spark)
    model = langid.learn(docs, PARAMS)
    rows = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(docs, model, PARAMS).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= rows
    assert all(p in {"und", "en", "de", "fr", "es", "xx"} for _, p in rows)


def test_nothing_to_learn_from(spark):
    docs = odd.table(spark).withColumn("lang", F.lit(None).cast("string"))
    rows = langid.identify(docs, langid.learn(docs, PARAMS), PARAMS).collect()
    assert {r["lang_pred"] for r in rows} == {"und"}
    assert langid.identify(odd.empty(spark), langid.learn(odd.empty(spark), PARAMS), PARAMS).count() == 0


def test_language_source_and_id_do_not_matter(spark):
    docs = odd.table(spark).where("doc_id < 9")
    model = langid.learn(docs, PARAMS)
    moved = docs.withColumns({"lang": F.lit("qq"), "source": F.lit(None).cast("string"), "doc_id": F.col("doc_id") + 1000})
    a = sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(docs, model, PARAMS).collect())
    b = sorted((r["doc_id"] - 1000, r["lang_pred"], r["score"]) for r in langid.identify(moved, model, PARAMS).collect())
    assert a == b
