import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from tests.llm import odd

from pointloom.llm import quality

PARAMS = quality.QualityParams()


def judged(docs, labels):
    model = quality.fit(docs, labels, PARAMS)
    scored = quality.with_evidence(docs, model)
    rates, overall = quality.site_rates(scored, PARAMS)
    return quality.judge(scored, rates, overall, PARAMS)


def test_labelled_documents_are_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    n = Counter()
    for half in (0, 1):  # the other half is held out
        out = judged(docs, labels.where(f"doc_id % 2 = {half}")).join(labels.where(f"doc_id % 2 <> {half}"), "doc_id")
        n.update({(r["quality"], r["_kept"]): r["count"] for r in out.groupBy("quality", "_kept").count().collect()})
    assert n[1, False] <= 0.02 * n[1, True]
    assert n[0, True] <= 0.05 * n[0, False]


def test_sites_are_shrunk_as_the_formula_says(spark):
    rows = [("h1", "p", 0.9)] * 50 + [("h1", "q", 0.2)] + [("h2", "p", 0.3)] * 40 + [("h3", "p", 0.99)]
    scored = spark.createDataFrame(rows, "_host string, _path string, _p double")
    rates, overall = quality.site_rates(scored, PARAMS)
    assert overall == pytest.approx(np.mean([r[2] for r in rows]))
    out = quality.judge(scored, rates, overall, PARAMS).collect()
    strength = rates.first()["_strength"]
    table = {(r["_host"], r["_path"]): r for r in rates.collect()}
    for r in out:
        site = table[r["_host"], r["_path"]]
        rate = (site["_s"] - r["_p"] + strength * site["_host_rate"]) / (site["_n"] - 1 + strength)
        assert r["_path_rate"] == pytest.approx(rate)
    # one document says little about its host: its rate stays between its own and the global one
    assert overall < table["h3", "p"]["_host_rate"] < 0.99


def test_odd_documents_and_labels(spark):
    labels = spark.createDataFrame(
        [(5, 1), (5, 1), (7, 0), (None, 1), (8, None), (9, 7), (4, 0)], "doc_id long, quality int"
    )
    out = judged(odd.table(spark), labels).collect()
    assert len(out) == len(odd.rows())
    assert all(0 <= r["_posterior"] <= 1 and r["_kept"] is not None for r in out)


def test_without_labels_every_document_is_even(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["_p"] for r in judged(odd.table(spark), labels).collect()} == {0.5}
    assert judged(odd.empty(spark), labels).count() == 0


def test_newton_reaches_the_optimum():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(400, 3))
    y = (x @ [1.0, -2.0, 0.5] + draw.logistic(size=400) > 0).astype(float)
    model = quality.fit_logistic(x, y, 0.1)
    p = 1 / (1 + np.exp(-(x @ model.weights + model.intercept)))
    scaled = (x - x.mean(axis=0)) / x.std(axis=0)
    assert np.abs(scaled.T @ (y - p) - 0.1 * np.array(model.weights) * x.std(axis=0)).max() < 1e-5


def plain_features(text, grams):
    """Features of one text in plain Python."""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    kinds = Counter()
    for c in text:
        for name, pattern in quality.SHAPES:
            if re.fullmatch(pattern.rstrip("+"), c):
                kinds[name] += 1
                break
    weights = []
    for k in range(len(text) - 2):
        x = 0
        for c in text[k : k + 3]:
            x = (x * 0x100000001B3 + ord(c)) % 2**64
        weights.append(float(grams[(x * 0x9E3779B97F4A7C15 % 2**64 >> 40) % quality.BINS]))
    n = max(1, len(words))
    found = {name: kinds[name] / max(1, len(text)) for name, _ in quality.SHAPES}
    spaces = kinds["space"]
    return found | {
        "distinct": len(set(words)) / n,
        "long_words": min(1.0, (len(text) - spaces) / n / 20),
        "short": 1 / math.log2(2 + n),
        "grams": sum(weights) / max(1, len(weights)),
    }


def plain_strength(groups, centers):
    used = [(n, s, c) for (n, s), c in zip(groups, centers, strict=True) if n > 1]
    if not used:
        return PARAMS.most_prior
    total = sum(n for n, _, _ in used)
    variance = sum(n * c * (1 - c) for n, _, c in used) / total
    between = sum(n * (s / n - c) ** 2 for n, s, c in used) / len(used)
    spread = (between - variance) / (total / len(used))
    return min(PARAMS.most_prior, max(PARAMS.least_prior, variance / spread if spread > 0 else PARAMS.most_prior))


def test_query_equals_brute_force(spark):
    """Evidence, rates, strengths and posteriors of every document from the fitted numbers, in plain Python."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.fit(docs, labels, PARAMS)
    scored = quality.with_evidence(docs, model)
    rates, overall = quality.site_rates(scored, PARAMS)
    got = {r["doc_id"]: r for r in quality.judge(scored, rates, overall, PARAMS).collect()}
    rows = {r["doc_id"]: r for r in docs.collect()}
    own = {}
    for key, r in rows.items():
        found = plain_features(r["text"] or "", model.grams)
        odds = model.intercept + sum(w * found[n] for w, n in zip(model.weights, quality.NAMES, strict=True))
        own[key] = 1 / (1 + math.exp(-max(-12.0, min(12.0, odds))))
        assert got[key]["_p"] == pytest.approx(own[key], abs=1e-5)
    paths, hosts = defaultdict(lambda: [0, 0.0]), defaultdict(lambda: [0, 0.0])
    for key, r in rows.items():
        for table, site in ((paths, (r["source"], r["lang"])), (hosts, r["source"])):
            table[site][0] += 1
            table[site][1] += own[key]
    mean = sum(own.values()) / len(own)
    strength = plain_strength(list(hosts.values()), [mean] * len(hosts))
    rate = {h: (s + strength * mean) / (n + strength) for h, (n, s) in hosts.items()}
    within = plain_strength(list(paths.values()), [rate[h] for h, _ in paths])

    def logit(p):
        return math.log(p / (1 - p))

    for key, r in rows.items():
        n, s = paths[r["source"], r["lang"]]
        others = (max(0.0, s - own[key]) + within * rate[r["source"]]) / (n - 1 + within)
        odds = logit(own[key]) + PARAMS.site_weight * (logit(others) - logit(mean))
        assert got[key]["_posterior"] == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-4)
        assert got[key]["_kept"] == (got[key]["_posterior"] >= PARAMS.least_probability)


def test_gram_counts_equal_brute_force(spark):
    rows = [(0, 1, "some text ü"), (1, 0, "ab"), (1, 0, None), (1, 0, "abcabc"), (0, 1, "some")]
    wanted = np.zeros((2, 2, quality.BINS))
    for half, y, text in rows:
        for k in range(len(text or "") - 2):
            x = 0
            for c in text[k : k + 3]:
                x = (x * 0x100000001B3 + ord(c)) % 2**64
            wanted[half, y, (x * 0x9E3779B97F4A7C15 % 2**64 >> 40) % quality.BINS] += 1
    assert (quality.gram_counts(spark.createDataFrame(rows, "_half int, _y int, text string")) == wanted).all()


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = "The quick brown fox, again and again. " * 30
    whole = np.concatenate(list(quality.gram_hashes(text)))
    monkeypatch.setattr(quality, "CHUNK", 50)
    assert (np.concatenate(list(quality.gram_hashes(text))) == whole).all() and len(whole) == len(text) - 2


def test_one_text_of_each_labelled_id_is_used(spark):
    docs = spark.createDataFrame([(1, "a")] * 50 + [(2, "b"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    rows = quality.labelled(docs, labels, PARAMS, "doc_id", "text").collect()
    assert sorted((r["doc_id"], r["_y"], r["text"]) for r in rows) == [(1, 1, "a"), (2, 0, "b"), (3, 0, None)]
