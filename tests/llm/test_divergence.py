import re
from collections import Counter

from tests.llm import odd

from pointloom.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, most=10):
    """(lang, source, part, item, value, rank), every group with each kept term."""
    docs = [(lang or "", source or "", [t.translate(LOWER) for t in TERM.findall(text or "")]) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        holders, total = Counter(), Counter()
        for _, _, terms in own:
            holders.update(set(terms))
            total.update(terms)
        kept = [t for t in holders if holders[t] >= least]
        counts = {s: Counter() for _, s, _ in own}
        for _, s, terms in own:
            counts[s].update(terms)

        def chance(c, kept=kept):
            n = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // n for t in kept}

        p = {s: chance(c) for s, c in counts.items()}
        q = chance(total)
        for s in p:
            others = [(-sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o.encode(), o) for o in p if o != s]
            tops = [(-((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(others), 1)]
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(sorted(tops)[:most], 1)]
    return sorted(out)


def found(spark, rows, **params):
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    return sorted(tuple(r) for r in divergence.audit(docs, divergence.DivergenceParams(**params)).collect())


def test_sums_equal_brute_force(spark):
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)] + ["ÄRGER", "ärger", "naïve", "第一"]
    rows = []
    for k in range(240):
        text = ", ".join(words[(k * j * j + j) % len(words)] * (1 + (j % 2 == 0) * 0) for j in range(1 + k % 17)).title()
        rows.append((text, ["en", "de", None][k % 3], f"s{k % 7 if k % 5 else 0}"))
    rows += [(None, "en", "bare"), ("1 2 3", "en", "bare"), ("lone words here", "xx", "a"), (None, "xx", None), ("", None, None)]
    assert found(spark, rows) == brute(rows)


def test_many_sources_and_small_counters(spark, monkeypatch):
    monkeypatch.setattr(divergence, "MOST_COUNTED", 3)
    rows = [(f"common {'odd' if k % 3 else 'even'} word{chr(97 + k % 4)} " * (1 + k % 5), "en", f"s{k % 23}") for k in range(200)]
    assert found(spark, rows, least_docs=2, most_terms=2) == brute(rows, 2, 2)


def test_odd_documents(spark):
    rows = [(text, lang, source) for _, text, lang, source, *_ in odd.rows()]
    got = sorted(tuple(r) for r in divergence.audit(odd.table(spark), divergence.DivergenceParams(least_docs=1)).collect())
    assert got == brute(rows, 1)
    assert sorted(tuple(r) for r in divergence.audit(odd.table(spark)).collect()) == brute(rows)
    assert divergence.audit(odd.empty(spark)).count() == 0


def test_long_division_is_exact(spark):
    from pyspark.sql import functions as F

    cases = [(0, 2), (5, 9), (10**12, 3 * 10**12 + 7), (9 * 10**12, 9 * 10**12 + 2), (1, 8_999_999_999_999)]
    rows = spark.createDataFrame(cases, "n long, m long").select("n", "m", divergence.probability(F.col("n"), F.col("m")).alias("p"))
    assert all(r["p"] == 1 + 10**9 * (r["n"] + 2) // r["m"] for r in rows.collect())
