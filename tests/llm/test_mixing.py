import pytest
from pyspark.sql import functions as F
from tests.conftest import SF
from tests.llm import odd

from pointloom.llm import mixing

KIND = "source string, lang string, topic string, tokens long"


def brute(cells, params, rounds=400):
    """Plain fitting over the cells as a dictionary."""
    weights = {c[:3]: float(c[3]) for c in cells}
    total = sum(weights.values())
    powers = [params.source_power, params.lang_power, params.topic_power]
    goals = []
    for axis, power in enumerate(powers):
        sums = {}
        for key, v in weights.items():
            sums[key[axis]] = sums.get(key[axis], 0) + v
        goals.append({k: total * v**power / sum(x**power for x in sums.values()) for k, v in sums.items()})
    for _ in range(rounds):
        for axis in range(3):
            sums = {}
            for key, v in weights.items():
                sums[key[axis]] = sums.get(key[axis], 0) + v
            weights = {k: v * goals[axis][k[axis]] / sums[k[axis]] for k, v in weights.items()}
    return weights


def test_fitted_cells_equal_brute_force(spark):
    params = mixing.MixParams(tolerance=1e-10, most_rounds=100)
    topics = mixing.topic_names(params)
    cells = [
        (f"s{i}", f"l{j}", topics[k % len(topics)], 10 + (i * 37 + j * 11 + k * 5) % 90 + 4000 * (i == 0))
        for i in range(6) for j in range(3) for k in range(4)
    ]
    raked = mixing.rake(spark.createDataFrame(cells, KIND), params)
    wanted = brute(cells, params)
    for r in raked.cells.collect():
        assert r["tokens"] * r["factor"] == pytest.approx(wanted[r["source"], r["lang"], r["topic"]], rel=1e-4)


def test_many_languages_have_targets_of_their_own(spark):
    params = mixing.MixParams(tolerance=1e-9, most_rounds=400)
    cells = [
        (f"s{i}", "*" if j == 7 else f"l{j}", t, 1 + (i * 37 + j * 11 + k * 5) % 90 + 500 * (j == 0))
        for i in range(3) for j in range(400) for k, t in enumerate(("prose", "list")) if (i + j) % 5
    ]
    raked = mixing.rake(spark.createDataFrame(cells, KIND), params)
    assert raked.converged
    wanted = brute(cells, params)
    for r in raked.cells.collect():
        assert r["tokens"] * r["factor"] == pytest.approx(wanted[r["source"], r["lang"], r["topic"]], rel=1e-4)


def test_fitting_by_spark_jobs_takes_the_same_steps(spark):
    cells = [
        (f"s{i}", f"l{j}", t, 10 + (i * 37 + j * 11 + k * 5) % 90 + 900 * (i == 0))
        for i in range(5) for j in range(3) for k, t in enumerate(("prose", "list"))
    ]
    found = []
    for most in (1000, 0):
        params = mixing.MixParams(most_rounds=2, most_local_cells=most)
        raked = mixing.rake(spark.createDataFrame(cells, KIND), params, bounded=True)
        found.append((raked.rounds, {(r[0], r[1], r[2]): r["factor"] for r in raked.cells.collect()}, raked.error))
    assert found[0][0] == found[1][0] and found[0][2] == pytest.approx(found[1][2], rel=1e-3)
    assert found[0][1] == pytest.approx(found[1][1], rel=1e-4)


def test_a_fit_that_does_not_converge_says_so(spark):
    """Each source has a language of its own, so both targets cannot hold."""
    cells = spark.createDataFrame([("a", "x", "prose", 100), ("b", "y", "prose", 900)], KIND)
    raked = mixing.rake(cells, mixing.MixParams(most_rounds=20))
    assert not raked.converged and raked.error > 0.01 and raked.rounds == 20
    docs = spark.createDataFrame(
        [(k, "w " * 100 if k < 9 else "w " * 500, "a" if k < 9 else "b", "x" if k < 9 else "y") for k in range(12)],
        "doc_id long, text string, source string, lang string",
    )
    params = mixing.MixParams(most_rounds=20, lang_targets={"x": 1.0, "y": 9.0})
    assert all(r["_m_fit_error"] > params.tolerance for r in mixing.mix(docs, params).collect())


def test_given_topics_and_targets(spark):
    docs = spark.createDataFrame(
        [(k, "w " * 10, "a", f"l{k % 2}", f"t{k % 3}") for k in range(600)],
        "doc_id long, text string, source string, lang string, kind string",
    )
    params = mixing.MixParams(lang_targets={"l0": 3.0, "l1": 1.0, "absent": 0.0}, token_share=0.5)
    out = mixing.mix(docs, params, topic_col="kind").collect()
    assert {r["_m_topic"] for r in out} == {"t0", "t1", "t2"}
    chance = {lang: sum(r["_m_probability"] for r in out if r["_m_lang"] == lang) for lang in ("l0", "l1")}
    assert chance["l0"] == pytest.approx(225, rel=1e-3) and chance["l1"] == pytest.approx(75, rel=1e-3)


def test_draws_equal_brute_force(spark):
    """Each row is kept if its own hash, as a share of 2**52, is below its cell's probability."""
    docs = odd.table(spark)
    params = mixing.MixParams(token_share=0.4)
    out = mixing.mix(docs.withColumn("_of", F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.lit(params.seed))), params)
    seen = set()
    for r in out.collect():
        assert r["_m_kept"] == ((r["_of"] % (1 << 52)) / (1 << 52) < r["_m_probability"])
        if r["doc_id"] is None:
            seen.add(r["_of"])
    assert len(seen) == 2  # rows without an id are drawn apart


def test_sample_has_the_wanted_share(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    params = mixing.MixParams()
    chance, size = F.col("_m_probability"), F.col("_m_tokens")
    row = mixing.mix(docs, params).agg(
        (F.sqrt(F.sum(size * size * chance * (1 - chance))) / F.sum(size)).alias("sigma"),
        (F.sum(F.col("_m_tokens") * F.col("_m_probability")) / F.sum("_m_tokens")).alias("expected"),
        (F.sum(F.when(F.col("_m_kept"), F.col("_m_tokens"))) / F.sum("_m_tokens")).alias("kept"),
        F.max("_m_probability").alias("most"),
    ).first()
    assert row["expected"] == pytest.approx(params.token_share, abs=1e-3)
    assert row["kept"] == pytest.approx(params.token_share, abs=4 * row["sigma"])
    assert row["most"] <= 1


def test_odd_documents(spark):
    params = mixing.MixParams(most_rounds=8)
    out = mixing.mix(odd.table(spark), params).collect()
    assert len(out) == len(odd.rows())
    assert all(r["_m_factor"] > 0 and r["_m_kept"] is not None for r in out)
    again = mixing.mix(odd.table(spark), params).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_empty_table(spark):
    assert mixing.mix(odd.empty(spark), mixing.MixParams()).count() == 0


@pytest.mark.parametrize(
    ("text", "topic"),
    [("under a LICENCE", "legal"), ("write to me@here.org", "contact"), ("call +49 30 1234567 8", "contact"),
     ("a | b | c | d | e", "table"), ("x\n - item", "list"), ("why?", "question"), ("well", "prose"), ("a @ b", "prose")],
)
def test_topics(spark, text, topic):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert docs.select(mixing.topic_of(F.col("text"), mixing.MixParams())).first()[0] == topic


def test_smallest_table_runs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(1)
    assert mixing.mix(docs, mixing.MixParams()).count() == 1


def hot_and_tail():
    """A source with a third of all tokens and 199 Zipf sources, languages and topics unevenly spread."""
    topics = mixing.topic_names(mixing.MixParams())[:3]
    zipf = [2e6 / k / sum(1 / x for x in range(1, 200)) for k in range(1, 200)]
    return [
        (f"s{i}", f"l{j}", t, max(1, int(size * (1 + (i * 7 + j * 5 + k * 3) % 11) / 54)))
        for i, size in enumerate([1e6, *zipf]) for j in range(3) for k, t in enumerate(topics)
    ]


def test_bounded_sample_has_the_reachable_marginals(spark):
    params, cells = mixing.MixParams(), hot_and_tail()
    raked = mixing.rake(spark.createDataFrame(cells, KIND), params, bounded=True)
    rows = raked.cells.collect()
    assert max(r["factor"] for r in rows) <= 1
    total = sum(c[3] for c in cells)
    for axis, power in (("source", params.source_power), ("lang", params.lang_power), ("topic", params.topic_power)):
        held, got = {}, {}
        for r in rows:
            held[r[axis]] = held.get(r[axis], 0) + r["tokens"]
            got[r[axis]] = got.get(r[axis], 0) + r["tokens"] * r["factor"]
        low, high = 0.0, 1e12
        for _ in range(200):
            level = (low + high) / 2
            goal = {k: min(v, level * v**power) for k, v in held.items()}
            low, high = (level, high) if sum(goal.values()) < 0.7 * total else (low, level)
        for k, v in goal.items():
            assert got[k] == pytest.approx(v, rel=1e-3, abs=1e-4 * total)


@pytest.mark.parametrize("most", [100_000, 0])
def test_sources_have_given_targets(spark, most):
    """Listed sources get their weights, what is not listed goes, and a listed source without rows ends the job."""
    rows = [(k, "word " * 10, f"s{k % 4}", ["en", "de"][k % 3 == 0]) for k in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    params = mixing.MixParams(source_targets={"s0": 1.0, "s1": 2.0, "s2": 3.0}, lang_power=1.0, token_share=0.3, most_local_cells=most)
    mixed = mixing.mix(docs, params)
    shares = {r["_m_source"]: r["n"] for r in mixed.groupBy("_m_source").agg(F.sum(F.col("_m_tokens") * F.col("_m_probability")).alias("n")).collect()}
    total = sum(shares.values())
    assert total == pytest.approx(0.3 * 12_000, rel=1e-3)
    assert [shares[f"s{k}"] / total for k in range(4)] == pytest.approx([1 / 6, 2 / 6, 3 / 6, 0], abs=1e-3)
    with pytest.raises(ValueError, match="'s9'"):
        mixing.mix(docs, mixing.MixParams(source_targets={"s0": 1.0, "s9": 1.0}, most_local_cells=most)).count()
