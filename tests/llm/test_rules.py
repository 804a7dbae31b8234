import re

from tests.compare import same_rows
from tests.conftest import SF
from tests.llm import odd

from pointloom.llm import queries, rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for k in range(len(words) - 7):
        windows.setdefault(tuple(words[k : k + 8]), []).append(k)
    held = {k + j for places in windows.values() if len(places) > 1 for k in places for j in range(8)}
    n, rep = len(words), len(held)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, rep, n < 20 or 100 * rep > 30 * n)


def verdicts(docs, params=rules.RuleParams()):
    words = rules.common_words(docs, params)
    measured = rules.measure(docs, words, params)
    return rules.verdicts(rules.judge(measured, rules.references(measured, params), params))


def test_counts_equal_brute_force(spark):
    got = verdicts(odd.table(spark)).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    ours = sorted((str(r["doc_id"]), *[r[n] for n in names]) for r in got)
    assert ours == sorted((str(r[0]), *brute(r[1])) for r in odd.rows())
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_empty_table(spark):
    assert verdicts(odd.empty(spark)).count() == 0


ONE = rules.RuleParams(least_docs=1)
SOME = " ".join(f"{odd.PLAIN} {x} {x[::-1]}" for x in ("alpha", "beta", "gamma", "delta", "other", "thing"))


def test_distance_is_zero_for_the_reference_itself(spark):
    docs = spark.createDataFrame([(1, SOME, "en")], "doc_id long, text string, lang string")
    params = rules.RuleParams(least_docs=1, most_repeat_percent=100)
    row = verdicts(docs, params).first()
    assert row["char_distance"] == 0 and row["word_distance"] == 0 and row["kept"]


def test_short_documents_are_not_compared(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, odd.PLAIN * 10, "en")], "doc_id long, text string, lang string")
    assert verdicts(docs, ONE).where("doc_id = 1").first()["char_distance"] is None


def test_too_few_documents_make_no_reference(spark):
    docs = spark.createDataFrame([(k, SOME, "en") for k in range(19)], "doc_id long, text string, lang string")
    assert {r["char_distance"] for r in verdicts(docs).collect()} == {None}


def test_common_words_are_learnt_for_any_language(spark):
    """By documents, not by places: the word of one very long document is not among them."""
    rows = [(k, "qui quae " + " ".join(f"w{k}x{j}" for j in range(25)) + " Quod", "la") for k in range(5)]
    rows += [(9, "spam " * 9000, "la"), (10, "too few words", "la"), (11, None, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["_r_lang"]: r for r in rules.common_words(docs, ONE).collect()}
    assert found["la"]["_r_listed"][:3] == ["quae", "qui", "quod"] and found["la"]["_r_docs"] == 7
    assert found["xx"]["_r_listed"] == []


def test_one_long_junk_document_does_not_become_the_reference(spark):
    clean = [(k, " ".join(f"the {a} of {b} and" for a in "abcdefgh" for b in (f"x{k}", f"y{k}")), "en") for k in range(30)]
    junk = [(99, " ".join(f"z{k}" for k in range(60_000)), "en")]
    got = {r["doc_id"]: r["kept"] for r in verdicts(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string"), rules.RuleParams(most_repeat_percent=100)).collect()}
    assert not got[99] and all(got[k] for k in range(30))


def test_junk_goes_and_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = verdicts(docs).where("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in found}
    assert n[1, True] >= 0.98 * (n[1, True] + n.get((1, False), 0))
    assert n[0, False] >= 0.5 * (n[0, False] + n.get((0, True), 0))


def test_query_equals_sql(spark, duck):
    same_rows(queries.QUERIES["op4_quality_rules"](spark, SF), duck.sql(queries.ORACLES["op4_quality_rules"]))
