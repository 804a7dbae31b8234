import random
import re

from tests.llm import odd

from pointloom.llm import shingles


def brute_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows, similarity=0.8):
    """Smallest id reachable of each id."""
    sets = {key: brute_set(text) for key, text in rows}
    parent = {key: key for key in sets}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    keys = sorted(sets)
    for k, a in enumerate(keys):
        for b in keys[k + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or (x and y and len(x & y) / len(x | y) >= similarity):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {key: root(key) for key in keys}


def edited():
    """Texts of 150 words and copies with 1 to 8 changed words, on both sides of 0.8; chains of copies."""
    draw = random.Random(3)
    rows = []
    for _ in range(40):
        words = [f"w{draw.randrange(5000)}" for _ in range(150)]
        rows.append(" ".join(words))
        for changes in (1, 2, 3, 4, 5, 6, 8):
            copy = list(words)
            for at in draw.sample(range(150), changes):
                copy[at] = f"x{draw.randrange(5000)}"
            rows.append(" ".join(copy).upper() if changes == 2 else " ".join(copy))
            if changes == 3:
                words = copy
    return list(enumerate(rows))


def test_edited_copies_equal_brute_force(spark):
    rows = edited()
    wanted = brute_components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in shingles.near_duplicates(docs).collect()}
    assert got == wanted
    assert {r["doc_id"] for r in shingles.one_of_each(docs).collect()} == set(wanted.values())


def test_dedup_stage_links_at_the_threshold(spark):
    import corpus_pipeline

    rows = edited()
    docs = spark.createDataFrame([(*r, "s", "en", len(r[1])) for r in rows], "doc_id long, text string, source string, lang string, n_chars long")
    kept = corpus_pipeline.dedup_stage(spark, docs, "")
    assert {r["doc_id"] for r in kept.collect()} == set(brute_components(rows).values())


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400")
    got = {r["doc_id"]: r["component_id"] for r in shingles.near_duplicates(docs).collect()}
    assert got == brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_unlike_texts_around_one_passage(spark, monkeypatch):
    """Pairs that are compared grow with the texts, not with their square, and near copies among them are found."""
    compared = []
    links = shingles.similar_links

    def counted(sets, pairs, similarity):
        compared.append(pairs.count())
        return links(sets, pairs, similarity)

    monkeypatch.setattr(shingles, "similar_links", counted)
    per_row = []
    for size in (1000, 4000):
        draw = random.Random(size)
        passage = " ".join(f"p{k}" for k in range(110))
        rows = []
        for k in range(size):
            own = [f"w{draw.randrange(10**6)}" for _ in range(60)]
            rows.append((k, f"{' '.join(own[:30])} {passage} {' '.join(own[30:])}"))
        copies = [(size + k, text.replace(text.split()[5], "edited", 1)) for k, text in rows[:40]]
        compared.clear()
        docs = spark.createDataFrame(rows + copies, "doc_id long, text string")
        got = {r["doc_id"]: r["component_id"] for r in shingles.near_duplicates(docs).collect()}
        assert all(got[size + k] == k for k in range(40))  # similarity 0.94
        assert sum(v != k for k, v in got.items()) == 40
        per_row.append(sum(compared) / size)
    assert per_row[1] < 30 and per_row[1] < 3 * per_row[0], per_row


def test_odd_and_empty_documents(spark):
    rows = [(k, text) for k, (_, text, *_) in enumerate(odd.rows()) if text is None or len(text) < 10_000]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in shingles.near_duplicates(docs).collect()}
    assert got == brute_components(rows)
    assert shingles.one_of_each(odd.empty(spark)).count() == 0


def test_fingerprints_link_without_bands(spark, monkeypatch):
    """The trie walk of SimHash gives links of its own, and the exact check keeps only those at the threshold."""
    import numpy as np

    monkeypatch.setattr(shingles, "band_keys", lambda _: np.zeros(0, np.uint64))
    rows = edited()
    prints = {key: shingles.majority(shingles.shingle_set(text)) for key, text in rows}
    wanted = brute_components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in shingles.near_duplicates(docs).collect()}
    assert all(wanted[key] == wanted[first] for key, first in got.items())
    linked = {key for key, first in got.items() if key != first}
    close = {b for a in prints for b in prints if a < b and wanted[a] == wanted[b] and (prints[a] ^ prints[b]).bit_count() <= 4}
    assert len(linked) > 20 and len(linked) >= 0.9 * len(close)
