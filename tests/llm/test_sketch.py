import base64
import hashlib

import numpy as np
import pytest
from tests.conftest import SF
from tests.llm import odd

from pointloom.llm import sketch


def exact(a, b):
    """Share of the smaller text's shingles that the larger has."""
    x, y = ({t[k : k + 8] for k in range(len(t) - 7)} for t in (a, b))
    return len(x & y) / min(len(x), len(y))


MASK = 2**64 - 1


def plain_sketch(text):
    """The hashes kept, one shingle after the other in plain integers."""
    kept = set()
    width = min(8, len(text))
    for k in range(len(text) - width + 1 if text else 0):
        x = 0 if width == 8 else width
        for c in text[k : k + width]:
            x = (x * 0x9E3779B97F4A7C15 + ord(c) + 1) & MASK
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & MASK
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & MASK
        x = (x ^ x >> 31) >> 32
        if x * 8 < 2**32:
            kept.add(x)
    return kept


def plain_print(text):
    kept = plain_sketch(text)
    data = b"".join(x.to_bytes(4, "big") for x in sorted(kept))
    return base64.b64encode(data).decode() if kept or not text else "-"


def plain_likeness(a, b):
    if plain_print(a) == plain_print(b):
        return 1.0
    x, y = plain_sketch(a), plain_sketch(b)
    return len(x & y) / min(len(x), len(y)) if x and y else 0.0


def test_one_threshold_at_every_length():
    for text in ["", "a", "short te", "nine char", odd.PLAIN, odd.long_text(300), "ümläut \U0001f600 第一 and more"]:
        assert sketch.sketch(text).tolist() == sorted(plain_sketch(text))
        assert sketch.fingerprint(text, sketch.sketch(text)) == plain_print(text)


def test_containment_of_unequal_texts():
    large = odd.long_text(20_000)
    for size in (300, 1000, 4000):
        small = large[5000 : 5000 + size]
        assert sketch.likeness(sketch.sketch(small), sketch.sketch(large)) == 1.0 == exact(small, large)
        mixed = small[: size // 2] + odd.long_text(1000, seed=9)[: size // 2]
        found = sketch.likeness(sketch.sketch(mixed), sketch.sketch(large))
        assert found == pytest.approx(exact(mixed, large), abs=4 * (0.25 * 8 / size) ** 0.5)


def test_sketches_merge_exactly():
    a, b = odd.long_text(2000, 1), odd.long_text(900, 2)
    assert set(sketch.merge(sketch.sketch(a), sketch.sketch(b)).tolist()) == plain_sketch(a) | plain_sketch(b)


def test_likeness_of_a_table_estimates_containment(spark):
    """Every document with its edited text, against the exact shares of shingles."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r["near_edited"] for r in sketch.compare_neighbours(docs).collect()}
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    errors, sizes = [], []
    for k, (key, text) in enumerate(rows):
        half = len(text) // 2
        edited = text[: len(text) - half] + rows[(k + 1) % len(rows)][1][:half]
        if len(text) >= 100:
            errors.append(got[key] - exact(text, edited))
            sizes.append(min(len({t[k : k + 8] for k in range(len(t) - 7)}) for t in (text, edited)))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.06
    # a share of n / 8 hashes has a standard error of 0.5 / sqrt(n / 8) at most
    assert (np.abs(errors) * np.sqrt(np.array(sizes) / 8)).max() < 2.5


def test_codes_round_trip():
    kept = sketch.sketch(odd.PLAIN)
    assert (sketch.decode(sketch.encode(kept)) == kept).all()


def brute(rows):
    """Rows in descending order of the id, and what each one's edited text is."""
    texts = [t or "" for _, t in rows]
    out = []
    for k, (key, _) in enumerate(rows):
        text, following = texts[k], texts[(k + 1) % len(rows)]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        near = plain_likeness(text, edited), plain_likeness(text, following)
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), plain_print(text), plain_print(edited), *near))
    return sorted(out)


@pytest.mark.parametrize("parts", ["1", "4", "23"])
def test_neighbours_equal_brute_force(spark, parts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = sketch.compare_neighbours(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted(tuple(r[n] for n in names) for r in got) == brute(rows)


def test_odd_documents(spark):
    got = sketch.compare_neighbours(odd.table(spark)).collect()
    assert len(got) == len(odd.rows())
    prints = {}
    for key, text, *_ in odd.rows():
        prints.setdefault(str(key), set()).add(sketch.fingerprint(text or "", sketch.sketch(text or "")))
    assert all(r["fingerprint"] in prints[str(r["doc_id"])] for r in got)
    assert sketch.with_sketches(odd.table(spark)).count() == len(odd.rows())


def test_few_rows(spark):
    assert sketch.compare_neighbours(odd.empty(spark)).count() == 0
    row = sketch.compare_neighbours(spark.createDataFrame([(5, "just one text")], "doc_id long, text string")).first()
    assert row["near_next"] == 1.0 and row["n_chars"] == 13
