import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.conftest import SF
from tests.llm import odd
from tokenizers import Tokenizer

from pointloom.llm import packing
from pointloom.llm.tokenize import WordTokenizer

PATH = packing.public_path()
WHOLE = Tokenizer.from_file(PATH)
WORDS = WordTokenizer(PATH)


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids + [1]


def check(packed, docs, capacity=2048):
    """Every id lies in exactly one piece, sequences and offsets are gapless and full at most."""
    wanted, got = defaultdict(int), defaultdict(int)
    for key, text in docs:
        ids = np.array(ids_of(text), "<u4")
        wanted[key, len(ids)] += len(ids)
    by_sequence, found = defaultdict(list), defaultdict(set)
    for key, text in docs:
        found[key].add(np.array(ids_of(text), "<u4").tobytes())
    for r in packed:
        got[r["doc_id"], r["doc_tokens"]] += r["length"]
        parts = {zlib.crc32(b[4 * r["start"] : 4 * (r["start"] + r["length"])]) for b in found[r["doc_id"]]}
        assert r["ids_crc32"] in parts
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == wanted
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert 0 < at <= capacity


def test_odd_documents(spark):
    rows = packing.pack(odd.table(spark), packing.PackingParams(PATH)).collect()
    check(rows, [r[:2] for r in odd.rows()])


def test_empty_table(spark):
    assert packing.pack(odd.empty(spark), packing.PackingParams(PATH)).count() == 0


def test_documents_are_packed_with_little_padding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    packed = packing.pack(docs, packing.PackingParams(PATH)).cache()
    check(packed.collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert packing.padding_share(packed) < 0.03


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_remembered_words_give_the_ids_of_the_tokenizer(text):
    assert np.frombuffer(WORDS.ids(text), "<u4").tolist() == ids_of(text)[:-1]


@pytest.mark.parametrize("text", ["it's WE'LL x_1 12.5!", "<|endoftext|> a", "İstanbul ſ", "á b", "tab\tand\r\nline"])
def test_awkward_texts_give_the_ids_of_the_tokenizer(text):
    assert np.frombuffer(WORDS.ids(text), "<u4").tolist() == ids_of(text)[:-1]


def test_plan_is_near_the_bound_of_the_linear_program():
    draw = np.random.default_rng(1)
    size = np.arange(1, 256)
    demand = draw.integers(0, 60, len(size))
    size, demand = size[demand > 0], demand[demand > 0]
    patterns, copies, gap = packing.plan_patterns(size, demand, 256, 6000)
    assert gap == 0
    assert (copies @ patterns == demand).all()
    assert (patterns @ size <= 256).all()
    assert copies.sum() <= np.ceil(size @ demand / 256) * 1.02 + 1


def test_knapsack_equals_brute_force():
    best, counts = packing.knapsack(np.array([3.0, 4.0, 5.0]), np.array([2, 3, 4]), 9)
    assert best == max(
        3 * a + 4 * b + 5 * c for a in range(5) for b in range(4) for c in range(3) if 2 * a + 3 * b + 4 * c <= 9
    )
    assert counts @ np.array([2, 3, 4]) <= 9


def test_starting_basis_is_inverted():
    draw = np.random.default_rng(2)
    size = np.sort(draw.choice(np.arange(1, 256), 90, replace=False))
    demand = draw.integers(1, 500, 90)
    basis, inverse, use = packing.starting_basis(size, demand, 256)
    assert np.allclose(basis @ inverse, np.eye(90)) and np.allclose(basis @ use, demand)
    assert (use >= 0).all() and (size @ basis <= 256).all()


def test_stopped_program_tells_its_gap(spark):
    draw = np.random.default_rng(4)
    size, demand = np.arange(20, 100), draw.integers(1, 90, 80)
    _, best, solved = packing.generate_columns(size, demand.astype(float), 256, 6000)
    _, use, gap = packing.generate_columns(size, demand.astype(float), 256, 4)
    assert solved == 0 < gap
    assert best.sum() <= use.sum() <= best.sum() * (1 + gap)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(docs, packing.PackingParams(PATH, most_pivots=1)).collect()
    assert {r["lp_gap"] > 0 for r in rows} == {True}
    check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("text", ["it's WE'LL x_1", "two  spaces\nand a line", "naïve café", ""])
def test_other_tokenizer_files_are_used_as_a_whole(text):
    path = packing.public_path("byte_bpe_50k.json")
    got = np.frombuffer(WordTokenizer(path).ids(text), "<u4").tolist()
    assert got == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_fast_patterns_find_the_same_words():
    import re

    from pointloom.llm import tokenize

    every = "".join(map(chr, range(0x20, 0x7F))) + "\t\n\r"
    draw = random.Random(8)
    texts = ["".join(draw.choices(every, k=60)).lower() for _ in range(3000)] + ["it's 'street' we'll they've i'd'm''re _a_1b2 don't'", every.lower()]
    words, fast, ascii_ = (re.compile(p).findall for p in (tokenize.WORDS, tokenize.FAST_WORDS, tokenize.ASCII_WORDS))
    assert all(words(t) == fast(t) == ascii_(t) for t in texts)
    latin = ["".join(draw.choices(every + "äöüßéñÉ¿«»–“”€…ĳſ", k=60)).lower() for _ in range(3000)]
    assert all(words(t) == fast(t) for t in latin)


def test_remembered_words_are_bounded_in_number_and_letters(monkeypatch):
    from pointloom.llm import tokenize

    monkeypatch.setattr(tokenize, "MOST_WORDS", 50)
    monkeypatch.setattr(tokenize, "MOST_LETTERS", 2000, raising=False)
    words, draw = WordTokenizer(PATH), random.Random(3)
    many = " ".join("".join(draw.choices("abcdeé", k=4)) for _ in range(300))
    texts = ["the same words come again and again", many, "".join(draw.choices("abcde", k=5000)), ""]
    texts += ["".join(draw.choices("abcde ", k=400)) for _ in range(30)] + ["".join(draw.choices("xyz", k=700)) for _ in range(30)]
    for text in [*texts, *texts]:
        assert np.frombuffer(words.ids(text), "<u4").tolist() == ids_of(text)[:-1]
        for held in (words.known, getattr(words, "older", {})):
            assert len(held) <= 50 and sum(map(len, held)) <= 2000


def test_texts_go_to_workers_in_small_batches_without_pandas(spark):
    from pointloom.plans.session import arrow_batches

    arrow_batches(spark)
    docs = spark.range(1200).selectExpr("id as doc_id", "concat('word ', id) as text").coalesce(1)
    packed = packing.pack(docs, packing.PackingParams(PATH))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
    assert "Pandas" not in packed._jdf.queryExecution().executedPlan().toString()
    check(packed.collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
