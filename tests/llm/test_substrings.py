import random

import numpy as np
import pytest
from tests.llm import odd

from pointloom.llm import substrings, suffixes


def plain_order(data):
    return sorted(range(len(data)), key=lambda i: data[i:])


@pytest.mark.parametrize("letters", [b"ab", b"abc\x00\xff", bytes(range(256))])
def test_suffix_array_equals_a_sort(letters):
    draw = random.Random(len(letters))
    for size in [*range(40), 300, 2000]:
        for _ in range(6):
            data = bytes(draw.choices(letters, k=size))
            assert suffixes.suffix_array(np.frombuffer(data, np.uint8)).tolist() == plain_order(data)
    for data in (b"a" * 500, b"ab" * 300, b"abracadabra" * 40, bytes(range(256)) * 2, odd.long_text(400).encode()):
        assert suffixes.suffix_array(np.frombuffer(data, np.uint8)).tolist() == plain_order(data)


def test_permuted_prefixes_equal_a_count():
    draw = random.Random(1)
    for size in (1, 2, 50, 400):
        data = bytes(draw.choices(b"abb\xff", k=size)) * 2
        codes = np.frombuffer(data, np.uint8)
        order = suffixes.suffix_array(codes)
        reach = np.array([draw.randint(0, len(data) - k) for k in range(len(data))])
        got = suffixes.permuted_prefixes(codes, order, reach)
        before = {int(b): int(a) for a, b in zip(order[:-1], order[1:], strict=True)}
        for k in range(len(data)):
            most = min(reach[k], reach[before[k]]) if k in before else 0
            same = 0
            while same < most and data[k + same] == data[before[k] + same]:
                same += 1
            assert got[k] == same


def test_windows_get_the_least_id_of_their_bytes():
    draw = random.Random(5)
    base = bytes(draw.choices(b"abcdefgh ", k=400))
    contents = [base[i : i + draw.randint(50, 90)] for i in draw.choices(range(300), k=60)] + [b"\xff" * 70, b"\x00" * 60]
    contents = sorted(set(contents), key=lambda c: draw.random())
    least = np.array([draw.randint(-50, 50) for _ in contents])
    got = substrings.least_of_windows(contents, least, 50)
    best = {}
    for c, i in zip(contents, least.tolist(), strict=True):
        for k in range(len(c) - 49):
            best[c[k : k + 50]] = min(i, best.get(c[k : k + 50], 99))
    assert [x.tolist() for x in got] == [[best[c[k : k + 50]] for k in range(len(c) - 49)] for c in contents]


def brute(rows, width=50):
    texts = [(t or "").encode() for _, t in rows]
    rank = [2**63 - 1 if k is None else k for k, _ in rows]
    least = {}
    for i, t in zip(rank, texts, strict=True):
        for k in range(len(t) - width + 1):
            w = t[k : k + width]
            least[w] = min(i, least.get(w, i))
    out = []
    for (key, _), i, t in zip(rows, rank, texts, strict=True):
        gone = bytearray(len(t))
        for k in range(len(t) - width + 1):
            if least[t[k : k + width]] < i:
                gone[k : k + width] = b"\x01" * width
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((key, len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, *map(repr, r)))


def got(docs, **params):
    rows = substrings.remove_repeats(docs, substrings.SubstringParams(**params)).collect()
    return order((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows)


def planted():
    """Copies, edited copies, shared passages at borders and inside, one text inside another, runs of one letter."""
    draw = random.Random(11)
    texts = [odd.long_text(draw.randint(1, 120), seed=k) for k in range(40)]
    passages = [odd.long_text(30, seed=900 + k) + " – ärger 第一" for k in range(4)]
    for k in range(160):
        kind, own = k % 8, draw.choice(texts)
        if kind == 0:
            texts.append(own)
        elif kind == 1:
            at = draw.randint(0, len(own))
            texts.append(own[:at] + "EDIT" + own[at + 2 :])
        elif kind == 2:
            texts.append(draw.choice(passages) + own[: draw.randint(0, 60)] + draw.choice(passages))
        elif kind == 3:
            texts.append(own[draw.randint(0, 30) :][:200] + draw.choice(texts)[:90])
        elif kind == 4:
            texts.append("a" * draw.randint(30, 400))
        elif kind == 5:
            texts.append("0123456789" * draw.randint(1, 30))
        elif kind == 6:
            texts.append(own[: draw.choice([48, 49, 50, 51])])
        else:
            texts.append(draw.choice(passages)[5 : draw.randint(40, 120)])
    ids = list(range(-5, len(texts) - 5))
    draw.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("bounds", [{}, {"BLOCK": 700, "SLICE": 333, "CHUNK": 200, "PART": 500, "SHARD": 500}])
@pytest.mark.parametrize("most", [1 << 16, 3])
def test_planted_repeats(spark, monkeypatch, bounds, most):
    for name, value in bounds.items():
        monkeypatch.setattr(substrings, name, value)
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = got(docs, most_segments=most)
    assert found == order(brute(rows))
    assert sum(r[2] for r in found) > 10_000


def test_slices_and_chunks_change_nothing(monkeypatch):
    text = odd.long_text(300).encode()
    ids, lengths = [1, None, 2], np.array([len(text), 0, 40])
    data = substrings.compress(text + text[:40])
    whole = substrings.Block(ids, lengths, data, 50).segments()
    windows = {(int(k), w) for k, a, b, _ in zip(*whole, strict=True) for w in range(a, b)}
    assert {w for _, w in windows} == set(range(len(text) - 49))
    monkeypatch.setattr(substrings, "SLICE", 77)
    again = substrings.Block(ids, lengths, data, 50).segments()
    assert windows == {(int(k), w) for k, a, b, _ in zip(*again, strict=True) for w in range(a, b)}


def test_odd_documents(spark):
    rows = [(r[0], r[1]) for r in odd.rows()] + [(None, odd.PLAIN), (-9, odd.PLAIN), (50, odd.long_text() + odd.PLAIN)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, block string, keys int")
    assert got(docs) == order(brute(rows))
    assert substrings.remove_repeats(odd.empty(spark)).count() == 0
    assert substrings.remove_repeats(odd.table(spark)).count() == len(odd.rows())
