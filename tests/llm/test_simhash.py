import random
import re

import numpy as np
import pytest
from tests.conftest import SF
from tests.llm import odd
from xxhash import xxh64_intdigest

from pointloom.llm import simhash


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius=4):
    """Smallest value reachable of each value."""
    values = sorted(set(values))
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for k, a in enumerate(values):
        for b in values[k + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {v: root(v) for v in values}


def test_fingerprints_equal_brute_force():
    texts = [r[1] for r in odd.rows()] + ["A b C d", "a B c D e", "x\x0by\x0cz", "nbsp stays one", "İ K"]
    for text in texts:
        if text is None or len(text) < 10_000:
            assert simhash.fingerprint(text) == brute_fingerprint(text)


def connected(values, links):
    """Smallest value reachable of each value over ``links``."""
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {v: root(v) for v in values}


def spark_links(spark, values, **kwargs):
    rows = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    found = simhash.trie_links(spark.createDataFrame(rows, "fp long"), **kwargs).collect()
    return [(r["src"] & 2**64 - 1, r["dst"] & 2**64 - 1) for r in found]


def clusters(draw):
    values = set()
    for _ in range(60):
        centre = draw.getrandbits(64)
        for _ in range(12):
            v = centre
            for bit in draw.sample(range(64), draw.randint(0, 6)):
                v ^= 1 << bit
            values.add(v)
    base = draw.getrandbits(64)
    return values | {base ^ draw.getrandbits(20) for _ in range(300)}  # many in one trie


@pytest.mark.parametrize("kwargs", [{}, {"blocks": 7}, {"blocks": 5}, {"most_in_key": 6}])
def test_links_equal_brute_force(spark, kwargs):
    """Clusters around centres, chains and hot keys; components must be the same."""
    values = clusters(random.Random(5))
    links = spark_links(spark, values, radius=4, **kwargs)
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    assert connected(values, links) == brute_components(values)


@pytest.mark.parametrize("at_once", [1, 7, 1 << 16])
def test_walk_prunes_but_loses_nothing(at_once):
    draw = random.Random(8)
    groups = [sorted({draw.getrandbits(14) for _ in range(n)}) for n in (700, 1, 40, 2, 3)]
    values = np.array([v for g in groups for v in g], np.uint64)
    starts = np.cumsum([0] + [len(g) for g in groups])
    found = simhash.walk_tries(values, starts, 2, at_once).tolist()
    for k, group in enumerate(groups):
        links = [(int(values[a]), int(values[b])) for a, b in found if starts[k] <= a < starts[k + 1]]
        assert all(starts[k] <= b < starts[k + 1] for a, b in found if starts[k] <= a < starts[k + 1])
        assert connected(group, links) == brute_components(group, 2)
    assert len(found) < 3 * len(values)


def test_one_great_cluster_of_near_copies(spark):
    """12,000 distinct fingerprints around one: one component, by a number of links that grows with them."""
    draw = random.Random(11)
    centre = draw.getrandbits(64)
    values = {centre}
    while len(values) < 12_000:
        values.add(centre ^ sum(1 << b for b in draw.sample(range(64), draw.randint(1, 4))))
    links = spark_links(spark, values, radius=4, most_in_key=1000)
    assert set(connected(values, links).values()) == {min(values)}
    assert len(links) < 60 * len(values)


def test_blocks_grow_with_the_table():
    assert simhash.blocks_for(10, 4) == 6 < simhash.blocks_for(10**10, 4) <= 10
    for level in range(simhash.LEVELS):
        for blocks in (6, 8):
            masks = simhash.block_masks(level, blocks, 4)
            draw = random.Random(level)
            for _ in range(300):
                differ = sum(1 << b for b in draw.sample(range(64), 4))
                assert any(not differ & m for m in masks)


def expected(rows):
    prints = [(key, brute_fingerprint(text)) for key, text in rows]
    classes = brute_components([p for _, p in prints])
    least = {}
    for key, p in prints:
        if key is not None:
            least[classes[p]] = min(key, least.get(classes[p], key))
    return sorted(((key, f"{p:016x}", least.get(classes[p])) for key, p in prints), key=str)


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = simhash.near_duplicates(docs).collect()
    ours = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=str)
    assert ours == expected([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_odd_documents(spark):
    got = simhash.near_duplicates(odd.table(spark)).collect()
    ours = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=str)
    assert ours == expected([r[:2] for r in odd.rows()])


def test_empty_table(spark):
    assert simhash.near_duplicates(odd.empty(spark)).count() == 0
    assert simhash.one_of_each(odd.empty(spark)).count() == 0


def test_one_of_each_component_stays(spark):
    docs = odd.table(spark)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    prints = [(r[0], brute_fingerprint(r[1])) for r in odd.rows()]
    classes = brute_components([p for _, p in prints])
    least = {}
    for key, p in prints:  # null ids last
        least[classes[p]] = min((key is None, key or 0), least.get(classes[p], (True, 0)))
    wanted = sorted(None if unnamed else key for unnamed, key in least.values() if not unnamed)
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == wanted
    assert kept.count() == len(least)
