"""Near-duplicate documents by SimHash, held against the Jaccard similarity of their sets of word shingles.

Texts with equal sets are merged first, so copies cost one row.  Each set has a
SimHash fingerprint, and the trie walk of :mod:`pointloom.llm.simhash` gives the
first candidates.  It finds most pairs of few edits but few of those near a
threshold of 0.8, so MinHash bands give the rest: two sets of similarity s meet in a band with probability
s ** ROWS and in none of the bands with (1 - s ** ROWS) ** BANDS, 2.4e-6 at 0.8;
at 0.4, 0.3 and 0.2, as where documents share a passage, in any of them with
0.09, 0.012 and 0.0007.
Every candidate is then held against its exact similarity; only those that reach
the threshold are links.  Within a band's bucket each set is compared with one
drawn by a hash if that is in another component by now, then with further ones, so
that groups of near copies grow together.  The sets of buckets that
still hold several components are joined by prefixes, which is exact: of two sets
of similarity t, in any order of all shingles, the first ``n - o + 1`` shingles of
each share one, where o is the overlap that t demands of their sizes.  The order is
by how many of these sets have a shingle, rare ones first, so what unlike texts
share, such as a passage, is in no prefix and brings no pairs about.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.llm.simhash import majority, trie_links
from pointloom.operators.graph import connected_components
from pointloom.plans.joins import broadcast_if_small, join_heavy
from pointloom.plans.scratch import Leftovers, drop, written

SEED = 42
BANDS, ROWS = 55, 7
#: Bits in which the fingerprints of candidates differ at most.
RADIUS = 4
#: How often the sets of a bucket are held against another one of it before prefixes are joined.
STARS = 3
#: Sizes whose prefixes are joined under one key lie within this factor.
SIZE_STEP = 1.05
FACTORS = np.random.default_rng(SEED).integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _joined(columns) -> np.ndarray:
    """One hash of several columns of hashes."""
    found = np.zeros_like(columns[0])
    for x in columns:
        found = found * np.uint64(BASE) + x
    return _mixed(found)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted hashes of the distinct runs of ``width`` words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter((xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    span = min(width, len(words))
    count = len(words) - span + 1
    return np.unique(_joined([hashes[k : k + count] for k in range(span)]))


def set_hash(shingles: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(shingles.tobytes(), SEED)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A hash of the least values of each band's rows; none for the empty set."""
    if not len(shingles):
        return np.zeros(0, np.uint64)
    least = np.full(len(FACTORS), 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 1 << 12):  # bounded memory for very long texts
        part = FACTORS[:, None] * shingles[None, at : at + (1 << 12)]
        least = np.minimum(least, part.min(axis=1))
    rows = least.reshape(BANDS, ROWS)
    return _joined([np.arange(BANDS, dtype=np.uint64), *rows.T])


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def with_bands(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, _hash, sig, n, fp, bands): a hash of the text, one of its set, the set's size, fingerprint and band keys."""
    fields = [
        docs.schema[id_col],
        T.StructField("_hash", T.LongType()),
        T.StructField("sig", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("fp", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]

    def prints(batches):
        for batch in batches:
            sigs, sizes, fps, bands = [], [], [], []
            for t in batch.column(2):
                found = shingle_set(t.as_py(), width)
                sigs.append(set_hash(found))
                sizes.append(len(found))
                fps.append(majority(found))
                bands.append(band_keys(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), _longs(sigs), pa.array(sizes, pa.int64()), _longs(fps), _lists(bands)],
                [f.name for f in fields],
            )

    rows = docs.select(id_col, F.xxhash64(text_col).alias("_hash"), text_col)
    return rows.mapInArrow(prints, T.StructType(fields))


def _sets(docs: DataFrame, least: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(sig, shingles) of the texts that ``least`` (_least) names."""

    def shingles(batches):
        for batch in batches:
            found = [shingle_set(t.as_py(), width) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([_longs([set_hash(x) for x in found]), _lists(found)], ["sig", "shingles"])

    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text"))
    wanted = least.select(F.col("_least.id").alias("_of"), F.col("_least.hash").alias("_named"))
    same = F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_hash") == F.col("_named"))
    # ids and hashes of the candidates only; beyond the bounds of a broadcast they are shuffled with the texts
    texts = rows.join(broadcast_if_small(wanted, 200_000), same, "left_semi").select("_text")
    made = texts.mapInArrow(shingles, "sig long, shingles array<long>")
    return made.groupBy("sig").agg(F.first("shingles").alias("shingles"))


def similar_links(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (src, dst) whose exact similarity reaches the threshold."""
    a = sets.select(F.col("sig").alias("src"), F.col("shingles").alias("_a"))
    b = sets.select(F.col("sig").alias("dst"), F.col("shingles").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b"))
    held = pairs.join(a, "src").join(b, "dst").select("src", "dst", F.size("_a").alias("n"), F.size("_b").alias("m"), both.alias("both"))
    return held.where(F.col("both") / (F.col("n") + F.col("m") - F.col("both")) >= similarity).select("src", "dst")


def simhash_pairs(sets: DataFrame, similarity: float, radius: int = RADIUS) -> DataFrame:
    """(src, dst) of sets (sig, n, fp) by their fingerprints: links of the trie walk, and each set with the least one of its fingerprint.

    Pairs that cannot reach the similarity by their sizes are left out.
    """
    heads = written(sets.groupBy("fp").agg(F.min(F.struct("sig", "n")).alias("head"), F.count("*").alias("_sets")), "heads")
    end = lambda name: heads.select(F.col("fp").alias(name), F.col("head").alias(f"_{name}"))
    across = trie_links(heads.select("fp"), radius).join(end("src"), "src").join(end("dst"), "dst").select("_src", "_dst")
    shared = heads.where("_sets > 1")
    within = join_heavy(sets, shared, "fp", "_sets").where(F.col("sig") != F.col("head.sig"))
    pairs = across.unionByName(within.select(F.col("head").alias("_src"), F.struct("sig", "n").alias("_dst")))
    fits = F.least("_src.n", "_dst.n") >= similarity * F.greatest("_src.n", "_dst.n") - 1e-6
    return pairs.where(fits).select(F.least("_src.sig", "_dst.sig").alias("src"), F.greatest("_src.sig", "_dst.sig").alias("dst"))


def _classed(buckets: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of buckets with the component of each set, its own hash if it has no link."""
    named_by = connected_components(links).withColumnRenamed("node", "sig")
    return written(buckets.join(named_by, "sig", "left").select("key", "sig", "n", F.coalesce("component", "sig").alias("_class")), "classed")


def _star_pairs(open_: DataFrame, turn: int, fits: Column) -> DataFrame:
    """(src, dst): each set with one of its bucket, another one each turn, if that is in another component."""
    chance = F.xxhash64("sig", F.lit(turn))
    centre = open_.groupBy("key").agg(F.min_by(F.struct("sig", "n", "_class"), chance).alias("c"))
    met = open_.join(centre, "key").select("sig", "n", "_class", F.col("c.sig").alias("_sig"), F.col("c.n").alias("_n"), F.col("c._class").alias("_other"))
    far = met.where((F.col("_class") != F.col("_other")) & fits)
    return far.select(F.least("sig", "_sig").alias("src"), F.greatest("sig", "_sig").alias("dst")).distinct()


def _unsettled(classed: DataFrame) -> DataFrame:
    """The rows of buckets (key) with sets of different components (_class)."""
    mixed = classed.groupBy("key").agg(F.min("_class").alias("_x"), F.max("_class").alias("_y"))
    return classed.join(mixed.where("_x <> _y").select("key"), "key")


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(key, sig, n, at, band, low, _class): the shingles of each set's prefixes, for each class of partners' sizes.

    ``key`` names the shingle and both classes of sizes (``low`` is the smaller),
    ``at`` how many rarer shingles the set has.
    """
    tokens = sets.select("sig", F.size("shingles").alias("n"), "_class", F.explode("shingles").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("df"))
    first = F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1  # with the smallest partner
    ordered = (
        tokens.join(shared, "token").groupBy("sig", "n", "_class")
        .agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
        .select("sig", "n", "_class", F.posexplode(F.slice("t", F.lit(1), first.cast("int"))).alias("at", "t"))
    )
    step = math.log(SIZE_STEP)
    reach = math.ceil(-math.log(similarity) / step)
    band = F.floor(F.log(F.col("n").cast("double")) / step).cast("int")
    rows = ordered.where("t.df > 1").select("sig", "n", "_class", "at", F.col("t.token").alias("token"), band.alias("band"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.col("band") - reach, F.col("band") + reach)))
    least = F.greatest(F.floor(0.999 * F.pow(F.lit(SIZE_STEP), F.col("other"))), F.ceil(similarity * F.col("n") - 1e-9))
    rows = rows.where(F.col("at") <= F.col("n") - _overlap(F.col("n"), least, similarity))
    low, high = F.least("band", "other"), F.greatest("band", "other")
    return rows.select(F.xxhash64("token", low, high).alias("key"), "sig", "n", "at", "band", low.alias("low"), (low == high).alias("one"), "_class")


def _overlap(n: Column, m: Column, similarity: float) -> Column:
    """How many shingles sets of sizes n and m must share."""
    return F.ceil(similarity / (1 + similarity) * (n + m) - 1e-9)


def _prefix_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """(src, dst) of sets of different components that a shingle of their prefixes brings together.

    A key's most frequent component meets the others, and these all others, so sets
    of one great component do not meet each other.
    """
    rows = written(_prefixes(sets, similarity), "prefixes")
    classes = rows.groupBy("key", "_class").agg(F.count("*").alias("_m"))
    mixed = classes.groupBy("key").agg(F.count("*").alias("_c"), F.max_by("_class", F.struct("_m", "_class")).alias("_major")).where("_c > 1")
    rows = written(rows.join(mixed.select("key", "_major"), "key"), "prefixes")
    left = rows.where("_class <> _major").drop("_major")
    right = rows.select("key", *[F.col(c).alias(f"o_{c}") for c in ("sig", "n", "at", "band", "_class")])
    # keys of two classes of sizes bring sets of either together
    sides = F.col("one") | (F.col("band") != F.col("o_band"))
    need = _overlap(F.col("n"), F.col("o_n"), similarity)
    near = (F.col("n") - F.col("at") >= need) & (F.col("o_n") - F.col("o_at") >= need)
    met = left.join(right, "key").where((F.col("_class") != F.col("o__class")) & sides & near)
    return met.select(F.least("sig", "o_sig").alias("src"), F.greatest("sig", "o_sig").alias("dst")).distinct()


def components(
    docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float
) -> tuple[DataFrame, DataFrame]:
    """All rows as (id, _hash, sig, ...), and (sig, component_size, _first) of each distinct set.

    ``_first`` names one row of the component: the smallest id, null ids last,
    then the smallest hash of the text.  Both are written tables; all others that
    were written on the way are deleted.
    """
    with Leftovers() as scratch:
        prints, named = _components(docs, id_col, text_col, width, similarity)
    scratch.release(prints, named)
    return prints, named


def _components(
    docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float
) -> tuple[DataFrame, DataFrame]:
    prints = written(with_bands(docs, id_col, text_col, width), "prints")
    row = F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), F.col("_hash").alias("hash"))
    distinct = written(
        prints.groupBy("sig").agg(
            F.min(row).alias("_least"), F.count("*").alias("_rows"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")
        ),
        "sets",
    )
    near = written(simhash_pairs(distinct.select("sig", "n", "fp"), similarity), "near")
    keyed = distinct.select("sig", "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("_m")).where("_m > 1").drop("_m")
    buckets = written(keyed.join(shared, "key"), "buckets")
    fits = F.least("n", "_n") >= similarity * F.greatest("n", "_n") - 1e-6
    named = buckets.select("sig").union(near.select("src")).union(near.select("dst")).distinct()
    sets = written(_sets(docs, distinct.join(named, "sig", "left_semi"), id_col, text_col, width), "shingles")
    links = written(similar_links(sets, near, similarity), "links")
    classed = _classed(buckets, links)
    for k in range(STARS):
        again = _star_pairs(_unsettled(classed), k, fits)
        links = written(links.union(similar_links(sets, again, similarity)), "links")
        classed = _classed(buckets, links)
    open_ = written(_unsettled(classed).select("sig", "_class").distinct(), "open")
    pairs = _prefix_pairs(sets.join(open_, "sig"), similarity)
    more = written(similar_links(sets, pairs, similarity), "links")
    parts = connected_components(links.union(more))
    classes = written(
        distinct.join(parts.withColumnRenamed("node", "sig"), "sig", "left").select(
            "sig", "_least", "_rows", F.coalesce("component", "sig").alias("_class")
        ),
        "classes",
    )
    least = classes.groupBy("_class").agg(
        F.min("_least").alias("_first"), F.sum("_rows").alias("component_size"), F.count("*").alias("_sets")
    )
    named = join_heavy(classes.select("sig", "_rows", "_class"), written(least, "least"), "_class", "_sets")
    return prints, written(named.select("sig", "_rows", "component_size", "_first"), "named")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8
) -> DataFrame:
    """(id, component_id, component_size) of every row of ``docs``.

    A-Z is lower-cased; words are split at ASCII white space.  Cases: null and
    wordless texts have the empty set and are linked to each other only; fewer than
    ``width`` words are one shingle; ``component_id`` is the smallest id reachable;
    an empty table gives an empty result; other columns are not read.
    """
    prints, classes = components(docs, id_col, text_col, width, similarity)
    return join_heavy(prints, classes, "sig", "_rows").select(id_col, F.col("_first.id").alias("component_id"), "component_size")


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8
) -> DataFrame:
    """The rows of ``docs``, all columns, of which one of each component stays.

    It is the row with the smallest id; among rows with that id, or where all ids
    are null, the one with the smallest hash of the text.  Of repeated rows one stays.
    """
    prints, classes = components(docs, id_col, text_col, width, similarity)
    kept = classes.select(F.col("_first.id").alias("_kept"), F.col("_first.hash").alias("_of")).distinct()
    copies = prints.groupBy(F.col(id_col).alias("_kept"), F.col("_hash").alias("_of")).agg(F.count("*").alias("_copies"))
    same = F.col("a._kept").eqNullSafe(F.col("b._kept")) & (F.col("a._of") == F.col("b._of"))
    kept = written(kept.alias("a").join(copies.alias("b"), same).select("a._kept", "a._of", "_copies"), "kept")
    drop(prints)
    rows = docs.select(
        F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash")
    )
    there = F.col("_id").eqNullSafe(F.col("_kept")) & (F.col("_hash") == F.col("_of"))
    out = rows.join(kept.where("_copies = 1"), there, "left_semi")
    repeated = kept.where("_copies > 1")
    if not repeated.isEmpty():
        out = out.unionByName(rows.join(repeated, there, "left_semi").dropDuplicates(["_id", "_hash"]))
    return out.select("_row.*")
