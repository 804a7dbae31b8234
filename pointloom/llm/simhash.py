"""Near-duplicate documents by SimHash and a binary trie self-join.

Every document gets a 64-bit fingerprint of its word shingles.  Equal
fingerprints are merged first, so copies cost one row.  Fingerprints within
``radius`` differing bits are then linked by walking binary tries: a node is a
run of fingerprints with a common prefix, pairs of nodes are walked down
together, the bits in which they differ are counted, and a pair is dropped as
soon as the count exceeds the radius.

One trie of all fingerprints is useless near its root, where no pair can be
dropped yet, so the walk is spread over many: the 64 bits are ``radius + 2``
blocks or more, and a pair within the radius agrees in all blocks but ``radius``
of them.  For each choice of so many blocks, fingerprints that agree in them are
one small trie; Spark deals the tries to tasks and numpy walks all tries of a
batch together.  A trie that got too many fingerprints is dealt again by choices
of other blocks.  Only a spanning set of links leaves a task.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.operators.graph import connected_components
from pointloom.plans.joins import join_heavy
from pointloom.plans.scratch import Leftovers, written

BITS = 64
SEED = 42
SIGN = np.uint64(1 << 63)
#: How often fingerprints are dealt to tries: once, and again where there are too many.
LEVELS = 3
#: Node pairs that move down a trie at a time, and rows that are walked together.
AT_ONCE = 1 << 16
GATHERED = 1 << 17


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of one text: the majority bits of its shingles' XXH64 hashes."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    count = max(1, len(words) - width + 1)
    if count == 1:
        hashes = np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = map(slice, starts[:count].tolist(), ends[width - 1 :].tolist())
        hashes = np.fromiter(
            (xxh64_intdigest(line[s], SEED) for s in spans), np.uint64, count
        )
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    count = len(hashes)
    set_bits = np.zeros(BITS, np.int64)
    for at in range(0, count, 1 << 16):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > count).tobytes(), "big")


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, _hash, fp): a hash of the text and the fingerprint as a signed 64-bit integer."""
    fields = [
        docs.schema[id_col],
        T.StructField("_hash", T.LongType()),
        T.StructField("fp", T.LongType()),
    ]

    def prints(batches):
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), width) for t in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(values.view(np.int64))],
                [f.name for f in fields],
            )

    rows = docs.select(id_col, F.xxhash64(text_col).alias("_hash"), text_col)
    return rows.mapInArrow(prints, T.StructType(fields))


def block_masks(level: int, blocks: int, radius: int) -> list[int]:
    """For each choice of ``blocks - radius`` blocks: the bits in them.

    Two fingerprints that differ in ``radius`` bits agree in one choice at least.
    Blocks are runs of the 64 bits, taken in another order on each level.
    """
    stride = (1, 27, 11)[level]
    order = [b * stride % BITS for b in range(BITS)]
    edges = [round(k * BITS / blocks) for k in range(blocks + 1)]
    parts = [sum(1 << b for b in order[edges[k] : edges[k + 1]]) for k in range(blocks)]
    return [sum(chosen) for chosen in combinations(parts, blocks - radius)]


def blocks_for(fingerprints: int, radius: int) -> int:
    """So many blocks that a choice of them, taken as a key, holds few fingerprints."""
    blocks = radius + 2
    while BITS * (blocks - radius) / blocks < math.log2(max(fingerprints, 2)) - 2 and blocks < radius + 6:
        blocks += 1
    return blocks


class Links:
    """Which values are connected (each named by the smallest place) and the links that connect them."""

    def __init__(self, n: int):
        self.name = np.arange(n)
        self.found: list[np.ndarray] = []
        self._changes: np.ndarray | None = None

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        a, b = self.name[x], self.name[y]
        low, high = np.minimum(a, b), np.maximum(a, b)
        new = np.flatnonzero(low < high)
        if not len(new):
            return
        _, once = np.unique(low[new] * len(self.name) + high[new], return_index=True)
        new = new[once]
        self.found.append(np.stack([x[new], y[new]], axis=1))
        low, high = low[new], high[new]
        while len(low):
            np.minimum.at(self.name, high, low)
            while (higher := self.name[self.name]).tobytes() != self.name.tobytes():
                self.name = higher
            a, b = self.name[low], self.name[high]
            low, high = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
        self._changes = None

    def connected(self, lo, hi, lo2, hi2) -> np.ndarray:
        """Whether the values of both runs are all connected."""
        if not self.found:
            return np.zeros(len(lo), bool)
        if self._changes is None:
            self._changes = np.concatenate([[0], np.cumsum(self.name[1:] != self.name[:-1])])
        c = self._changes
        return (c[hi - 1] == c[lo]) & (c[hi2 - 1] == c[lo2]) & (self.name[lo] == self.name[lo2])


def _divided(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """The place in each run [lo, hi) from which on ``bit`` is set."""
    lo, hi = lo.copy(), hi.copy()
    one = np.uint64(1 << bit)
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        ones = (values[np.minimum(mid, len(values) - 1)] & one) > 0
        hi = np.where(open_ & ones, mid, hi)
        lo = np.where(open_ & ~ones, mid + 1, lo)
    return lo


def _members(lo: np.ndarray, hi: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place of the runs [lo, hi), beside the run's entry in ``of``."""
    size = hi - lo
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(lo, size) + place, np.repeat(of, size)


def walk_tries(values: np.ndarray, starts: np.ndarray, radius: int, at_once: int = AT_ONCE) -> np.ndarray:
    """Places of links that connect what each group of ``values`` links within ``radius`` bits.

    ``values`` are unsigned, sorted and distinct within groups, whose bounds are
    ``starts`` (and the end).  Each group is a binary trie; a node is a run of
    values that agree in all bits above ``bit``.  Pairs of nodes of all tries walk
    down together, bit by bit, and count the bits in which they differ; a pair is
    dropped once they exceed the radius or once its values are connected.  Pairs
    wait on a stack, at most ``at_once`` move at a time, and a node's pair with
    itself goes first, so links within subtrees are known before those across.
    """
    links = Links(len(values))
    lo, hi = starts[:-1], starts[1:]
    stack = [(BITS - 1, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while stack:
        bit, *pairs = stack.pop()
        if len(pairs[0]) > at_once:
            stack.append((bit, *(x[at_once:] for x in pairs)))
            pairs = [x[:at_once] for x in pairs]
        lo, hi, lo2, hi2, differ = pairs
        same = lo == lo2
        left = ~(same & (hi - lo < 2)) & ~links.connected(lo, hi, lo2, hi2)
        lo, hi, lo2, hi2, differ, same = (x[left] for x in (lo, hi, lo2, hi2, differ, same))
        # leaves: two values are compared; whatever the other bits are, these differ in few enough
        leaf = ~same & (hi - lo == 1) & (hi2 - lo2 == 1)
        near = np.bitwise_count(values[lo[leaf]] ^ values[lo2[leaf]]) <= radius
        links.add(lo[leaf][near], lo2[leaf][near])
        whole = ~leaf & (differ + bit + 1 <= radius)
        links.add(*_members(lo[whole], hi[whole], lo2[whole]))
        links.add(*_members(lo2[whole], hi2[whole], lo[whole]))
        down = ~leaf & ~whole
        lo, hi, lo2, hi2, differ, same = (x[down] for x in (lo, hi, lo2, hi2, differ, same))
        if not len(lo):
            continue
        mid, mid2 = _divided(values, lo, hi, bit), _divided(values, lo2, hi2, bit)
        cross = ~same
        children = [  # both halves with themselves or their like; one with the other
            (lo, mid, lo2, mid2, differ, np.ones(len(lo), bool)),
            (mid, hi, mid2, hi2, differ, np.ones(len(lo), bool)),
            (lo, mid, mid2, hi2, differ + 1, differ < radius),
            (mid, hi, lo2, mid2, differ + 1, cross & (differ < radius)),
        ]
        kept = [(a < b) & (c < d) & may for a, b, c, d, _, may in children]
        parts = [[x[k] for x in child[:5]] for child, k in zip(children, kept, strict=True)]
        both = [np.concatenate(x) for x in zip(*parts, strict=True)]
        itself = both[0] == both[2]
        for chosen in (~itself, itself):  # the stack gives the last first
            if chosen.any():
                stack.append((bit - 1, *(x[chosen] for x in both)))
    return np.concatenate([np.zeros((0, 2), np.int64), *links.found])


def trie_links(
    prints: DataFrame, radius: int, blocks: int | None = None, most_in_key: int = 1 << 14
) -> DataFrame:
    """(src, dst): links that connect the distinct fingerprints ``fp`` within ``radius`` bits.

    A key with more than ``most_in_key`` fingerprints is not walked: its
    fingerprints are dealt again by choices of other blocks, twice at most.
    """
    blocks = blocks or blocks_for(prints.count(), radius)
    if not radius < blocks:
        raise ValueError("there must be more blocks than differing bits")
    waiting = prints.select("fp", F.lit(0).cast("long").alias("key"))
    tables = []
    for level in range(LEVELS):
        keys = [
            F.xxhash64("key", F.lit(k), F.col("fp").bitwiseAND(F.lit(mask - (mask >> 63 << 64))))
            for k, mask in enumerate(block_masks(level, blocks, radius))
        ]
        dealt = waiting.select("fp", F.explode(F.array(*keys)).alias("key"))
        most = most_in_key if level + 1 < LEVELS else None
        walk = _walker(radius, most)
        found = written(
            dealt.repartition("key").sortWithinPartitions("key", "fp").select("key", "fp")
            .mapInArrow(walk, "key long, src long, dst long"),
            "links",
        )
        tables.append(found.where("dst is not null").select("src", "dst"))
        waiting = found.where("dst is null").select(F.col("src").alias("fp"), "key")
        if waiting.isEmpty():
            break
    return reduce(DataFrame.union, tables).distinct()


def _walker(radius: int, most: int | None):
    """Reads (key, fp) in order and yields links; keys of more than ``most`` fingerprints come back as they are."""

    def rows(key, src, dst):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(src), dst], ["key", "src", "dst"])

    def walked(key: np.ndarray, fp: np.ndarray):
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        found = walk_tries(fp.view(np.uint64) ^ SIGN, starts, radius)
        if len(found):
            yield rows(key[found[:, 0]], fp[found[:, 0]], pa.array(fp[found[:, 1]]))

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count, passing = 0, None
        for batch in batches:
            key, fp = (batch.column(k).to_numpy() for k in range(2))
            if passing is not None and len(key):  # the rest of a key that is dealt again
                more = int(np.searchsorted(key, passing, side="right"))
                if more:
                    yield rows(key[:more], fp[:more], pa.nulls(more, pa.int64()))
                key, fp = key[more:], fp[more:]
                passing = passing if not len(key) else None
            held.append((key, fp))
            count += len(key)
            if count < GATHERED:
                continue
            key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            last = int(np.searchsorted(key, key[-1]))
            done, rest = _few(key[:last], most)
            yield from walked(key[:last][done], fp[:last][done])
            if len(rest):
                yield rows(key[rest], fp[rest], pa.nulls(len(rest), pa.int64()))
            if most is not None and count - last > most:
                yield rows(key[last:], fp[last:], pa.nulls(count - last, pa.int64()))
                passing, last = key[-1], count
            held, count = [(key[last:], fp[last:])], count - last
        if count:
            key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            done, rest = _few(key, most)
            yield from walked(key[done], fp[done])
            if len(rest):
                yield rows(key[rest], fp[rest], pa.nulls(len(rest), pa.int64()))

    return run


def _few(key: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys with 2 to ``most`` rows, and of those with more; single rows have no links."""
    _, of, size = np.unique(key, return_inverse=True, return_counts=True)
    size = size[of]
    many = size > (most if most is not None else len(key))
    return np.flatnonzero((size > 1) & ~many), np.flatnonzero(many)


def classify(
    docs: DataFrame, id_col: str, text_col: str, width: int, radius: int
) -> tuple[DataFrame, DataFrame]:
    """All rows as (id, _hash, fp), and (fp, _rows, component_size, _first) of each distinct fingerprint.

    ``_first`` names one row of the component: the smallest id, null ids last,
    then the smallest hash of the text.  Both are written tables; all others that
    were written on the way are deleted.
    """
    with Leftovers() as scratch:
        prints, named = _classified(docs, id_col, text_col, width, radius)
    scratch.release(prints, named)
    return prints, named


def _classified(
    docs: DataFrame, id_col: str, text_col: str, width: int, radius: int
) -> tuple[DataFrame, DataFrame]:
    prints = written(with_fingerprints(docs, id_col, text_col, width), "prints")
    row = F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), F.col("_hash").alias("hash"))
    distinct = written(prints.groupBy("fp").agg(F.min(row).alias("_least"), F.count("*").alias("_rows")), "distinct")
    parts = connected_components(trie_links(distinct.select("fp"), radius))
    classes = written(
        distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "_least", "_rows", F.coalesce("component", "fp").alias("_class")
        ),
        "classes",
    )
    least = written(
        classes.groupBy("_class").agg(
            F.min("_least").alias("_first"), F.sum("_rows").alias("component_size"), F.count("*").alias("_fps")
        ),
        "least",
    )
    named = join_heavy(classes.select("fp", "_rows", "_class"), least, "_class", "_fps")
    return prints, written(named.select("fp", "_rows", "component_size", "_first"), "named")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4
) -> DataFrame:
    """(id, fingerprint, component_id, component_size) of every row of ``docs``.

    Texts are whole; A-Z is lower-cased; words are split at ASCII white space.
    Cases: a null or wordless text has fingerprint zero and is linked like any
    other; fewer than ``width`` words are one shingle; equal texts and repeated
    rows share a component; ``component_id`` is the smallest id reachable, null
    ids aside; an empty table gives an empty result; other columns are not read.
    """
    prints, classes = classify(docs, id_col, text_col, width, radius)
    return join_heavy(prints, classes, "fp", "_rows").select(
        id_col,
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("_first.id").alias("component_id"),
        "component_size",
    )


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4
) -> DataFrame:
    """The rows of ``docs``, all columns, of which one of each component stays.

    It is the row with the smallest id; among rows with that id, or where all ids
    are null, the one with the smallest hash of the text.  Of repeated rows one stays.
    """
    _, classes = classify(docs, id_col, text_col, width, radius)
    kept = classes.select(F.col("_first.id").alias("_kept"), F.col("_first.hash").alias("_of")).distinct()
    rows = docs.select(
        F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash")
    )
    same = F.col("_id").eqNullSafe(F.col("_kept")) & (F.col("_hash") == F.col("_of"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["_id", "_hash"]).select("_row.*")
