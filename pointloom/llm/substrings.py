"""Removing byte strings that a document with a smaller id also has, by suffix arrays.

Equal strings of ``width`` bytes are brought together by a key that depends on them
alone: the least hash of their runs of ``RUN`` bytes.  Neighbouring windows mostly
share it, so a text is cut into segments, each with the bytes of its windows.

1. Texts are written as blocks of bounded size.
2. A block's keys go to parts by hash; a part says which keys occur in more than
   one document.  Only their segments go on.
3. Segments go to shards by key, each distinct one once a block, with the least id
   of its documents.  Equal segments of several blocks become one.  Where a key
   has different segments, these are a shard's text: its suffix array is induced,
   the permuted common prefixes are computed, and suffixes that share ``width``
   bytes form a class, whose least id holds for each of its windows.
4. The least ids go back to the blocks, which remove what has a smaller id than
   the document at hand.

A key with more than ``most_segments`` segments sends its windows one by one, each
by its own hash, so no key fills a shard.

Cases: a null text is empty; texts shorter than ``width`` stay whole; null ids are
above all others, and equal ids remove nothing from each other (so neither do
repeated rows); a very long text is a block of its own, hashed in slices; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.llm.planes import compress, decompress, pack, unpack
from pointloom.llm.suffixes import permuted_prefixes, suffix_array
from pointloom.plans.scratch import written

RUN = 24
BASE = 0x9E3779B97F4A7C15
#: Bytes of a block, windows hashed at a time, bytes whose suffixes are sorted together.
BLOCK, SLICE, CHUNK = 2 << 20, 1 << 19, 1 << 19
#: Bytes of all blocks for one part, and of all segments for one shard.
PART, SHARD = 32 << 20, 16 << 20
UNNAMED = 2**63 - 1


@dataclass(frozen=True)
class SubstringParams:
    width: int = 50
    most_segments: int = 1 << 16


def text_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, ids, lengths, size, data): the texts of consecutive rows, one after the other."""
    names = ["block", "ids", "lengths", "size", "data"]
    kinds = [T.LongType(), T.ArrayType(docs.schema[id_col].dataType), T.ArrayType(T.LongType()), T.LongType(), T.BinaryType()]

    def gather(batches):
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def block():
            lists = [pa.array(ids, id_type), pa.array([len(t) for t in texts], pa.int64())]
            columns = [pa.array([number], pa.int64())]
            columns += [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), x) for x in lists]
            columns += [pa.array([size], pa.int64()), pa.array([compress(b"".join(texts))], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            id_type = batch.column(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                if ids and size + len(raw) > BLOCK:
                    yield block()
                    ids, texts, size, number = [], [], 0, number + 1
                ids.append(key)
                texts.append(raw)
                size += len(raw)
        if ids:
            yield block()

    fields = [T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]
    return docs.select(id_col, text_col).mapInArrow(gather, T.StructType(fields))


def run_hashes(codes: np.ndarray, run: int = RUN) -> np.ndarray:
    """A hash of each run of ``run`` bytes, by doubling."""
    part, span, factor = codes.astype(np.uint64) + np.uint64(1), 1, BASE
    whole, done = None, 0
    while True:
        if run & span:
            whole = part if whole is None else whole[: len(part) - done] * np.uint64(factor) + part[done:]
            done += span
        if 2 * span > run:
            break
        part = part[:-span] * np.uint64(factor) + part[span:]
        span, factor = 2 * span, factor * factor % 2**64
    whole = whole[: max(0, len(codes) - run + 1)]
    whole = (whole ^ (whole >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return whole ^ (whole >> np.uint64(31))


def window_keys(codes: np.ndarray, width: int) -> np.ndarray:
    """The key of each window of ``width`` bytes: the least hash inside."""
    least, span, wanted = run_hashes(codes), 1, width - RUN + 1
    while 2 * span <= wanted:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[: len(least) - (wanted - span)], least[wanted - span :]) if span < wanted else least


class Block:
    """A block's texts and the segments they are cut into."""

    def __init__(self, ids: list, lengths: np.ndarray, data: bytes, width: int):
        self.width = width
        self.raw = decompress(data)
        self.codes = np.frombuffer(self.raw, np.uint8)
        self.stops = np.cumsum(lengths)
        self.starts = self.stops - lengths
        self.ids = np.array([UNNAMED if i is None else i for i in ids], np.int64)

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(key, first window, end of windows, document) of each segment."""
        found = [[np.zeros(0, np.uint64)], *([np.zeros(0, np.int64)] for _ in range(3))]
        # a segment also ends where a document does and where its last window has begun
        breaks = np.sort(np.concatenate([self.starts, np.maximum(self.starts, self.stops - self.width + 1)]))
        for at in range(0, len(self.codes) - self.width + 1, SLICE):
            keys = window_keys(self.codes[at : at + SLICE + self.width - 1], self.width)
            new = np.ones(len(keys), bool)
            np.not_equal(keys[1:], keys[:-1], out=new[1:])
            inner = breaks[np.searchsorted(breaks, at) : np.searchsorted(breaks, at + len(keys))]
            new[inner - at] = True
            first = np.flatnonzero(new)
            end = np.append(first[1:], len(keys))
            doc = np.searchsorted(self.stops, first + at, "right")
            held = first + at + self.width <= self.stops[doc]
            first, end, doc = first[held], end[held], doc[held]
            for k, x in enumerate((keys[first], first + at, end + at, doc)):
                found[k].append(x)
        return tuple(np.concatenate(x) for x in found)

    def cut(self, known: np.ndarray, crowded: np.ndarray):
        """The segments with a key in ``known``; those of ``crowded`` keys window by window.

        Returns the bytes, key and least id of the distinct ones, in a fixed order, and
        of each one cut its place in that order, first window, windows and document.
        """
        from xxhash import xxh64_intdigest

        key, first, end, doc = self.segments()
        held = np.flatnonzero(_among(key, known))
        apart = held[_among(key[held], crowded)]
        whole = held[~_among(key[held], crowded)]
        times = end[apart] - first[apart]
        single = np.repeat(first[apart] - np.cumsum(times) + times, times) + np.arange(times.sum())
        firsts = np.concatenate([first[whole], single])
        ends = np.concatenate([end[whole], single + 1])
        docs = np.concatenate([doc[whole], np.repeat(doc[apart], times)])
        own = np.fromiter((xxh64_intdigest(self.raw[s : s + self.width]) for s in single.tolist()), np.uint64, len(single))
        raw = self.raw
        cut = [raw[s:e] for s, e in zip(firsts.tolist(), (ends + self.width - 1).tolist(), strict=True)]
        contents, at, least, sample = _merged(cut, self.ids[docs])
        return contents, np.concatenate([key[whole], own])[sample], least, at, firsts, ends - firsts, docs


def _merged(contents: list[bytes], ids: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The distinct contents; of each one given its place among them; of each distinct one its least id and where it is first."""
    place = {c: k for k, c in enumerate(dict.fromkeys(contents))}
    at = np.fromiter(map(place.__getitem__, contents), np.int64, len(contents))
    least = np.full(len(place), UNNAMED)
    np.minimum.at(least, at, ids)
    sample = np.empty(len(place), np.int64)
    sample[at[::-1]] = np.arange(len(at))[::-1]
    return list(place), at, least, sample


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _blocks(batch: pa.RecordBatch, width: int):
    columns = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
    for k in range(batch.num_rows):
        lengths = columns["lengths"][k].values.to_numpy()
        yield k, columns, Block(columns["ids"][k].as_py(), lengths, columns["data"][k].as_py(), width)


def block_keys(blocks: DataFrame, parts: int, width: int) -> DataFrame:
    """(part, block, keys, times, shared): a block's keys, how often each occurs, and if in several documents."""
    names = ["part", "block", "keys", "times", "shared"]

    def find(batches):
        for batch in batches:
            for k, columns, block in _blocks(batch, width):
                key, _, _, doc = block.segments()
                if not len(key):
                    continue
                part = (key % np.uint64(parts)).astype(np.int64)
                order = np.lexsort((key, part))
                key, part, ids = key[order], part[order], block.ids[doc[order]]
                at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                shared = np.minimum.reduceat(ids, at) != np.maximum.reduceat(ids, at)
                times = np.minimum(np.diff(at, append=len(key)), 2**32 - 1).astype("<u4")
                key, part = key[at], part[at]
                cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                rows = list(zip(cuts, np.append(cuts[1:], len(part)), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part[cuts]),
                        pa.array([columns["block"][k].as_py()] * len(rows), pa.int64()),
                        pa.array([pack(key[i:j]) for i, j in rows], pa.binary()),
                        pa.array([pack(times[i:j]) for i, j in rows], pa.binary()),
                        pa.array([np.packbits(shared[i:j]).tobytes() for i, j in rows], pa.binary()),
                    ],
                    names,
                )

    return blocks.mapInArrow(find, "part long, block long, keys binary, times binary, shared binary")


def _by_group(batches, names: list[str]):
    """(group, rows) of a stream that is sorted by its first column."""
    held, group = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != group:
                if held:
                    yield group, held
                held, group = [], row[0]
            held.append(dict(zip(names, row, strict=True)))
    if held:
        yield group, held


def shared_keys(keys: DataFrame, parts: int, most: int) -> DataFrame:
    """(block, keys, crowded, n): a block's keys that several documents have, and their segments."""
    names = keys.columns

    def judge(batches):
        for _, rows in _by_group(batches, names):
            each = [unpack(r["keys"], "<u8") for r in rows]
            times = np.concatenate([unpack(r["times"]) for r in rows]).astype(np.int64)
            several = np.concatenate([np.unpackbits(np.frombuffer(r["shared"], np.uint8))[: len(x)] for r, x in zip(rows, each, strict=True)])
            _, at, count = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
            total = np.bincount(at, times)
            good = (count[at] > 1) | (np.bincount(at, several)[at] > 0)
            crowded = good & (total[at] > most)
            stop = 0
            out = [[], [], [], []]
            for r, x in zip(rows, each, strict=True):
                start, stop = stop, stop + len(x)
                held = good[start:stop]
                if held.any():
                    out[0].append(r["block"])
                    out[1].append(pack(x[held]))
                    out[2].append(pack(x[crowded[start:stop]]))
                    out[3].append(int(times[start:stop][held].sum()))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["block", "keys", "crowded", "n"])

    dealt = keys.repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(judge, "block long, keys binary, crowded binary, n long")


def _known(found: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    rows = found.as_py() or []
    empty = [np.zeros(0, np.uint64)]
    return tuple(np.sort(np.concatenate(empty + [unpack(r[n], "<u8") for r in rows])) for n in ("keys", "crowded"))


def _shards(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys % np.uint64(shards)).astype(np.int64)


def segment_rows(marked: DataFrame, shards: int, width: int) -> DataFrame:
    """(shard, block, keys, lengths, least, data): the distinct segments of a block for one shard."""

    def cut(batches):
        for batch in batches:
            for k, columns, block in _blocks(batch, width):
                contents, keys, least, *_ = block.cut(*_known(columns["known"][k]))
                if not contents:
                    continue
                shard = _shards(keys, shards)
                lengths = np.array([len(c) for c in contents], "<u4")
                order = np.argsort(shard, kind="stable")
                cuts = np.flatnonzero(np.append(True, np.diff(shard[order]) != 0))
                groups = np.split(order, cuts[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard[[g[0] for g in groups]]),
                        pa.array([columns["block"][k].as_py()] * len(groups), pa.int64()),
                        pa.array([pack(keys[g]) for g in groups], pa.binary()),
                        pa.array([pack(lengths[g]) for g in groups], pa.binary()),
                        pa.array([pack(least[g]) for g in groups], pa.binary()),
                        pa.array([compress(b"".join([contents[i] for i in g])) for g in groups], pa.binary()),
                    ],
                    ["shard", "block", "keys", "lengths", "least", "data"],
                )

    return marked.mapInArrow(cut, "shard long, block long, keys binary, lengths binary, least binary, data binary")


def least_of_windows(contents: list[bytes], least: np.ndarray, width: int) -> list[np.ndarray]:
    """For each window of each segment, the least id of all segments that hold its bytes."""
    raw = np.frombuffer(b"".join([c + b"\0" for c in contents]), np.uint8)
    lengths = np.array([len(c) for c in contents])
    stops = np.cumsum(lengths + 1) - 1
    starts = stops - lengths
    codes = raw.astype(np.int64) + 1
    codes[stops] = 0
    of = np.repeat(np.arange(len(contents)), lengths + 1)
    reach = stops[of] - np.arange(len(raw))
    order = suffix_array(codes)
    shared = permuted_prefixes(raw, order, reach)[order]
    ids = np.where(reach >= width, least[of], UNNAMED)[order]
    first = np.flatnonzero(np.append(True, shared[1:] < width))
    best = np.empty(len(raw), np.int64)
    best[order] = np.repeat(np.minimum.reduceat(ids, first), np.diff(first, append=len(raw)))
    return [best[s : e - width + 1] for s, e in zip(starts, stops, strict=True)]


def shard_windows(rows: list[dict], width: int) -> list[tuple[int, np.ndarray]]:
    """(block, least id of each window of its segments, in their order) of one shard."""
    cut, where = [], []
    for r in rows:
        data, ends = decompress(r["data"]), np.cumsum(unpack(r["lengths"]).astype(np.int64))
        cut += [data[s:e] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        where.append(len(ends))
    contents, at, ids, sample = _merged(cut, np.concatenate([unpack(r["least"], "<i8") for r in rows]))
    keys = np.concatenate([unpack(r["keys"], "<u8") for r in rows])[sample]
    where = np.split(at, np.cumsum(where)[:-1])
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
    sizes = np.fromiter(map(len, contents), np.int64, len(contents)) - width + 1
    begin = np.cumsum(sizes) - sizes
    windows = np.repeat(ids, sizes)  # right where a key has one segment, with no other to be sorted among
    chunk, size = [], 0

    def sort_chunk():
        for place, found in zip(chunk, least_of_windows([contents[c] for c in chunk], ids[chunk], width), strict=True):
            windows[begin[place] : begin[place] + sizes[place]] = found

    stops = np.append(cuts[1:], len(order))
    for start, stop in zip(cuts[stops - cuts > 1].tolist(), stops[stops - cuts > 1].tolist(), strict=True):
        group = order[start:stop].tolist()
        own = sum(len(contents[c]) + 1 for c in group)
        if chunk and size + own > CHUNK:
            sort_chunk()
            chunk, size = [], 0
        chunk.extend(group)
        size += own
    if chunk:
        sort_chunk()
    out = []
    for r, own in zip(rows, where, strict=True):
        times = sizes[own]
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        out.append((r["block"], windows[np.repeat(begin[own], times) + step]))
    return out


def sorted_shards(segments: DataFrame, width: int) -> DataFrame:
    """(block, shard, at, least): for a block's windows in a shard, runs of equal least ids."""
    names = segments.columns

    def sort(batches):
        for shard, rows in _by_group(batches, names):
            out = [[], [], [], []]
            for block, found in shard_windows(rows, width):
                at = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
                for x, v in zip(out, (block, shard, pack(at.astype("<u4")), pack(found[at])), strict=True):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["block", "shard", "at", "least"])

    dealt = segments.repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(sort, "block long, shard long, at binary, least binary")


def _removed(block: Block, marked: pa.Scalar, found: pa.Scalar, shards: int) -> np.ndarray:
    """Which bytes of the block go."""
    width = block.width
    contents, keys, _, at, firsts, times, docs = block.cut(*_known(marked))
    starts = np.zeros(len(block.codes) + 1, np.int64)
    if contents:
        shard = _shards(keys, shards)
        sizes = np.fromiter(map(len, contents), np.int64, len(contents)) - width + 1
        begin = np.zeros(len(contents), np.int64)  # of each segment's windows in the order of shards
        order = np.argsort(shard, kind="stable")
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        least = np.empty(int(sizes.sum()), np.int64)
        ends = np.cumsum(np.bincount(shard, sizes, minlength=shards)).astype(np.int64)
        for r in found.as_py():
            stop = ends[r["shard"]]
            start = ends[r["shard"] - 1] if r["shard"] else 0
            runs = unpack(r["at"]).astype(np.int64)
            least[start:stop] = np.repeat(unpack(r["least"], "<i8"), np.diff(runs, append=stop - start))
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        ids = least[np.repeat(begin[at], times) + step]
        window = np.repeat(firsts, times) + step
        gone = window[ids < np.repeat(block.ids[docs], times)]
        starts[gone] += 1  # each window is in one segment
        starts[gone + width] -= 1
    return np.cumsum(starts[:-1]) > 0


def remove_repeats(
    docs: DataFrame, params: SubstringParams = SubstringParams(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of every row; ``kept`` are the bytes that stay."""
    spark, width = docs.sparkSession, params.width
    if width < 2 * RUN:
        raise ValueError(f"width must be at least {2 * RUN}")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = written(text_blocks(docs, id_col, text_col), "blocks")
    size = blocks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(least, size // PART)
    keys = block_keys(blocks.select("block", "ids", "lengths", "data"), parts, width)
    shared = written(shared_keys(keys, parts, params.most_segments), "keys")
    cut = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(least, cut * (width + RUN) // SHARD)
    known = shared.groupBy("block").agg(F.collect_list(F.struct("keys", "crowded")).alias("known"))
    marked = blocks.drop("size").join(known, "block")
    sorted_ = sorted_shards(segment_rows(marked, shards, width), width)
    found = sorted_.groupBy("block").agg(F.collect_list(F.struct("shard", "at", "least")).alias("found"))
    held = blocks.drop("size").join(known, "block", "left").join(found, "block", "left")
    kinds = [docs.schema[id_col].dataType, *[T.LongType()] * 3, T.BinaryType()]
    fields = [T.StructField(n, k) for n, k in zip((id_col, "n_bytes", "n_removed", "n_spans", "kept"), kinds, strict=True)]

    def finish(batches):
        for batch in batches:
            for k, columns, block in _blocks(batch, width):
                gone = _removed(block, columns["known"][k], columns["found"][k], shards)
                begins = np.flatnonzero(gone & ~np.append(False, gone[:-1]))
                # a run that goes on into the next document is a run of each
                inner = block.starts[(block.starts > 0) & (block.starts < block.stops)]
                begins = np.union1d(begins, inner[gone[inner]])
                spans = np.searchsorted(begins, block.stops) - np.searchsorted(begins, block.starts)
                total = np.append(0, np.cumsum(gone))
                removed = total[block.stops] - total[block.starts]
                kept = [
                    (block.codes[s:e][~gone[s:e]].tobytes() if r else block.raw[s:e])
                    for s, e, r in zip(block.starts.tolist(), block.stops.tolist(), removed.tolist(), strict=True)
                ]
                columns_out = [columns["ids"][k].values, pa.array(block.stops - block.starts), pa.array(removed), pa.array(spans), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns_out, [f.name for f in fields])

    return held.mapInArrow(finish, T.StructType(fields))


def digest(removed: DataFrame) -> DataFrame:
    """The results of :func:`remove_repeats` with a digest in place of the bytes."""
    return removed.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
