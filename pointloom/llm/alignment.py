"""Aligning two tokenizers' cuts of the same texts by a sweep over token ends.

A text with a space before it is cut by tokenizer A and by tokenizer B.  Each cut is a
series of events, one where a token ends; events go in runs, one row each, keyed
by document and by the offset of the run's first end.  The union of both series is
dealt out by document, sorted by offset within a partition and read as a stream.
The reader keeps a bounded buffer of events.  Where an A and a B token end
together a group ends; what is not ended yet is carried over.  Every distinct end
is one link, between the A and the B token that cover the bytes just before it.

The counts of linked id pairs need all documents, so the sweep writes blocks: the
results of its documents and their links by places in the block's own dictionary
of pairs.  Dictionaries are summed over all blocks and joined back to theirs.

Cases: null and empty texts, and texts that a tokenizer's bytes do not give back,
have no tokens, so zeros and an empty digest; strings of special tokens are plain
text; a long text's runs are many rows, only its ids are held whole while it is cut; rows
with equal id and text are swept once and returned as often as they occur; ids
may be null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.llm.planes import pack, unpack
from pointloom.llm.tokenize import PLAIN, byte_letters
from pointloom.plans.scratch import written

#: Fixed value: the pattern by which a byte-level file of this kind divides a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The settings under which ranks and PATTERN give the file's ids.
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
#: Ends in one event row, and ends that the sweep takes together.
RUN, BUFFER = 4096, 600_000
ZEROS = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0}


@dataclass(frozen=True)
class AlignParams:
    a_path: str
    b_path: str


class ByteTokenizer:
    """Ids of a byte-level file; ``pieces`` holds the bytes of each id.

    Plain texts are cut by ranks where the file's merges are its ids in order and
    its settings the known ones; all others by the file itself.  Both ways give
    the same ids; the tests compare them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            found = json.load(file)
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        byte_of = {letter: byte for byte, letter in enumerate(byte_letters())}
        special = {t["id"] for t in found["added_tokens"]}
        vocab = {token: i for token, i in found["model"]["vocab"].items() if i not in special}
        self.pieces = [b""] * (1 + max([*vocab.values(), *special]))
        for token, i in vocab.items():
            self.pieces[i] = bytes(byte_of[c] for c in token)
        self.plain = re.compile(PLAIN).fullmatch
        self.ranks = self._by_ranks(found, vocab)

    def _by_ranks(self, found: dict, vocab: dict[str, int]):
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in found["model"]["merges"]]
        pre = found["pre_tokenizer"] or {}
        known = all(pre.get(k) == v for k, v in PRE_TOKENIZER.items()) and pre.get("use_regex", True) and not found["normalizer"]
        if not known or [vocab.get(m) for m in merges] != list(range(256, 256 + len(merges))):
            return None
        import tiktoken

        ranks = {self.pieces[i]: i for i in vocab.values()}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, texts: list[str]) -> list[list[int]]:
        spaced = [f" {t}" for t in texts]
        if self.ranks is None:
            return [e.ids for e in self.whole.encode_batch(spaced, add_special_tokens=False)]
        return [
            self.ranks(t) if self.plain(t) else self.whole.encode(t, add_special_tokens=False).ids for t in spaced
        ]


class PieceTokenizer:
    """Ids of a piece model, which adds the space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.pieces.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


KINDS = {"a": ByteTokenizer, "b": PieceTokenizer}
_LOADED: dict[tuple[str, str], ByteTokenizer | PieceTokenizer] = {}


def _loaded(side: str, path: str):
    if (side, path) not in _LOADED:
        _LOADED[side, path] = KINDS[side](path)
    return _LOADED[side, path]


def end_events(docs: DataFrame, side: str, path: str, id_col: str, text_col: str) -> DataFrame:
    """Runs of token ends: (_id, _hash, _copies, _side, _first, ids).

    ``_first`` is where the run's first token ends.  A text without tokens is one
    row with -1 there.  Equal rows of one batch are one document with more copies.
    """
    kind = docs.schema[id_col].dataType
    names = ["_id", "_hash", "_copies", "_side", "_first", "ids"]
    fields = [
        T.StructField("_id", kind),
        T.StructField("_hash", T.LongType()),
        T.StructField("_copies", T.LongType()),
        T.StructField("_side", T.StringType()),
        T.StructField("_first", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]

    def cut(batches):
        tool = _loaded(side, path)
        piece = tool.pieces.__getitem__
        sizes = np.array([len(p) for p in tool.pieces])
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            copies: dict[tuple, int] = {}
            first_of: dict[tuple, int] = {}
            for row, key in enumerate(keys):
                copies[key] = copies.get(key, 0) + 1
                first_of.setdefault(key, row)
            rows = list(first_of.values())
            texts = [batch.column(2)[r].as_py() or "" for r in rows]
            out_row, out_first, out_ids = [], [], []
            for at in range(0, len(rows), 64):
                part = texts[at : at + 64]
                for row, text, ids in zip(rows[at : at + 64], part, tool.ids(part), strict=True):
                    if not text or b"".join(map(piece, ids)) != b" " + text.encode():
                        out_row.append(row)
                        out_first.append(-1)
                        out_ids.append(np.zeros(0, "<u4"))
                        continue
                    codes = np.array(ids, "<u4")
                    ends = np.cumsum(sizes[codes])
                    for k in range(0, len(codes), RUN):
                        out_row.append(row)
                        out_first.append(int(ends[k]))
                        out_ids.append(codes[k : k + RUN])
            where = pa.array(out_row, pa.int64())
            columns = [
                batch.column(0).take(where),
                batch.column(1).take(where),
                pa.array([copies[keys[r]] for r in out_row], pa.int64()),
                pa.array([side] * len(out_row), pa.string()),
                pa.array(out_first, pa.int64()),
                pa.array([pack(x) for x in out_ids], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(cut, T.StructType(fields))


class Sweep:
    """The machine that reads events in order of document and offset.

    It holds at most about ``BUFFER`` ends of complete documents, the tokens of
    the open one that no group has ended yet, and that document's digest.
    """

    def __init__(self, a_pieces: list[bytes], b_pieces: list[bytes]):
        self.sizes = {"a": np.array([len(p) for p in a_pieces]), "b": np.array([len(p) for p in b_pieces])}
        # a token's text in the digest: within its side, and where its side of a group ends
        self.shown = {}
        for side, ends in (("a", b"|"), ("b", b";")):
            ids = [b"%d" % i for i in range(len(self.sizes[side]))]
            self.shown[side] = np.array([x + b"," for x in ids] + [x + ends for x in ids], object)
        self.docs: list[dict] = []
        self.runs = {"a": [], "b": []}
        self.held = 0
        self.key = None

    def full(self, key: tuple, side: str, first: int) -> bool:
        """Whether a block is due before this row: enough is held, and all copies of the last row have come."""
        return self.held >= BUFFER and not (key == self.key and (side, first) in self.seen)

    def feed(self, key: tuple, copies: int, side: str, first: int, data: bytes) -> None:
        """Takes one event row."""
        if key != self.key:
            self.key, self.seen = key, {}
            self.docs.append({"key": key, "copies": 0, "sha": None, "bad": False, **ZEROS})
        doc = self.docs[-1]
        if (side, first) in self.seen:  # an equal row of another batch
            doc["copies"] += copies if side == "a" and first == self.seen["a"] else 0
            return
        if side not in self.seen:
            self.seen[side] = first
            doc["copies"] += copies if side == "a" else 0
        self.seen[side, first] = True
        if first < 0:
            doc["bad"] = True
        else:
            ids = unpack(data).astype(np.int64)
            self.runs[side].append((len(self.docs) - 1, ids))
            self.held += len(ids)

    def block(self, open_: bool) -> dict:
        """What the held events say of their documents; ``open_``: the last one goes on."""
        docs, bad = self.docs, [d["bad"] for d in self.docs]
        ids, doc, ends = {}, {}, {}
        for side in "ab":
            runs = [(d, x) for d, x in self.runs[side] if not bad[d]]
            ids[side] = np.concatenate([np.zeros(0, np.int64), *(x for _, x in runs)])
            doc[side] = np.repeat(np.array([d for d, _ in runs], np.int64), [len(x) for _, x in runs])
            ends[side] = np.cumsum(self.sizes[side][ids[side]])
        out = self._swept(ids, doc, ends)
        rows = []
        for k, d in enumerate(docs):
            last = open_ and k == len(docs) - 1
            done = {**ZEROS} if d["bad"] else {n: d[n] for n in ZEROS}
            sha = "" if last or d["bad"] or not d["n_groups"] else d["sha"].hexdigest()
            rows.append({"key": d["key"], "copies": 0 if last else d["copies"], "sha": sha, **(dict(ZEROS) if last else done)})
        carried = docs[-1:] if open_ else []
        self.runs = {s: [(0, x) for x in out["rest"][s] if len(x)] for s in "ab"} if open_ else {"a": [], "b": []}
        self.held = sum(len(x) for s in "ab" for _, x in self.runs[s])
        self.docs = carried
        return {"rows": rows, **out["links"]}

    def _swept(self, ids, doc, ends) -> dict:
        both = np.concatenate([ends["a"], ends["b"]])
        order = np.argsort(both, kind="stable")  # two sorted runs
        at, from_a = both[order], order < len(ends["a"])
        again = np.zeros(len(at), bool)
        again[1:] = at[1:] == at[:-1]
        count_a = np.cumsum(from_a)
        count_b = np.arange(1, len(at) + 1) - count_a
        shared = np.flatnonzero(again)
        cut = shared[-1] + 1 if len(shared) else 0
        n_a, n_b = (int(count_a[cut - 1]), int(count_b[cut - 1])) if cut else (0, 0)
        rest = {"a": [ids["a"][n_a:]], "b": [ids["b"][n_b:]]}
        end_a, end_b = count_a[shared] - 1, count_b[shared] - 1  # the tokens that end a group
        ids = {"a": ids["a"][:n_a], "b": ids["b"][:n_b]}
        doc_a, doc_b = doc["a"][:n_a], doc["b"][:n_b]
        link = np.flatnonzero(~again[:cut])
        in_a = count_a[link] - from_a[link]
        in_b = count_b[link] - ~from_a[link]
        pairs = (ids["a"][in_a] << 32) | ids["b"][in_b]
        link_doc = doc_a[in_a]

        # the digest's text: groups in order, in each the A ids and then the B ids
        group_a = np.repeat(np.arange(len(shared)), np.diff(end_a, prepend=-1))
        group_b = np.repeat(np.arange(len(shared)), np.diff(end_b, prepend=-1))
        last_a, last_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
        last_a[end_a], last_b[end_b] = 1, 1
        before_b = np.concatenate([[0], end_b + 1])
        text = np.empty(n_a + n_b, object)
        text[np.arange(n_a) + before_b[group_a]] = self.shown["a"][ids["a"] + len(self.sizes["a"]) * last_a]
        text[np.arange(n_b) + end_a[group_b] + 1] = self.shown["b"][ids["b"] + len(self.sizes["b"]) * last_b]

        size = len(self.docs)
        tokens_a, tokens_b = np.bincount(doc_a, minlength=size), np.bincount(doc_b, minlength=size)
        groups = np.bincount(doc_a[end_a], minlength=size)
        links = np.bincount(link_doc, minlength=size)
        stops = np.cumsum(tokens_a + tokens_b)
        for k in np.flatnonzero(groups):
            d = self.docs[k]
            part = b"".join(text[stops[k] - tokens_a[k] - tokens_b[k] : stops[k]].tolist())[:-1]
            if d["sha"] is None:
                d["sha"] = hashlib.sha256(part)
            else:
                d["sha"].update(b";" + part)
            d["n_a"] += int(tokens_a[k])
            d["n_b"] += int(tokens_b[k])
            d["n_groups"] += int(groups[k])
            d["n_links"] += int(links[k])

        places, known = pd.factorize(pairs)
        copies = np.array([d["copies"] for d in self.docs], np.int64)
        counts = np.zeros(len(known), np.int64)
        np.add.at(counts, places, copies[link_doc])
        each, met = pd.factorize(link_doc * max(1, len(known)) + places)
        return {
            "rest": rest,
            "links": {
                "pairs": known,
                "counts": counts,
                "in_doc": met // max(1, len(known)),
                "places": met % max(1, len(known)),
                "times": np.bincount(each, minlength=len(met)),
            },
        }


def sweep_blocks(events: DataFrame, params: AlignParams) -> DataFrame:
    """One row for each block: its documents' results, their links by place, and the block's pairs with counts."""
    kind = events.schema["_id"].dataType
    of_docs = [("ids", kind), ("hashes", T.LongType()), ("copies", T.LongType())]
    of_docs += [(n, T.LongType()) for n in ZEROS] + [("shas", T.StringType())]
    fields = [T.StructField("block", T.LongType())]
    fields += [T.StructField(n, T.ArrayType(t)) for n, t in of_docs]
    fields += [T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType()))]
    fields += [T.StructField(n, T.BinaryType()) for n in ("in_doc", "places", "times")]

    def sweep(batches):
        machine = Sweep(_loaded("a", params.a_path).pieces, _loaded("b", params.b_path).pieces)
        number = TaskContext.get().partitionId() << 32

        def row(found: dict, id_type: pa.DataType) -> pa.RecordBatch:
            nonlocal number
            rows = found["rows"]
            lists = [(pa.array([r["key"][0] for r in rows], id_type)), pa.array([r["key"][1] for r in rows], pa.int64())]
            lists += [pa.array([r[n] for r in rows], pa.int64()) for n in ("copies", *ZEROS)]
            lists += [pa.array([r["sha"] for r in rows], pa.string())]
            lists += [pa.array(found[n], pa.int64()) for n in ("pairs", "counts")]
            columns = [pa.array([number], pa.int64())]
            columns += [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
            columns += [pa.array([pack(found[n].astype("<u4"))], pa.binary()) for n in ("in_doc", "places", "times")]
            number += 1
            return pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, side, first = values[:2], values[3], values[4]
                if machine.full(key, side, first):
                    yield row(machine.block(key == machine.key), id_type)
                machine.feed(key, *values[2:])
        if machine.docs:
            yield row(machine.block(False), id_type)

    dealt = events.repartition("_id", "_hash").sortWithinPartitions("_id", "_hash", "_first", "_side")
    return dealt.mapInArrow(sweep, T.StructType(fields))


def link_totals(blocks: DataFrame) -> DataFrame:
    """(pair, total, best): links of each id pair in all documents, and whether no other A id has more with its B id."""
    pairs = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    totals = pairs.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", F.col("pair").bitwiseAND((1 << 32) - 1))
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    return totals.join(most, "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def align(docs: DataFrame, params: AlignParams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    sides = [end_events(docs, side, path, id_col, text_col) for side, path in (("a", params.a_path), ("b", params.b_path))]
    blocks = written(sweep_blocks(sides[0].unionByName(sides[1]), params), "blocks")
    totals = written(link_totals(blocks), "totals")
    places = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    back = places.join(totals, "pair").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "total", "best"))).alias("known"))
    kind = docs.schema[id_col].dataType
    names = ["_id", "_hash", "_copies", *ZEROS, "n_best", "count_sum", "sha"]
    fields = [T.StructField("_id", kind)] + [T.StructField(n, T.LongType()) for n in names[1:-1]] + [T.StructField("sha", T.StringType())]

    def weigh(batches):
        for batch in batches:
            columns = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                known = columns["known"][k].values
                size = len(columns["ids"][k].values)
                total = np.zeros(0, np.int64) if known is None else known.field("total").to_numpy()
                best = np.zeros(0, bool) if known is None else known.field("best").to_numpy(zero_copy_only=False)
                doc, place, times = (unpack(columns[n][k].as_py()).astype(np.int64) for n in ("in_doc", "places", "times"))
                n_best, count_sum = np.zeros(size, np.int64), np.zeros(size, np.int64)
                np.add.at(n_best, doc, times * best[place])
                np.add.at(count_sum, doc, times * total[place])
                lists = [columns[n][k].values for n in ("ids", "hashes", "copies", *ZEROS)]
                lists += [pa.array(n_best), pa.array(count_sum), columns["shas"][k].values]
                yield pa.RecordBatch.from_arrays(lists, names)

    joined = blocks.drop("pairs", "counts").join(back, "block", "left")
    parts = joined.mapInArrow(weigh, T.StructType(fields))
    # a document that outgrew a block is in several
    sums = [F.sum(n).alias(n) for n in ("_copies", *ZEROS, "n_best", "count_sum")]
    whole = parts.groupBy("_id", "_hash").agg(*sums, F.max("sha").alias("groups_sha256"))
    each = whole.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
    return each.select(F.col("_id").alias(id_col), *ZEROS, "n_best", "count_sum", "groups_sha256")
