"""Packing documents into fixed-length training sequences by cutting stock.

Documents are cut into pieces of ``capacity`` tokens and a remainder.  The
histogram of remainder lengths, in steps of ``grain`` tokens, is a cutting-stock
problem of bounded size: a linear program over patterns (how many pieces of each
length share a sequence) is solved by column generation, a knapsack dynamic
program prices new patterns, and the solution is rounded down; what the rounding
leaves over is packed first-fit decreasing on the histogram.  Pieces are ranked
within their length by Spark and take the places of the patterns by rank.

Only the histogram (at most ``capacity / grain`` numbers) reaches the driver.  If
the pivots run out before the linear program is solved, its solution so far is
used; ``lp_gap`` says by what share it can exceed the optimum, 0 if it is solved.

Cases: a null text counts as empty; an empty document is its end token alone; a
very long text is cut into many pieces, its ids taking four bytes each in one task;
repeated rows are separate documents; an empty table gives an empty result;
columns other than the id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

import logging
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.llm.tokenize import tokenizer
from pointloom.plans.numbering import number_within
from pointloom.plans.scratch import written
from pointloom.plans.session import arrow_batches

LOG = logging.getLogger(__name__)


@dataclass(frozen=True)
class PackingParams:
    tokenizer_path: str
    capacity: int = 2048
    grain: int = 8
    end_id: int = 1
    #: Pivots of the linear program; its basis is feasible whenever it stops, and ``lp_gap`` tells.
    most_pivots: int = 6000


def cut_documents(
    docs: DataFrame, params: PackingParams, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens (and the ids)."""
    kind = docs.schema[id_col].dataType
    fields = [
        T.StructField(id_col, kind),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    path, capacity = params.tokenizer_path, params.capacity
    end = np.array([params.end_id], "<u4").tobytes()

    def pieces(batches):
        encode = tokenizer(path).ids
        for batch in batches:
            rows, start, length, crc, total, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                data = encode(text.as_py() or "") + end
                count = len(data) // 4
                for at in range(0, count, capacity):
                    part = data[at * 4 : (at + capacity) * 4]
                    rows.append(row)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(count)
                    if with_ids:
                        ids.append(part)
            columns = [batch.column(0).take(pa.array(rows, pa.int32()))]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return docs.select(id_col, text_col).mapInArrow(pieces, T.StructType(fields))


def knapsack(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: counts of each size with a total of at most ``capacity``."""
    order = np.argsort(size, kind="stable")
    sizes, values = size[order], value[order]
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if fits[room]:
            gain = best[room - sizes[: fits[room]]] + values[: fits[room]]
            top = int(gain.argmax())
            if gain[top] > best[room] + 1e-12:
                best[room], choice[room] = gain[top], top
    counts, room = np.zeros(len(size)), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            counts[order[choice[room]]] += 1
            room -= sizes[choice[room]]
    return float(best[capacity]), counts


def starting_basis(
    size: np.ndarray, demand: np.ndarray, capacity: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Patterns (columns), their inverse and their use, which meets ``demand`` exactly.

    Each pattern is filled with the largest sizes still wanted and used until one
    of them runs out; later patterns lack that size, so with rows in the order in
    which sizes run out the basis is triangular and substitution inverts it.
    """
    left, wanted = demand.astype(float), np.ones(len(size), bool)
    basis, use = np.zeros((len(size), len(size))), np.zeros(len(size))
    order, ended = np.argsort(-size, kind="stable"), np.zeros(len(size), int)
    for column in range(len(size)):
        room = capacity
        for k in order[wanted[order]]:
            basis[k, column] = room // size[k]
            room %= size[k]
        held = np.flatnonzero(basis[:, column])
        ratio = left[held] / basis[held, column]
        use[column] = ratio.min()
        left = np.maximum(left - use[column] * basis[:, column], 0)
        ended[column] = held[ratio.argmin()]
        wanted[ended[column]] = False
    rows, solved = basis[ended], np.zeros_like(basis)
    for k in range(len(size)):
        solved[k] = -(rows[k, :k, None] * solved[:k]).sum(axis=0)
        solved[k, k] += 1
        solved[k] /= rows[k, k]
    inverse = np.zeros_like(basis)
    inverse[:, ended] = solved
    return basis, inverse, use


def generate_columns(
    size: np.ndarray, demand: np.ndarray, capacity: int, most_pivots: int
) -> tuple[np.ndarray, np.ndarray, float]:
    """Solve the cutting-stock linear program; return patterns (rows), their use and the gap.

    Revised simplex: the basis starts with patterns filled from the largest size
    down; the knapsack's pattern enters while its value at the current prices
    exceeds one sequence.  Prices divided by the worth of the best pattern bound the
    optimum from below, which gives the gap.
    """
    basis, inverse, use = starting_basis(size, demand, capacity)
    worth = np.inf
    for _ in range(most_pivots):
        prices = np.maximum(inverse.sum(axis=0), 0)
        worth, column = knapsack(prices, size, capacity)
        if worth <= 1 + 1e-7:
            break
        entering = inverse @ column
        ratio = np.where(entering > 1e-9, use / np.where(entering > 1e-9, entering, 1), np.inf)
        leave = int(ratio.argmin())
        step = ratio[leave]
        use = np.maximum(use - step * entering, 0)
        use[leave] = step
        basis[:, leave] = column
        row = inverse[leave] / entering[leave]
        inverse -= np.outer(entering, row)
        inverse[leave] = row
    else:
        worth, _ = knapsack(np.maximum(inverse.sum(axis=0), 0), size, capacity)
    return basis.T.astype(int), use, 0.0 if worth <= 1 + 1e-7 else float(worth - 1)


def first_fit(size: np.ndarray, left: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Pack leftover counts into patterns, largest sizes first."""
    left, patterns = left.copy(), []
    order = np.argsort(-size, kind="stable")
    while left.sum() > 0:
        room, pattern = capacity, np.zeros(len(size), int)
        for k in order:
            n = min(left[k], room // size[k])
            pattern[k] += n
            left[k] -= n
            room -= n * size[k]
        patterns.append(pattern)
    return patterns


def plan_patterns(
    size: np.ndarray, demand: np.ndarray, capacity: int, most_pivots: int
) -> tuple[np.ndarray, np.ndarray, float]:
    """Whole patterns and their copies that hold exactly ``demand`` pieces of each size; the gap."""
    patterns, use, gap = generate_columns(size, demand.astype(float), capacity, most_pivots)
    copies = np.floor(use + 1e-6).astype(np.int64)
    left = demand - copies @ patterns
    while (left < 0).any():  # a rounding error of the floor above
        k = int(np.argmin(left))
        p = int(np.argmax((patterns[:, k] > 0) & (copies > 0)))
        copies[p] -= 1
        left = demand - copies @ patterns
    rest = first_fit(size, left, capacity)
    patterns = np.vstack([patterns, *rest]) if rest else patterns
    copies = np.concatenate([copies, np.ones(len(rest), np.int64)])
    return patterns[copies > 0], copies[copies > 0], gap


def pack(
    docs: DataFrame, params: PackingParams, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Cut all documents into pieces and give each piece its sequence and offset.

    Texts go to the workers in small Arrow batches, so that what a worker and its executor
    hold of them is little beside the tokenizer.

    Sequences are numbered from 0 without gaps; offsets within a sequence are
    gapless from 0.  Returns id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, lp_gap and, on request, the piece's ids.
    """
    arrow_batches(docs.sparkSession, 500, 4 << 20)
    pieces = written(
        cut_documents(docs, params, id_col, text_col, with_ids).withColumn(
            "_size", F.ceil(F.col("length") / params.grain).cast("int")
        ),
        "pieces",
    )
    capacity = params.capacity // params.grain
    counts = {r["_size"]: r["n"] for r in pieces.groupBy("_size").agg(F.count("*").alias("n")).collect()}
    full = counts.pop(capacity, 0)
    size = np.array(sorted(counts), dtype=np.int64)
    demand = np.array([counts[s] for s in size.tolist()], dtype=np.int64)
    if len(size):
        patterns, copies, gap = plan_patterns(size, demand, capacity, params.most_pivots)
    else:
        patterns, copies, gap = np.zeros((0, 0), np.int64), np.zeros(0, np.int64), 0.0
    if gap:
        LOG.warning("the linear program stopped after %d pivots, at most %.3g above its optimum", params.most_pivots, gap)
    # places of each size: from which rank on a pattern holds it, and where its sequences begin
    first = np.concatenate([[0], np.cumsum(copies)])[:-1] + full
    places = {}
    for k, s in enumerate(size.tolist()):
        held = np.flatnonzero(patterns[:, k])
        per = patterns[held, k]
        begin = np.concatenate([[0], np.cumsum(per * copies[held])])[:-1]
        places[s] = (begin, per, first[held])
    ordered = number_within(pieces, ["_size"], [id_col, "start", "ids_crc32", "doc_tokens"], "_rank")

    schema = T.StructType([*ordered.schema.fields, T.StructField("sequence_id", T.LongType())])

    def place(batches):
        for batch in batches:
            sequence = batch.column("_rank").to_numpy().copy()
            sizes = batch.column("_size").to_numpy()
            for s in np.unique(sizes):
                if s == capacity:
                    continue  # a full piece is a sequence of its own
                at = sizes == s
                begin, per, base = places[int(s)]
                rank = sequence[at]
                k = np.searchsorted(begin, rank, side="right") - 1
                sequence[at] = base[k] + (rank - begin[k]) // per[k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence, pa.int64())], [f.name for f in schema])

    placed = ordered.mapInArrow(place, schema)
    before = (
        Window.partitionBy("sequence_id")
        .orderBy(F.desc("_size"), "_rank")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    out = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    out = out.withColumn("lp_gap", F.lit(gap))
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "lp_gap"]
    return out.select(*names, *(["ids"] if with_ids else []))


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def padding_share(packed: DataFrame, capacity: int = 2048) -> float:
    """Share of padding over all sequences; a sequence with a power of two of tokens has none."""
    fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    padded = F.when(F.expr("n & (n - 1)") == 0, F.col("n")).otherwise(F.lit(capacity))
    row = fill.agg(F.sum("n").alias("n"), F.sum(padded).alias("all")).first()
    return 0.0 if not row["all"] else 1 - row["n"] / row["all"]
