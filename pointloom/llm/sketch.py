"""Threshold-scaled sketches of whole texts.

A sketch keeps every hash of a text's character shingles below one fixed fraction
of the hash range, whatever the text's length.  So the sketch of two texts
together is the union of their sketches, and hashes that two sketches share
estimate containment however unequal the texts are.

Cases: a null text is empty; a text shorter than a shingle is one shingle; an
empty text has the fingerprint ``""``.  A short text may keep no hash (with ``n``
shingles the chance is ``(1 - FRACTION) ** n``: 0.3 at 9, 1 in 600 at 48); its
fingerprint is ``-``.  Equal fingerprints have likeness 1, also two of ``-``, which
nothing tells apart; otherwise a sketch without hashes has likeness 0.  Equal texts
have equal sketches.  Very long texts take memory in proportion to their length,
one text at a time.  Repeated rows are compared like any other rows; an empty
table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.plans.ranges import range_of

SHINGLE = 8  # code points; the hash doubles its span three times
BITS = 32
FRACTION = 1 / 8
LIMIT = np.uint64(int(2**BITS * FRACTION))
BASE = 0x9E3779B97F4A7C15
#: The fingerprint of a text that keeps no hash.
NONE_KEPT = "-"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit words, so that small hashes are a fair sample."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(64 - BITS)


def shingle_hashes(text: str) -> np.ndarray:
    """Hashes of all runs of ``SHINGLE`` code points."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(codes) < SHINGLE:
        value = len(codes)
        for c in codes.tolist():
            value = (value * BASE + c + 1) % 2**64
        return _mixed(np.array([value] * bool(len(codes)), np.uint64))
    rolled, span, factor = codes + np.uint64(1), 1, BASE
    while span < SHINGLE:
        rolled = rolled[:-span] * np.uint64(factor) + rolled[span:]
        span, factor = span * 2, factor * factor % 2**64
    return _mixed(rolled)


def sketch(text: str) -> np.ndarray:
    """The sorted hashes of ``text`` below the threshold."""
    hashes = shingle_hashes(text)
    return np.unique(hashes[hashes < LIMIT])


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of two texts' shingles together, from their sketches."""
    return np.union1d(a, b)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the smaller text's shingles that the larger one has; 0 without hashes."""
    least = min(len(a), len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / least if least else 0.0


def fingerprint(text: str, kept: np.ndarray) -> str:
    """The sketch ``kept`` of ``text`` as a string."""
    return encode(kept) if len(kept) or not text else NONE_KEPT


def encode(kept: np.ndarray) -> str:
    """``BITS`` bits a hash, in base 64."""
    data = kept.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8 :]
    return base64.b64encode(data.tobytes()).decode()


def decode(text: str) -> np.ndarray:
    data = np.frombuffer(base64.b64decode("" if text == NONE_KEPT else text), np.uint8).reshape(-1, BITS // 8)
    full = np.zeros((len(data), 8), np.uint8)
    full[:, 8 - BITS // 8 :] = data
    return full.view(">u8").reshape(-1).astype(np.uint64)


def with_sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every text."""
    fields = [docs.schema[id_col], T.StructField("fingerprint", T.StringType())]

    def sketches(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            prints = [fingerprint(t, sketch(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints, pa.string())], [f.name for f in fields]
            )

    return docs.select(id_col, text_col).mapInArrow(sketches, T.StructType(fields))


def compare_neighbours(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Sketches of each text and of its half-replaced version, and how alike they are.

    The second half of a text is replaced by the beginning of the next document
    in descending order of the (numeric) id; after the smallest id comes the
    largest.  Rows of one id are ordered by a hash of their text, a null id is
    below all others.

    Rows are dealt to ranges of ids, each sorted and read as a stream that holds
    two texts at a time; a range also gets the first row of the range that
    follows it.
    """
    spark = docs.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [k / parts for k in range(1, parts)]
    cuts = docs.select(F.col(id_col).cast("double").alias("v")).stat.approxQuantile("v", shares, 0.0005)
    rows = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("text")).withColumn(
        "_hash", F.xxhash64("text")
    )
    bounds, sub = [], {}
    for cut in cuts:  # an id that fills ranges of its own is divided by the hash of the text
        if bounds and bounds[-1] == cut:
            sub[cut] = sub.get(cut, 1) + 1
        else:
            bounds.append(cut)
    value = F.col(id_col).cast("double")
    base = range_of(value, bounds)
    most = max(sub.values(), default=1)
    within = F.lit(0)
    for cut, times in sorted(sub.items()):
        share = (F.shiftrightunsigned("_hash", 33) * times / 2**31).cast("int")
        within = F.when(value == cut, F.greatest(F.lit(0), F.lit(times - 1) - share)).otherwise(within)
    numbered = rows.withColumn("_range", (base * most + within).cast("int"))
    # the first row, in descending order, of each range
    order = F.struct(F.col(id_col), (-F.col("_hash").cast("decimal(20,0)")).alias("_h"))
    firsts = sorted(
        (r["_range"], r["top"][0], r["top"][1])
        for r in numbered.groupBy("_range").agg(F.max(order).alias("top")).collect()
    )
    if not firsts:
        goes = []
    else:
        above = [r for r, _, _ in firsts[1:]] + [firsts[0][0]]
        goes = [(i, int(-h), to) for (_, i, h), to in zip(firsts, above, strict=True)]
    index = {r: k for k, (r, _, _) in enumerate(firsts)}
    kind = T.StructType(
        [T.StructField("_i", docs.schema[id_col].dataType), T.StructField("_hh", T.LongType()), T.StructField("_to", T.IntegerType())]
    )
    # one row for each range: as many as partitions
    ghosts = F.broadcast(spark.createDataFrame(goes, kind))
    same = F.col(id_col).eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_hh"))
    ghost_rows = rows.join(ghosts, same).select(
        id_col, "text", "_hash", F.col("_to").alias("_range"), F.lit(1).alias("_ghost")
    )
    every = numbered.withColumn("_ghost", F.lit(0)).unionByName(ghost_rows)
    ranks = F.create_map(*[F.lit(x) for pair in index.items() for x in pair]) if index else None
    place = F.element_at(ranks, F.col("_range")) if index else F.lit(0)
    dealt = (
        every.withColumn("_place", place)
        .repartitionById(max(1, len(index)), F.col("_place"))
        .sortWithinPartitions("_ghost", F.desc_nulls_last(id_col), "_hash")
    )
    fields = [
        docs.schema[id_col],
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
    names = [f.name for f in fields]

    def compare(batches):
        held = None
        ended = False
        for batch in batches:
            ids, texts, ghost = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            out = []
            for k in range(batch.num_rows):
                if ended:
                    break
                text = texts[k].as_py()
                own = sketch(text)
                if held is not None:
                    out.append(_row(held, text, own))
                ended = bool(ghost[k])
                held = None if ended else (ids[k], text, own)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0].as_py() for r in out], ids.type)]
                    + [pa.array([r[c] for r in out]) for c in range(1, len(names))],
                    names,
                )

    return dealt.select(id_col, "text", "_ghost").mapInArrow(compare, T.StructType(fields))


def _row(held, following: str, following_sketch: np.ndarray) -> tuple:
    key, text, own = held
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    changed = sketch(edited)
    prints = [fingerprint(t, s) for t, s in ((text, own), (edited, changed), (following, following_sketch))]
    return (
        key,
        len(text),
        hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
        prints[0],
        prints[1],
        1.0 if prints[0] == prints[1] else likeness(own, changed),
        1.0 if prints[0] == prints[2] else likeness(own, following_sketch),
    )
