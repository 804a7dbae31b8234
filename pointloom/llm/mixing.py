"""Mixing sources to target weights: raking, then sampling by calibrated probabilities.

Documents fall into cells of source, language and topic.  A document is kept with
its cell's probability: the product of a factor for its source, its language and
its topic, 1 at most.  Iterative proportional fitting under that bound finds the
factors: cells at the bound are taken as they are and the others make up for
them, so that the expected sample has the target marginals and the wanted share
of all tokens.  A category with fewer tokens than its target gives all it has and
the targets of the others rise evenly; how far this moves the targets is logged.

Only the cells take part in the fitting: documents are summed once, with
map-side aggregation, so a hot source is one row for each language and topic.
There may be any number of sources, languages and topics, each with a target of
its own: a power of its share of tokens, or a given weight.  With given weights a
category that is not listed has weight 0, so its documents are left out; a listed
category without tokens is an error.  Cells of a bounded number (``most_local_cells``) are fitted in memory,
more of them as a distributed table, one aggregation and one join a step.  A fit
that does not reach its tolerance in ``most_rounds`` is returned with its error,
which ``mix`` puts beside each row and logs.

Cases: a null source or language is a category ``""``; a null text has no tokens
and lies in topic ``prose``; a category without tokens keeps factor 1; a very long
text is one row, searched whole; repeated rows are drawn alike (the draw hashes
id, text and seed); columns with names of the operator's own (``_m_*``) are
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.functions.lets import let
from pointloom.plans.joins import broadcast_if_small, join_sized
from pointloom.plans.scratch import Leftovers, drop, written

LOG = logging.getLogger(__name__)


@dataclass(frozen=True)
class Topic:
    """A topic: one of ``stems`` (lower case) stands in the lower-cased text and ``pattern`` is found.

    Either part may be left out; plain searches come first, so few texts reach the pattern.
    """

    name: str
    stems: tuple[str, ...] = ()
    pattern: str | None = None

    def found(self, text: Column, low: Column) -> Column:
        test = F.lit(True)
        if self.stems:
            test = reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in self.stems])
        return test & text.rlike(self.pattern) if self.pattern else test


#: Topics in order: the first that is found names the document.
TOPICS = (
    Topic("legal", ("license", "licence", "copyright", "all rights reserved", "general public")),
    Topic("contact", ("@",), r"[A-Za-z0-9._%+-]@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    Topic("contact", (), r"[0-9][0-9 ()-]{8,}[0-9]"),
    Topic("table", ("|",), r"(?:\|[^|\n]*){4}"),
    Topic("list", (), r"(?m)^\s*(?:[-*]|[0-9]+[.)])\s"),
    Topic("question", ("?",)),
)
OTHER_TOPIC = "prose"
#: Probabilities from here on count as 1.
BOUND = 1 - 1e-12


@dataclass(frozen=True)
class MixParams:
    #: Targets flatten the observed shares: share ** power, normalised.
    source_power: float = 0.5
    lang_power: float = 0.7
    topic_power: float = 0.7
    #: Given targets take the place of flattened shares: category -> weight, 0 for what is not listed.
    source_targets: dict[str, float] | None = None
    lang_targets: dict[str, float] | None = None
    topic_targets: dict[str, float] | None = None
    #: Expected share of all tokens in the sample.
    token_share: float = 0.7
    most_rounds: int = 300
    #: Cells that are fitted in the driver's memory; more are fitted by Spark jobs.
    most_local_cells: int = 100_000
    tolerance: float = 1e-6
    seed: int = 17
    topics: tuple[Topic, ...] = TOPICS


def topic_names(params: MixParams) -> list[str]:
    return [*dict.fromkeys(t.name for t in params.topics), OTHER_TOPIC]


def topic_of(text: Column, params: MixParams) -> Column:
    def named(low: Column) -> Column:
        found = F.lit(OTHER_TOPIC)
        for topic in reversed(params.topics):
            found = F.when(topic.found(text, low), topic.name).otherwise(found)
        return found

    return let(F.lower(text), named)


def tokens_of(text: Column) -> Column:
    """Words at ASCII white space, the token count of this operator."""
    return F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("long")


def with_cells(
    docs: DataFrame, params: MixParams, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None,
) -> DataFrame:
    """``docs`` without its text, source, language and topic, but with the cell, tokens and draw of each row.

    The topic is that of ``topic_col`` (a classifier's output, say) or else the
    first of ``topics`` found in the text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    draw = F.pmod(F.xxhash64(F.col(id_col), text, F.lit(params.seed)), F.lit(1 << 52)) / float(1 << 52)
    topic = topic_of(text, params) if topic_col is None else F.coalesce(F.col(topic_col).cast("string"), F.lit(""))
    return docs.withColumns(
        {
            "_m_source": F.coalesce(F.col(source_col).cast("string"), F.lit("")),
            "_m_lang": F.coalesce(F.col(lang_col).cast("string"), F.lit("")),
            "_m_topic": topic,
            "_m_tokens": tokens_of(text),
            "_m_draw": draw,
        }
    ).drop(text_col, source_col, lang_col, *([topic_col] if topic_col else []))


@dataclass(frozen=True)
class Raked:
    #: The cells with ``factor``, under the bound a probability.
    cells: DataFrame
    rounds: int
    #: The largest distance of a category from its target, as a share of all tokens.
    error: float
    converged: bool
    #: Total variation between wanted and reachable targets of each axis.
    moved: dict[str, float] = field(default_factory=dict)


AXES = ("source", "lang", "topic")


def weight_of(axis: str, params: MixParams) -> tuple[float, dict[str, float] | None]:
    """The power that flattens shares, and given targets in its place."""
    return {
        "source": (params.source_power, params.source_targets),
        "lang": (params.lang_power, params.lang_targets),
        "topic": (params.topic_power, params.topic_targets),
    }[axis]


def require_tokens(axis: str, given: dict[str, float], there: set[str]) -> None:
    """Ends the job if a wanted category has no tokens: no sample could have its target."""
    missing = sorted(k for k, v in given.items() if v > 0 and k not in there)
    if missing:
        raise ValueError(f"no tokens in wanted {axis}: {', '.join(map(repr, missing[:10]))}")


def reachable(weight: np.ndarray, held: np.ndarray, total: float) -> np.ndarray:
    """``weight`` scaled to the sum ``total`` with no more than ``held`` in any category."""
    out = np.zeros(len(weight))
    free = weight > 0
    while free.any():
        out[free] = weight[free] * max(0.0, total - out[~free].sum()) / weight[free].sum()
        over = free & (out > held)
        if not over.any():
            break
        out[over] = held[over]
        free &= ~over
    return out


def axis_goals(cells: DataFrame, params: MixParams, bounded: bool, all_tokens: float) -> tuple[dict[str, DataFrame], dict[str, float]]:
    """(category, goal) tables of each axis, in tokens, and how far the bound moved the targets."""
    kept = min(1.0, params.token_share) * all_tokens if bounded else all_tokens
    goals, moved = {}, {}
    for axis in AXES:
        power, given = weight_of(axis, params)
        weight = F.pow("tokens", F.lit(power))
        totals = cells.groupBy(axis).agg(F.sum("tokens").alias("tokens"))
        if given:
            listed = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], f"{axis} string, _weight double")
            totals = totals.join(broadcast_if_small(listed), axis, "left")
            there = {r[axis] for r in totals.where("tokens > 0 AND _weight > 0").select(axis).collect()}  # of those listed
            require_tokens(axis, given, there)
            weight = F.coalesce("_weight", F.lit(0.0))
        table = written(totals.select(axis, "tokens", weight.cast("double").alias("_w")).withColumn("weight", F.when(F.col("tokens") > 0, F.col("_w")).otherwise(0.0)).drop("_w"), "goals")
        sums = table.agg(F.sum("weight").alias("w"), F.sum(F.when(F.col("weight") > 0, F.col("tokens"))).alias("n")).first()
        wanted = all_tokens * F.col("weight") / (sums["w"] or 1.0)
        goal = wanted
        if bounded and sums["w"]:
            rise = table.select("tokens", (F.col("weight") / F.col("tokens")).alias("factor")).where("factor > 0")
            level = scale_to(rise, min(1.0, kept / sums["n"]))
            goal = F.least(F.col("tokens"), F.when(F.col("weight") > 0, F.col("weight") * level).otherwise(0.0))
            away = F.abs(wanted / all_tokens - goal / kept) / 2
            moved[axis] = table.agg(F.sum(away)).first()[0]
        goals[axis] = table.select(axis, goal.cast("double").alias("goal"))
    return goals, moved


def rake(cells: DataFrame, params: MixParams, bounded: bool = False) -> Raked:
    """Factors of all cells (source, lang, topic, tokens, ...) by iterative proportional fitting.

    Each round fits the sources, the languages and the topics once.  If
    ``bounded``, factors are probabilities: 1 at most, and targets are for
    ``token_share`` of all tokens.  Up to ``most_local_cells`` cells are fitted in
    the driver's memory, more by Spark jobs; both follow the same steps.
    """
    few = cells.limit(params.most_local_cells + 1).count() <= params.most_local_cells
    with Leftovers() as scratch:
        fitted, rounds, error, moved = (_fit_local if few else _fit_distributed)(cells, params, bounded)
    scratch.release(fitted)
    converged = error < params.tolerance
    if not converged or max(moved.values(), default=0.0) >= params.tolerance:
        LOG.warning("targets moved by %s (total variation); categories are off by %.3g of all tokens", moved, error)
    return Raked(fitted, rounds, error, converged, moved)


def _fit_local(cells: DataFrame, params: MixParams, bounded: bool):
    """Fit cells of a bounded number in memory."""
    table = cells.toPandas()
    tokens = table["tokens"].to_numpy(float)
    all_tokens = tokens.sum()
    kept = min(1.0, params.token_share) * all_tokens
    codes, wanted, moved = [], [], {}
    for axis in AXES:
        code, names = pd.factorize(table[axis])
        held = np.bincount(code, tokens, len(names))
        power, given = weight_of(axis, params)
        weight = np.array([given.get(x, 0.0) for x in names]) if given else held**power
        weight = np.where(held > 0, weight, 0.0)
        if given and all_tokens:
            require_tokens(axis, given, set(names[held > 0]))
        goal = weight * all_tokens / (weight.sum() or 1.0)
        if bounded:
            own, goal = goal, reachable(weight, held, kept)
            moved[axis] = float(np.abs(own / (all_tokens or 1) - goal / (kept or 1)).sum() / 2)
        codes.append(code)
        wanted.append(goal)
    factors = [np.ones(len(goal)) for goal in wanted]
    rounds, error = 0, 0.0
    while all_tokens and rounds < params.most_rounds:
        rounds, error = rounds + 1, 0.0
        for k in range(len(AXES)):
            others = np.prod([factors[j][codes[j]] for j in range(len(AXES)) if j != k], axis=0)
            free = factors[k][codes[k]] * others < BOUND if bounded else np.ones(len(tokens), bool)
            rate = np.bincount(codes[k], tokens * others * free, len(wanted[k]))
            held = np.bincount(codes[k], tokens * ~free, len(wanted[k]))
            error = max(error, np.abs(factors[k] * rate + held - wanted[k]).max() / all_tokens)
            factors[k] = _refitted(factors[k], rate, held, wanted[k])
        if error < params.tolerance:
            break
    factor = np.prod([f[c] for f, c in zip(factors, codes, strict=True)], axis=0)
    table["factor"] = np.minimum(1.0, factor) if bounded else factor
    kind = T.StructType([*cells.schema.fields, T.StructField("factor", T.DoubleType())])
    # as Arrow: rows of Python objects would start Python workers of their own on the executors
    fitted = cells.sparkSession.createDataFrame(pa.Table.from_pandas(table, preserve_index=False), kind)
    return written(fitted, "raked"), rounds, float(error), moved


def _fit_distributed(cells: DataFrame, params: MixParams, bounded: bool):
    """Fit any number of cells: a step sums the cells by category and writes them with the new factors."""
    all_tokens = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    goals, moved = axis_goals(cells, params, bounded, all_tokens)
    state = written(cells.withColumns({f"f_{axis}": F.lit(1.0) for axis in AXES}), "state")
    rounds, error = 0, 0.0
    while all_tokens and rounds < params.most_rounds:
        rounds, error = rounds + 1, 0.0
        for axis in AXES:
            others = reduce(lambda a, b: a * b, [F.col(f"f_{x}") for x in AXES if x != axis])
            free = F.col(f"f_{axis}") * others < BOUND if bounded else F.lit(True)
            sums = state.groupBy(axis).agg(
                F.first(f"f_{axis}").alias("f"),
                F.sum(F.when(free, F.col("tokens") * others).otherwise(0.0)).alias("rate"),
                F.sum(F.when(free, 0.0).otherwise(F.col("tokens").cast("double"))).alias("held"),
                F.count("*").alias("n"),
            )
            off = F.abs(F.col("f") * F.col("rate") + F.col("held") - F.col("goal")) / all_tokens
            whole = F.try_divide(F.col("f") * F.col("goal"), F.col("f") * F.col("rate") + F.col("held"))
            exact = F.try_divide(F.col("goal") - F.col("held"), F.col("rate"))
            at_bound = (F.col("held") > 0) & ((F.col("held") >= F.col("goal")) | (F.col("rate") <= 0))
            new = F.coalesce(F.when(at_bound, whole).otherwise(exact), F.lit(1.0))
            new = F.greatest(F.lit(0.0), F.least(F.lit(1e9), new))
            step = written(sums.join(goals[axis], axis).select(axis, "n", off.alias("off"), new.alias("new")), "step")
            error = max(error, step.agg(F.max("off")).first()[0] or 0.0)
            fitted = join_sized(state, step.drop("off"), axis, "n").withColumn(f"f_{axis}", F.col("new"))
            after = written(fitted.select(*state.columns), "state")
            drop(state)
            drop(step)
            state = after
        if error < params.tolerance:
            break
    factor = reduce(lambda a, b: a * b, [F.col(f"f_{x}") for x in AXES])
    factor = F.least(F.lit(1.0), factor) if bounded else factor
    return state.select(*cells.columns, factor.alias("factor")), rounds, float(error), moved


def _refitted(factor: np.ndarray, rate: np.ndarray, held: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Factors at which free cells (``rate`` for a factor of 1) and held ones reach ``goal``."""
    with np.errstate(divide="ignore", invalid="ignore"):
        exact = np.nan_to_num((goal - held) / rate, nan=1.0, posinf=1.0)
        # held cells alone exceed the goal, or none is free: the whole category is scaled
        whole = np.nan_to_num(factor * goal / (factor * rate + held), nan=1.0, posinf=1.0)
    return np.where((held > 0) & ((held >= goal) | (rate <= 0)), whole, exact).clip(0.0, 1e9)


def scale_to(cells: DataFrame, share: float) -> float:
    """The scale at which the sum of tokens * min(1, scale * factor) is ``share`` of all tokens.

    Each pass tries 32 scales at once and halves the interval five times.
    """
    row = cells.where("tokens > 0").agg(F.sum("tokens").alias("n"), F.min("factor").alias("least")).first()
    if not row["n"]:
        return 1.0
    if share >= 1 or not row["least"]:
        return float("inf") if share >= 1 else 1.0 / max(row["least"] or 1.0, 1e-12)
    low, high = 0.0, 1.0 / row["least"]
    for _ in range(8):
        tries = np.linspace(low, high, 34)[1:-1].tolist()
        sums = cells.agg(
            *[F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("factor") * s)).alias(f"s{k}") for k, s in enumerate(tries)]
        ).first()
        below = [s for k, s in enumerate(tries) if sums[k] < share * row["n"]]
        above = [s for k, s in enumerate(tries) if sums[k] >= share * row["n"]]
        low, high = max(below, default=low), min(above, default=high)
    return (low + high) / 2


def mix(
    docs: DataFrame, params: MixParams, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None,
) -> DataFrame:
    """``docs`` with its cell's columns, ``_m_factor``, ``_m_probability``, ``_m_fit_error`` and ``_m_kept``.

    Text, source and language are left out; a caller that wants them back carries
    them in another column.  The marked rows are written, so that each text is
    searched once.  The factor is the probability over the wanted share;
    ``_m_fit_error`` is the fit's distance from its targets as a share of all
    tokens, ``tolerance`` or more where the rounds did not suffice.
    """
    marked = written(with_cells(docs, params, id_col, text_col, source_col, lang_col, topic_col), "marked")
    names = ["_m_source", "_m_lang", "_m_topic"]
    cells = written(
        marked.groupBy(*[F.col(c).alias(c.removeprefix("_m_")) for c in names]).agg(
            F.sum("_m_tokens").alias("tokens"), F.count("*").alias("docs")
        ),
        "cells",
    )
    raked = rake(cells, params, bounded=True)
    chances = raked.cells.select(
        F.struct(*[F.col(axis).alias(f"_m_{axis}") for axis in AXES]).alias("_m_cell"),
        (F.col("factor") / params.token_share).alias("_m_factor"),
        F.col("factor").alias("_m_probability"),
        F.col("docs").alias("_m_docs"),
    )
    rows = marked.withColumn("_m_cell", F.struct(*names))
    return (
        join_sized(rows, chances, "_m_cell", "_m_docs")
        .withColumns({"_m_fit_error": F.lit(raked.error), "_m_kept": F.col("_m_draw") < F.col("_m_probability")})
        .drop("_m_docs", "_m_cell", "_m_draw")
    )
