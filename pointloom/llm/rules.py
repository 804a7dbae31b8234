"""Quality rules: counts over whole texts and divergence from language references.

A document's character classes and common words form two histograms.  The common
words of a language are those that most of its documents hold, each document
counted once.  Each histogram is compared with its language's reference by the
Jensen-Shannon distance (base 2, 0 to 1), once the document is long enough for its
histogram to mean something.  A reference is the mean of the shares of all
documents of the language that pass the base rules, each weighing one, so neither
a very long document nor repetitive junk moves it.  Everything is a column
expression.

Cases: a null text has no words; a null language is the language ``""``; a
language with fewer than ``least_docs`` documents for a reference has none, and
its documents are held to the base rules only; a very long text is one row and
counts as a whole; repeated rows get the same verdict, and each counts; columns
with names of the operator's own (``_r_*``) are replaced; an empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.lets import let
from pointloom.plans.joins import join_sized

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Common words of each language that have a bin of their own.
BINS = 16
#: Common words of all languages that one literal set may hold.
MOST_LITERAL = 5000

#: Character classes, each removed from what the ones before it left.
CLASSES = [
    ("lower", r"[a-z]+"),
    ("space", SPACE),
    ("upper", r"[A-Z]+"),
    ("digit", r"[0-9]+"),
    ("stop", r"[.,;:!?'\"()\-]+"),
    ("symbol", rf"[{SYMBOLS}]+"),
    ("ascii", r"[\x00-\x7F]+"),
]
HISTOGRAM = [f"_r_{name}" for name, _ in CLASSES] + ["_r_other"]
WORD_BINS = [f"_r_w{k}" for k in range(BINS + 1)]


@dataclass(frozen=True)
class RuleParams:
    window: int = 8
    least_words: int = 20
    most_repeat_percent: int = 30
    #: Shorter documents are not compared.
    least_chars: int = 200
    least_common_words: int = 100
    #: Documents that a reference needs.
    least_docs: int = 20
    #: A distance may reach its base plus ``slack / sqrt(n_words)``: short texts are noisy.
    char_base: float = 0.20
    word_base: float = 0.18
    slack: float = 1.0


def repeated_words(words: Column, width: int) -> Column:
    """Words inside windows of ``width`` words that occur twice or more in the list."""

    def spread(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def hits(p: Column) -> Column:
            last = F.size(p) - 1
            twice = F.filter(
                p,
                lambda x, i: ((i > 0) & (F.get(p, i - 1)["h"] == x["h"]))
                | ((i < last) & (F.get(p, i + 1)["h"] == x["h"])),
            )
            start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
            return F.aggregate(
                F.sort_array(F.transform(twice, lambda x: x["i"])),
                start,
                lambda acc, at: F.struct(
                    (acc["n"] + at + width - F.greatest(at, acc["end"])).alias("n"),
                    (at + width).alias("end"),
                ),
                lambda acc: acc["n"],
            )

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
            let(pairs, hits)
        )

    def windows_of(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - width)
        windows = F.transform(
            starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)])
        )
        return let(windows, spread)

    return F.when(F.size(words) <= width, F.lit(0)).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), windows_of)
    )


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def common_words(
    docs: DataFrame, params: RuleParams, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """(_r_lang, _r_listed, _r_docs): the words that most documents of each language hold, commonest first.

    Documents of fewer than ``least_words`` words are not asked; ties go to the
    smaller word.  Counts are summed before the shuffle, and only the first
    ``BINS`` words of each language in each partition go into the last one.
    """
    rows = docs.select(
        F.coalesce(F.col(lang_col), F.lit("")).alias("_r_lang"), words_of(F.coalesce(F.col(text_col), F.lit(""))).alias("_w")
    )
    held = F.when(F.size("_w") >= params.least_words, F.array_distinct(F.transform("_w", lambda w: F.lower(w))))
    counts = rows.select("_r_lang", F.explode(held).alias("word")).groupBy("_r_lang", "word").agg(F.count("*").alias("n"))
    order = Window.partitionBy("_r_lang").orderBy(F.desc("n"), "word")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= BINS)
    ranked = F.sort_array(F.collect_list(F.struct("rank", "word")))
    lists = top.groupBy("_r_lang").agg(F.transform(ranked, lambda x: x["word"]).alias("_r_listed"))
    langs = rows.groupBy("_r_lang").agg(F.count("*").alias("_r_docs"))
    none = F.array().cast("array<string>")
    return langs.join(lists, "_r_lang", "left").select("_r_lang", F.coalesce("_r_listed", none).alias("_r_listed"), "_r_docs")


def measure(
    docs: DataFrame, words: DataFrame, params: RuleParams, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """``docs`` with the counts and histograms of each text, in columns ``_r_*``.

    ``words`` are those of :func:`common_words`, as a written table.
    """
    out = docs.drop("_r_listed", "_r_docs").withColumns(
        {"_r_lang": F.coalesce(F.col(lang_col), F.lit("")), "_r_0": F.coalesce(F.col(text_col), F.lit(""))}
    )
    out = join_sized(out, words, "_r_lang", "_r_docs")
    for k, (_, pattern) in enumerate(CLASSES):
        out = out.withColumn(f"_r_{k + 1}", F.regexp_replace(f"_r_{k}", pattern, ""))
    counts = {
        f"_r_{name}": F.length(f"_r_{k}") - F.length(f"_r_{k + 1}")
        for k, (name, _) in enumerate(CLASSES)
    }
    counts["_r_other"] = F.length(f"_r_{len(CLASSES)}")
    out = out.withColumns(
        counts
        | {
            "_r_chars": F.length("_r_0"),
            "_r_words": words_of(F.col("_r_0")),
            "_r_lines": F.filter(
                F.split("_r_0", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")
            ),
        }
    ).drop(*[f"_r_{k}" for k in range(len(CLASSES) + 1)])
    low = F.transform("_r_words", lambda w: F.lower(w))
    # a first sieve by one set of all languages' words, if they are few enough for a literal
    known = [r["w"] for r in words.select(F.explode("_r_listed").alias("w")).distinct().limit(MOST_LITERAL + 1).collect()]
    few = len(known) <= MOST_LITERAL
    common = F.filter(low, lambda w: w.isin(*known) if few else F.array_contains("_r_listed", w))
    bins = let(
        common, lambda c: F.transform("_r_listed", lambda r: F.size(F.filter(c, lambda w: w == r)))
    )
    out = out.withColumns(
        {
            "_r_n_words": F.size("_r_words"),
            "_r_dup_lines": F.size("_r_lines") - F.size(F.array_distinct("_r_lines")),
            "_r_repeat": repeated_words(F.col("_r_words"), params.window),
            "_r_bins": bins,
        }
    )
    bin_columns = {
        f"_r_w{k}": F.coalesce(F.get("_r_bins", F.lit(k)), F.lit(0)) for k in range(BINS)
    }
    out = out.withColumns(bin_columns).withColumns(
        {
            f"_r_w{BINS}": F.col("_r_n_words") - reduce(lambda a, b: a + b, [F.col(c) for c in bin_columns]),
            "_r_base_failed": (F.col("_r_n_words") < params.least_words)
            | (100 * F.col("_r_repeat").cast("long") > params.most_repeat_percent * F.col("_r_n_words").cast("long")),
        }
    )
    return out.drop("_r_words", "_r_lines", "_r_bins", "_r_listed", "_r_docs")


MEASURES = ["_r_lang", "_r_base_failed", "_r_n_words", "_r_chars", "_r_dup_lines", "_r_repeat", *HISTOGRAM, *WORD_BINS]


def long_enough(params: RuleParams) -> list[tuple[list[str], str, Column]]:
    """Each histogram: its columns, the column of its total, and whether a document is long enough for it."""
    return [
        (HISTOGRAM, "_r_chars", F.col("_r_chars") >= params.least_chars),
        (WORD_BINS, "_r_n_words", F.col("_r_n_words") >= params.least_common_words),
    ]


def references(measured: DataFrame, params: RuleParams) -> DataFrame:
    """(_r_lang, _q_docs, shares ``_q_*``): mean shares of each language's documents; null where they are too few."""
    shares = {}
    for names, total, enough in long_enough(params):
        used = enough & ~F.col("_r_base_failed")
        for c in names:
            mean = F.avg(F.when(used, F.col(c) / F.col(total)))
            shares[c.replace("_r_", "_q_")] = F.when(F.count_if(used) >= params.least_docs, mean)
    return measured.groupBy("_r_lang").agg(F.count("*").alias("_q_docs"), *[v.alias(k) for k, v in shares.items()])


def distance(names: list[str], total: str) -> Column:
    """Jensen-Shannon distance of the histogram ``names`` from its reference shares."""

    def half(p: Column, middle: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / middle)).otherwise(0.0)

    parts = []
    for c in names:
        p, q = F.col(c) / F.col(total), F.col(c.replace("_r_", "_q_"))
        parts += [half(p, (p + q) / 2), half(q, (p + q) / 2)]
    return F.sqrt(F.greatest(F.lit(0.0), reduce(lambda a, b: a + b, parts) / 2))


def judge(measured: DataFrame, refs: DataFrame, params: RuleParams) -> DataFrame:
    """``measured`` with distances and verdict ``_r_kept``; ``refs`` is a written table.

    A null distance (too short, or no reference) speaks for nothing.
    """
    joined = join_sized(measured, refs, "_r_lang", "_q_docs")
    char, word = (
        F.when(enough & F.col(names[0].replace("_r_", "_q_")).isNotNull(), distance(names, total))
        for names, total, enough in long_enough(params)
    )
    judged = joined.withColumns({"_r_char_distance": char, "_r_word_distance": word})
    noise = params.slack / F.sqrt(F.greatest(F.col("_r_n_words"), F.lit(1)))
    near = (F.coalesce("_r_char_distance", F.lit(0.0)) <= params.char_base + noise) & (
        F.coalesce("_r_word_distance", F.lit(0.0)) <= params.word_base + noise
    )
    return judged.withColumn("_r_kept", ~F.col("_r_base_failed") & near).drop(
        "_q_docs", *[c.replace("_r_", "_q_") for c in [*HISTOGRAM, *WORD_BINS]]
    )


def verdicts(judged: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return judged.select(
        id_col,
        F.col("_r_n_words").cast("long").alias("n_words"),
        (F.col("_r_chars") - F.col("_r_space")).cast("long").alias("word_chars"),
        F.col("_r_symbol").cast("long").alias("n_symbols"),
        F.col("_r_dup_lines").cast("long").alias("n_dup_lines"),
        F.col("_r_repeat").cast("long").alias("n_repeat_words"),
        F.col("_r_base_failed").alias("base_failed"),
        F.col("_r_kept").alias("kept"),
        F.round("_r_char_distance", 6).alias("char_distance"),
        F.round("_r_word_distance", 6).alias("word_distance"),
    )
