"""Documents that every corpus operator must survive."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, s string, kept boolean, tokens string, `a.b` int"
PLAIN = "the of and a word in this text that is for it was with and more of the same kind again"


def long_text(words: int = 60_000, seed: int = 3) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("abcdefghij", k=draw.randint(1, 9))) for _ in range(words))


def rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    texts = [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \n\t ", None, None),
        (4, "one", "xx", "b"),
        (5, PLAIN, "en", "b"),
        (6, PLAIN, "en", "b"),
        (6, PLAIN, "en", "b"),
        (None, "no id is given here, but there is a text of more than one word", "de", "c"),
        (None, "another text without an id\nand with two lines\nand with two lines", None, "c"),
        (7, long_text(), "en", "a"),
        (8, "ümläut ÜBER 第一 \U0001f600 naïve é\x00\x1f#*$|", "de", None),
        (9, "ONE two Three four FIVE six seven eight nine ten " * 6, "fr", "d"),
        (9, "a different text under an id that was there before, with some more words in it", "fr", "d"),
        (10, "First line.\nFirst line.\n\nOther line | with a bar.", "es", "d"),
    ]
    return [(*t, None if k % 3 else k, k, "s" * k, k % 2 == 0, None, 1) for k, t in enumerate(texts)]


def table(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
