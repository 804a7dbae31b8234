"""Chat formatting with a grammar round trip.

A turn is written as ``### role:``, a line break, its text, a line break and
``</turn>``, a line break.  In an escaped text each run of three or more ``#``
and each ``</turn>`` has one more backslash in front, so the end of a turn can
appear nowhere else and the change is undone by taking one backslash away.

A turn is first written with its text as it is and parsed again by the grammar;
where the parsed turn differs from the source, or the text holds a control string
that a reader could take for a mark, the text is escaped and the turn parsed again.
One escape is enough for every text; a turn that even then read otherwise would
end the job with an error, as would a finished conversation that, parsed as a
whole, is not the source (``round_trip`` tells that it was).

Cases: a null text or role counts as empty; turns are ordered by turn (nulls
first), role and text, so repeated turn numbers and repeated rows keep a place
each; a null conversation id is a conversation; an empty table gives an empty
result; other columns are not read.  One conversation is one output row and so
lies in one task, as it does for any reader of that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The strings of the template.
HEAD = "### "
AFTER_ROLE = ":\n"
END = "\n</turn>\n"
CONTROL = r"(\\*)(#{3,}|</turn>)"
ESCAPED = r"\\(\\*)(#{3,}|</turn>)"
#: Characters that a role name cannot show as they are; % comes first.
ROLE_CODES = [("%", "%25"), (":", "%3A"), ("\n", "%0A"), ("#", "%23"), ("<", "%3C")]


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2")


def escape_role(role: Column) -> Column:
    for char, code in ROLE_CODES:
        role = F.replace(role, F.lit(char), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for char, code in reversed(ROLE_CODES):
        role = F.replace(role, F.lit(code), F.lit(char))
    return role


def head(role: Column) -> Column:
    return F.concat(F.lit(HEAD), escape_role(role), F.lit(AFTER_ROLE))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text)."""

    def turn(part: Column) -> Column:
        line = F.substring_index(part, AFTER_ROLE, 1)
        body = F.substr(part, F.length(line) + len(AFTER_ROLE) + 1)
        role = F.substr(line, F.lit(len(HEAD) + 1))
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    return F.transform(F.array_remove(F.split(formatted, END), ""), turn)


def format_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    learn_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: id, formatted text, loss spans, source turns, round_trip.

    ``loss_spans`` are (start, length) in code points of the formatted text, one
    for each text of ``learn_role``.
    """
    rows = turns.select(
        F.col(conv_col),
        F.col(turn_col).alias("_turn"),
        F.coalesce(role_col, F.lit("")).alias("_role"),
        F.coalesce(text_col, F.lit("")).alias("_text"),
    )
    plain = parse(F.concat(head(F.col("_role")), F.col("_text"), F.lit(END)))
    source = F.array(F.struct(F.col("_role").alias("role"), F.col("_text").alias("text")))
    clean = (plain == source) & ~F.col("_text").rlike(CONTROL)
    rows = rows.withColumn("_escaped", F.when(~clean, escape(F.col("_text"))))
    again = parse(F.concat(head(F.col("_role")), F.col("_escaped"), F.lit(END)))
    refused = F.raise_error(F.lit("a turn does not read back as it was"))
    body = F.when(clean, F.col("_text")).when(again == source, F.col("_escaped")).otherwise(refused)
    rows = rows.withColumn("_body", body).withColumn("_head", head(F.col("_role")))
    by_turn = Window.partitionBy(conv_col).orderBy("_turn", "_role", "_text")
    size = F.length("_head") + F.length("_body") + len(END)
    before = F.sum(size).over(by_turn.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_at", F.row_number().over(by_turn)).withColumn(
        "_start", F.coalesce(before, F.lit(0)) + F.length("_head")
    )
    item = F.struct("_at", "_head", "_body", "_role", "_text", "_start")
    grouped = rows.groupBy(conv_col).agg(F.sort_array(F.collect_list(item)).alias("_turns"))
    learned = F.filter("_turns", lambda t: t["_role"] == learn_role)
    out = grouped.select(
        conv_col,
        F.array_join(
            F.transform("_turns", lambda t: F.concat(t["_head"], t["_body"], F.lit(END))), ""
        ).alias("formatted"),
        F.transform(
            learned,
            lambda t: F.struct(
                t["_start"].cast("int").alias("start"), F.length(t["_body"]).alias("length")
            ),
        ).alias("loss_spans"),
        F.transform(
            "_turns", lambda t: F.struct(t["_role"].alias("role"), t["_text"].alias("text"))
        ).alias("turns"),
    )
    out = out.withColumn("round_trip", parse(F.col("formatted")) == F.col("turns"))
    refused = F.raise_error(F.lit("a conversation does not read back as it was"))
    return out.withColumn("formatted", F.when(F.col("round_trip"), F.col("formatted")).otherwise(refused))


def digest(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Counts and digests read back from the formatted text and its loss spans."""
    read = formatted.withColumn("_read", parse(F.col("formatted"))).withColumn(
        "_loss",
        F.array_join(
            F.transform(
                "loss_spans",
                lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])),
            ),
            "",
        ),
    )
    said = F.array_join(
        F.transform("_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return read.select(
        conv_col,
        F.size("_read").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )
