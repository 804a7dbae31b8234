import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tests.compare import same_rows
from tests.conftest import SF

from pointloom.llm import chat, queries

SCHEMA = "conv_id long, turn int, role string, text string, formatted string, start int"
PIECES = ["### user:\n", "</turn>", "\n</turn>\n", "\\", "\\###", "#", "###", "\n", "a", "\u00e9\U0001f600", ":", "%", "$1"]


def check(spark, conversations):
    rows = [(c, k, role, text, "x", 1) for c, turns in conversations.items() for k, (role, text) in enumerate(turns)]
    got = chat.digest(chat.format_conversations(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(got) == len(conversations)
    for r in got:
        turns = [(role or "", text or "") for role, text in conversations[r["conv_id"]]]
        said = "".join(f"{role}\n{text}\n" for role, text in turns)
        loss = "".join(text for role, text in turns if role == "assistant")
        assert r["round_trip"] and r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.lists(
            st.tuples(
                st.sampled_from(["user", "assistant", "tool: ### x", "", None]),
                st.one_of(st.none(), st.lists(st.sampled_from(PIECES), max_size=8).map("".join)),
            ),
            min_size=1,
            max_size=5,
        ),
        min_size=1,
        max_size=30,
    )
)
def test_any_text_is_read_back(spark, conversations):
    check(spark, dict(enumerate(conversations)))


def test_fixed_cases(spark):
    check(
        spark,
        {
            None: [("user", None), (None, "")],
            1: [("assistant", "\\### Assistant: </turn> ok"), ("assistant", "")],
            2: [("assistant", "long </turn>\n" * 20_000)],
        },
    )


def test_repeated_turns_keep_a_place_each(spark):
    rows = [(1, 0, "user", "same", "", 0)] * 3 + [(1, 0, "user", "other", "", 0)]
    row = chat.digest(chat.format_conversations(spark.createDataFrame(rows, SCHEMA))).first()
    assert row["n_turns"] == 4 and row["round_trip"]


def test_empty_table(spark):
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_only_conflicting_texts_are_escaped(spark):
    rows = [(1, 0, "user", "plain # text", "", 0), (1, 1, "user", "a </turn>", "", 0)]
    text = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).first()["formatted"]
    assert text == "### user:\nplain # text\n</turn>\n### user:\na \\</turn>\n</turn>\n"


def test_query_equals_sql(spark, duck):
    same_rows(queries.QUERIES["op9_chat"](spark, SF), duck.sql(queries.ORACLES["op9_chat"]))


def test_very_many_turns_in_one_conversation(spark):
    rows = [(1, k, "user" if k % 2 else "assistant", f"turn {k} ### </turn> \\") for k in range(20_000)]
    row = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).first()
    assert row["round_trip"] and len(row["turns"]) == 20_000 and len(row["loss_spans"]) == 10_000


def test_a_template_that_cannot_be_read_back_is_refused(spark, monkeypatch):
    monkeypatch.setattr(chat, "escape", lambda text: text)
    docs = spark.createDataFrame([(1, 0, "user", "ends here\n</turn>\nand goes on")], "conv_id long, turn int, role string, text string")
    with pytest.raises(Exception, match="does not read back"):
        chat.format_conversations(docs).collect()
