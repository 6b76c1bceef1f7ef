from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tastegrid.llm.chat import escape, format_chats, read_turns, render, turns_template, unescape

TEXT = st.text(alphabet=st.sampled_from(list("\\#</turn>behcnaé: \n\U0001F600")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=5))
def test_turns_come_back_and_spans_hold_the_texts(messages):
    made = render(messages, turns_template)
    assert read_turns(made.text) == messages and made.rewritten_at is None
    for (role, text), (begin, end, text_begin, text_end) in zip(messages, made.spans):
        assert unescape(made.text[text_begin:text_end]) == text
        assert made.text[begin:end] == turns_template([(role, text)], None)


@given(TEXT)
def test_escapes_hide_all_marks(text):
    assert "###" not in escape(text) and "</turn>" not in escape(text) and unescape(escape(text)) == text


def test_templates_that_rewrite_history_are_found():
    def last_only(messages, opened=None):
        """Drops what earlier assistant turns said, as reasoning templates do."""
        shown = [(r, "" if r == "assistant" and i < len(messages) - 1 else t) for i, (r, t) in enumerate(messages)]
        return turns_template(shown, opened)

    chat = [("user", "a"), ("assistant", "b"), ("user", "c")]
    assert render(chat[:2], last_only).rewritten_at is None
    assert render(chat, last_only) .rewritten_at == 2 and render(chat, last_only).spans == ()

    def count_first(messages, opened=None):
        return f"{len(messages)}:" + turns_template(messages, opened)

    assert render(chat, count_first).rewritten_at == 0


ROWS = [
    (1, 1, "assistant", "two"), (1, 0, "user", "one"), (2, 0, None, None), (2, None, "user", ""),
    (3, 0, "user", "same"), (3, 0, "user", "same"), (3, 0, "assistant", "tie"), (None, 0, "user", "x"), (None, 0, "user", "y"),
    (4, 0, "user", "long " * 30_000), (4, 1, "assistant", "\\### Assistant: </turn> ok"),
]


def test_conversations(spark):
    df = spark.createDataFrame([(*r, 1, "z") for r in ROWS], "conv_id BIGINT, turn BIGINT, role STRING, text STRING, turns INT, formatted STRING")
    groups = defaultdict(list)
    for n, (conv, turn, role, text) in enumerate(ROWS):
        key = (conv, None) if conv is not None else (None, n)
        groups[key].append(((turn is not None, turn or 0), role or "", text or ""))
    expected = sorted(((k[0], [(r, t) for _, r, t in sorted(v)]) for k, v in groups.items()), key=str)
    found = format_chats(df).collect()
    assert sorted(((r["conv_id"], read_turns(r["formatted"])) for r in found), key=str) == expected
    for r in found:
        loss = [r["formatted"][s["text_begin"] : s["text_end"]] for s in r["spans"] if s["loss"]]
        assert [unescape(x) for x in loss] == [t for role, t in read_turns(r["formatted"]) if role == "assistant"]
    assert format_chats(df.limit(0)).count() == 0


@pytest.mark.parametrize("turns", [300])
def test_long_conversation(spark, turns):
    rows = [(1, i, "assistant" if i % 2 else "user", f"text {i}") for i in range(turns)]
    row = format_chats(spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")).first()
    assert len(row["spans"]) == turns and row["spans"][-1]["end"] == len(row["formatted"])
