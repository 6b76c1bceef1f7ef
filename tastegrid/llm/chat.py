"""Chat formatting by incremental rendering of a black-box template.

A template is a function from messages to text, of which nothing else is known. For each turn
the conversation up to it is rendered and compared with the rendering before: what was added
is the span of the turn. Two more renderings find the text within the span: the opening that
the template writes for a role, and the turn with an empty text, which shows how it closes. A
template that changes what it wrote for earlier turns is detected and gives no spans.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The functions below travel to the workers inside the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Message = tuple[str, str]  # role, text
# Messages, and the role whose turn is opened after them, if any.
Template = Callable[[Sequence[Message], str | None], str]

# ---- the template of this library ----

OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
# What texts and roles may not hold as it is, and how it is written.
ESCAPES = {"\\": "\\b", "###": "\\h", "</turn>": "\\e"}
ROLE_ESCAPES = ESCAPES | {":": "\\c", "\n": "\\n"}
_PLAIN = {written[1]: sign for sign, written in ROLE_ESCAPES.items()}


def escape(text: str, table: dict[str, str] = ESCAPES) -> str:
    """The backslash goes first, so that no escape is escaped again."""
    for sign, written in table.items():
        text = text.replace(sign, written)
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _PLAIN[m[1]], text)


def turns_template(messages: Sequence[Message], opened: str | None = None) -> str:
    """``### role: text </turn>`` for each turn."""
    parts = [OPEN + escape(r, ROLE_ESCAPES) + MIDDLE + escape(t) + CLOSE for r, t in messages]
    if opened is not None:
        parts.append(OPEN + escape(opened, ROLE_ESCAPES) + MIDDLE)
    return "".join(parts)


def read_turns(formatted: str) -> list[Message]:
    """The messages of a text by ``turns_template``."""
    turns = []
    for turn in formatted.split(CLOSE)[:-1]:
        role, text = turn[len(OPEN) :].split(MIDDLE, 1)
        turns.append((unescape(role), unescape(text)))
    return turns


# ---- spans ----


@dataclass(frozen=True)
class Rendered:
    """A formatted conversation. ``spans``: begin and end of each turn, and of its text."""

    text: str
    spans: tuple[tuple[int, int, int, int], ...]
    rewritten_at: int | None  # the turn at which the template changed earlier output


def render(messages: Sequence[Message], template: Template) -> Rendered:
    before, spans = template([], None), []
    for i, (role, _) in enumerate(messages):
        opened = template(messages[:i], role)
        empty = template([*messages[:i], (role, "")], None)
        now = template(messages[: i + 1], None)
        tail = empty[len(opened) :]
        end = len(now) - len(tail)
        fits = opened.startswith(before) and empty.startswith(opened)
        if not (fits and now.startswith(opened) and now.endswith(tail) and end >= len(opened)):
            return Rendered(template(messages, None), (), i)
        spans.append((len(before), len(now), len(opened), end))
        before = now
    return Rendered(before, tuple(spans), None)


FORMATTED = (
    "conv_id BIGINT, roles ARRAY<STRING>, formatted STRING, "
    "spans ARRAY<STRUCT<begin: BIGINT, end: BIGINT, text_begin: BIGINT, text_end: BIGINT, loss: BOOLEAN>>, "
    "rewritten_at INT"
)


def _format_job(template: Template, trained: frozenset[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv_id, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist()):
                messages = [(t["role"], t["text"]) for t in turns]
                made = render(messages, template)
                spans = [
                    {"begin": a, "end": b, "text_begin": c, "text_end": d, "loss": role in trained}
                    for (a, b, c, d), (role, _) in zip(made.spans, messages)
                ]
                rows.append(
                    {
                        "conv_id": conv_id,
                        "roles": [role for role, _ in messages],
                        "formatted": made.text,
                        "spans": spans,
                        "rewritten_at": made.rewritten_at,
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return run


_SPAN = pa.struct(
    [(n, pa.int64()) for n in ("begin", "end", "text_begin", "text_end")] + [("loss", pa.bool_())]
)
_SCHEMA = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("roles", pa.list_(pa.string())),
        ("formatted", pa.string()),
        ("spans", pa.list_(_SPAN)),
        ("rewritten_at", pa.int32()),
    ]
)


def format_chats(
    conversations: DataFrame,
    template: Template = turns_template,
    trained: Sequence[str] = ("assistant",),
) -> DataFrame:
    """One row per conversation: ``conv_id, roles, formatted, spans, rewritten_at``.

    ``spans`` has the places of each turn and of its text in ``formatted``, in code points; ``loss``
    marks the roles that are trained on. ``rewritten_at`` is null, or the first turn (from 0) at
    which the template changed what it had written; there are no spans then. Turns go by
    ``turn``, equal ones by role and text; null role and text count as empty, a null turn comes
    first. Rows that repeat are turns of their own. A row without conv_id is a conversation of
    one turn. Only ``conv_id, turn, role, text`` are read. No rows give no rows.

    A conversation is rendered as a whole, so it has to fit in one row, and rendering each
    prefix takes time in the square of its turns: that is the price of an unknown template.
    """
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    empty = F.lit("")
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        alone.alias("_alone"),
        F.struct(
            "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")
        ).alias("_turn"),
    )
    chats = rows.groupBy("conv_id", "_alone").agg(F.sort_array(F.collect_list("_turn")).alias("turns"))
    job = _format_job(template, frozenset(trained))
    return chats.select("conv_id", "turns").mapInArrow(job, FORMATTED)
