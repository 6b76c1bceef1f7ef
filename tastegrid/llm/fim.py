"""Fill-in-the-middle documents, cut in UTF-8 bytes with a sparse index of wide characters.

Texts stay the UTF-8 bytes in which Arrow hands them over. Of all characters only those of several
bytes are recorded: their place, and how many bytes beyond one they take. A place in code points
is turned into one in bytes, and back, by a binary search in these exceptions; between two of
them both scales run in parallel, so plain ASCII text needs no index at all.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.tokens import slices

# The functions below travel to the workers inside the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = f"{PREFIX}|{SUFFIX}|{MIDDLE}"
# White space between tokens: \x20 and \x09 to \x0D.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
# Characters of the texts that a task looks at together.
SLICE_CHARS = 8_000_000
UNITS = ("words", "chars")


@dataclass(frozen=True)
class FimConfig:
    """``rate`` and ``spm_rate`` are percentages: documents rewritten, and of these suffix first.

    ``units`` are what the cuts fall between: ``"words"`` with the white space before them, or ``"chars"``.
    """

    seed: int = 42
    rate: int = 50
    spm_rate: int = 80
    units: str = "words"

    def __post_init__(self) -> None:
        if self.units not in UNITS:
            raise ValueError(f"units must be one of {UNITS}, not {self.units!r}")


class WideIndex:
    """The characters of several bytes in a run of UTF-8 bytes, and nothing about the others."""

    def __init__(self, data: np.ndarray) -> None:
        self.at = np.flatnonzero(data >= 0xC0)
        first = data[self.at]
        excess = 1 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
        self.before = np.concatenate([[0], np.cumsum(excess)])
        self.char_at = self.at - self.before[:-1]

    def chars(self, places: np.ndarray) -> np.ndarray:
        """Code points before places in bytes; the places begin characters or end the data."""
        return places - self.before[np.searchsorted(self.at, places)]

    def bytes(self, chars: np.ndarray) -> np.ndarray:
        """Bytes before places in code points."""
        return chars + self.before[np.searchsorted(self.char_at, chars)]


def _token_ends(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where words end: before white space, and at the end of a text."""
    space = np.zeros(256, dtype=bool)
    space[list(SPACES)] = True
    blank = space[data]
    closes = np.empty(len(data), dtype=bool)
    closes[:-1] = blank[1:]
    filled = ends[ends > 0]
    if len(data):
        closes[-1] = True
        closes[filled - 1] = True
    return np.flatnonzero(closes & ~blank) + 1


class _Cutter:
    """Units of texts that lie one after the other in ``data``, from ``begins`` to ``ends``."""

    def __init__(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, units: str) -> None:
        self.begins, self.ends, self.units = begins, ends, units
        self.index = WideIndex(data)
        self.first_char = self.index.chars(begins)
        if units == "chars":
            self.number = self.index.chars(ends) - self.first_char
            return
        self.word_ends = _token_ends(data, ends)
        self.first = np.searchsorted(self.word_ends, begins, side="right")
        words = np.searchsorted(self.word_ends, ends, side="right") - self.first
        last = np.where(words > 0, self.word_ends[np.maximum(self.first + words - 1, 0)] if len(self.word_ends) else 0, begins)
        # White space at the end is a token of its own.
        self.words, self.number = words, words + (ends > last)

    def cut(self, units: np.ndarray) -> np.ndarray:
        """The byte before which ``units`` units of each text lie."""
        if self.units == "chars":
            return self.index.bytes(self.first_char + units)
        if not len(self.word_ends):
            return np.where(units > 0, self.ends, self.begins)
        word = self.word_ends[np.clip(self.first + units - 1, 0, len(self.word_ends) - 1)]
        return np.where(units == 0, self.begins, np.where(units > self.words, self.ends, word))


def _draws(cfg: FimConfig) -> list[Column]:
    """Four 32-bit numbers from the hash of seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{cfg.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]


def _forms(texts: pa.Array, h3: np.ndarray, h4: np.ndarray, cfg: FimConfig) -> np.ndarray:
    marked = np.asarray(pc.match_substring_regex(texts, MARKS))
    empty = np.asarray(pc.equal(pc.binary_length(texts), 0))
    order = np.where(h4 % 100 < cfg.spm_rate, "spm", "psm")
    return np.where(empty | marked | (h3 % 100 >= cfg.rate), "plain", order)


def _transform_slice(batch: pa.RecordBatch, cfg: FimConfig) -> pa.RecordBatch:
    texts = pc.fill_null(batch.column("text"), "").cast(pa.large_string())
    h1, h2, h3, h4 = (np.asarray(batch.column(f"h{i}")) for i in range(1, 5))
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset :][: len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8)[offsets[0] : offsets[-1]] if buffer else np.empty(0, np.uint8)
    begins, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    cutter = _Cutter(data, begins, ends, cfg.units)
    n = cutter.number
    u, v = h1 % (n + 1), h2 % (n + 1)
    a, b = cutter.cut(np.minimum(u, v)), cutter.cut(np.maximum(u, v))
    chars_a, chars_b = cutter.index.chars(a), cutter.index.chars(b)
    form = _forms(texts, h3, h4, cfg)
    raw = memoryview(data)
    p, s, m = (mark.encode() for mark in (PREFIX, SUFFIX, MIDDLE))
    made = []
    for begin, x, y, end, how in zip(begins.tolist(), a.tolist(), b.tolist(), ends.tolist(), form.tolist()):
        if how == "plain":
            made.append(bytes(raw[begin:end]))
        elif how == "psm":
            made.append(b"".join((p, raw[begin:x], s, raw[y:end], m, raw[x:y])))
        else:
            made.append(b"".join((s, raw[y:end], p, raw[begin:x], m, raw[x:y])))
    plain = form == "plain"
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            pa.array(n, pa.int64()),
            pa.array(form.tolist(), pa.string()),
            pa.array(chars_a - cutter.first_char, pa.int64(), mask=plain),
            pa.array(chars_b - chars_a, pa.int64(), mask=plain),
            pa.array(made, pa.binary()).cast(pa.string()),
        ],
        names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
    )


def _job(cfg: FimConfig) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in slices(batch.column("text"), SLICE_CHARS):
                yield _transform_slice(batch.slice(start, end - start), cfg)

    return run


def transform(docs: DataFrame, cfg: FimConfig = FimConfig()) -> DataFrame:
    """One row per document: ``doc_id, n, form, prefix_chars, middle_chars, output``.

    ``n`` counts the units of the text. Two draws from the hash of seed and doc_id cut it into
    prefix, middle and suffix; ``output`` has them behind their marks, as prefix, suffix, middle
    (``psm``) or suffix, prefix, middle (``spm``), or is the text itself (``plain``: not drawn, no
    text, or a mark in the text). The lengths are in code points, null for ``plain``.

    A null text counts as empty. Rows that repeat, or share a doc_id, are handled one by one and
    alike; a null doc_id is hashed as an empty one. Only ``doc_id`` and ``text`` are read. No rows
    give no rows. Nothing is shuffled, and a task holds a few million characters or one text.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n BIGINT, form STRING, prefix_chars BIGINT, middle_chars BIGINT, output STRING"
    return docs.select("doc_id", "text", *_draws(cfg)).mapInArrow(_job(cfg), schema)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text from which ``transform`` made an output: no mark is left inside its parts."""
    parts = F.split(F.col(output), MARKS, -1)
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", psm).otherwise(spm)


def digests(made: DataFrame) -> DataFrame:
    """The rows of ``transform`` with SHA-256 sums of output and rebuilt text instead of the output."""
    def digest(text: Column) -> Column:
        return F.sha2(text.cast("binary"), 256)

    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        digest(F.col("output")).alias("output_sha256"),
        digest(restored()).alias("restored_sha256"),
    )
