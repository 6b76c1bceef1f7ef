"""Secrets in texts: fixed patterns, and strings that nothing near them or common explains.

A string that stands close after a sensitive word is a candidate. How new it is, is measured with
zstandard: the bytes that the text around it takes with the string, less those without it, where
the compressor is primed with a dictionary of the words and names that are common in all texts.
Names, words and repeated code cost a few bytes then; a random key keeps nearly all of its
entropy. Candidates with enough new bytes, and enough for each of their characters, are reported.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.tokens import slices

# The functions below travel to the workers inside the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# ---- fixed values: kinds in their order, patterns, and the fewest characters ----
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 8, 16, 32

# Words that make the text after them sensitive.
SENSITIVE = (
    r"pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|"
    r"credential|bearer|authorization|signature"
)
CANDIDATE = r"[A-Za-z0-9+/_=.~-]+"

# Which texts of a batch may hold a span of each kind; checked in one native pass for each.
_MAY_ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
_MAY_ACCESS = r"AKIA[A-Z0-9]{12}"
_MAY_HEX = r"[0-9a-f]{32}"
_MAY_NOVEL = rf"(?i)({SENSITIVE})"

# Characters of the texts that a task looks at together, and words it counts before it passes them on.
SLICE_CHARS = 8_000_000
WORDS_AT_ONCE = 200_000
# A longer string shares more signs with itself, so fewer of its bytes are new.
SHORT = 32


@dataclass(frozen=True)
class SecretConfig:
    """``reach`` characters lie at most between a sensitive word and a candidate; ``context`` ones on
    either side are its surroundings. ``min_share`` new bytes for each character are asked of its first
    ``SHORT`` ones, ``long_share`` of all. ``dictionary_bytes`` bounds the dictionary of common words."""

    min_chars: int = 16
    reach: int = 48
    context: int = 256
    min_new_bytes: int = 12
    min_share: float = 0.8
    long_share: float = 0.5
    dictionary_bytes: int = 32_768
    level: int = 3


# ---- the dictionary ----

# Parts of names, so that no random string as a whole gets into the dictionary, however often copied.
_PART = re.compile(r"[A-Za-z][a-z]{2,15}(?![A-Za-z])")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def passed_on(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
        )

    counts: Counter = Counter()
    for batch in batches:
        texts = pc.fill_null(batch.column("text"), "")
        for text in texts.filter(pc.match_substring_regex(texts, _MAY_NOVEL)):
            counts.update(set(_PART.findall(text.as_py())))
            if len(counts) > WORDS_AT_ONCE:
                yield passed_on(counts)
                counts = Counter()
    yield passed_on(counts)


def common_words(docs: DataFrame, cfg: SecretConfig = SecretConfig()) -> bytes:
    """The words in most texts, rarest first, within ``dictionary_bytes``.

    Only letters count, and a word counts once a text. The texts near sensitive words are those
    that count, since candidates are compared with such texts. At most as many words as the
    bound has room for reach the driver, whatever the number of texts.
    """
    partial = docs.select("text").mapInArrow(_count_words, "word STRING, n BIGINT")
    counted = partial.groupBy("word").agg(F.sum("n").alias("n"))
    most = counted.where("n > 1").orderBy(F.desc("n"), "word").limit(cfg.dictionary_bytes // 4).collect()
    kept, size = [], 0
    for row in most:
        size += len(row["word"]) + 1
        if size > cfg.dictionary_bytes:
            break
        kept.append(row["word"])
    # What lies near the end of a dictionary takes fewer bits to point at.
    return " ".join(reversed(kept)).encode()


# ---- spans ----


class _Novelty:
    """Bytes that a string adds to its surroundings."""

    def __init__(self, words: bytes, level: int) -> None:
        import zstandard

        self.words = words
        primed = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if words else None
        self.compressor = zstandard.ZstdCompressor(
            level=level, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False
        )

    def added(self, before: str, found: str, after: str) -> int:
        around = f"{before}\n{after}\n".encode()
        return len(self.compressor.compress(around + found.encode())) - len(self.compressor.compress(around))


_RULES = (
    (KINDS[0], re.compile(ASSIGN, re.ASCII | re.IGNORECASE), 2, ASSIGN_CHARS),
    (KINDS[1], re.compile(ACCESS), 0, ACCESS_CHARS),
    (KINDS[2], re.compile(HEX), 0, HEX_CHARS),
)
_WORD = re.compile(SENSITIVE, re.ASCII | re.IGNORECASE)
_STRING = re.compile(CANDIDATE)

Span = tuple[int, int, int]  # begin, number of the kind, end


def base_spans(text: str, kinds: tuple[bool, bool, bool] = (True, True, True)) -> list[Span]:
    """Spans by the fixed patterns, by begin and kind."""
    spans = []
    for number, (wanted, (_, pattern, group, least)) in enumerate(zip(kinds, _RULES)):
        if wanted:
            spans += [
                (m.start(), number, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least
            ]
    return sorted(spans)


def _apart(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Begins and ends of the parts of a text that spans cover."""
    begins, ends = [], []
    for begin, _, end in spans:
        if ends and begin <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            begins.append(begin)
            ends.append(end)
    return begins, ends


def novel_spans(text: str, known: list[Span], novelty: _Novelty, cfg: SecretConfig) -> list[Span]:
    """Candidates that are new; those that meet a known span are left to it."""
    spans, looked_at = [], 0
    begins, ends = _apart(known)
    for word in _WORD.finditer(text):
        for m in _STRING.finditer(text, max(word.end(), looked_at), min(len(text), word.end() + cfg.reach)):
            begin, end = m.span()
            if end == word.end() + cfg.reach:
                # The window ends inside the string.
                end = _STRING.match(text, begin).end()
            looked_at = max(looked_at, end)
            near = bisect_left(begins, end) - 1
            if end - begin < cfg.min_chars or (near >= 0 and ends[near] > begin):
                continue
            found = text[begin:end]
            if not any(c.isdigit() for c in found) and (found.islower() or found.isupper() or found.istitle()):
                continue
            added = novelty.added(text[max(0, begin - cfg.context) : begin], found, text[end : end + cfg.context])
            short = cfg.min_share * min(len(found), SHORT)
            if added >= max(cfg.min_new_bytes, short, cfg.long_share * len(found)):
                spans.append((begin, len(KINDS) - 1, end))
    return spans


SPANS = "spans ARRAY<STRUCT<kind: STRING, begin: BIGINT, end: BIGINT>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))


def _scan_slice(texts: pa.Array, novelty: _Novelty, cfg: SecretConfig) -> list[list[dict]]:
    masks = [np.asarray(pc.match_substring_regex(texts, p)) for p in (_MAY_ASSIGN, _MAY_ACCESS, _MAY_HEX, _MAY_NOVEL)]
    found: list[list[dict]] = [[] for _ in range(len(texts))]
    for row in np.flatnonzero(np.logical_or.reduce(masks)).tolist():
        text = texts[row].as_py()
        wanted = tuple(bool(mask[row]) for mask in masks)
        spans = base_spans(text, wanted[:3])
        if wanted[3]:
            spans = sorted(spans + novel_spans(text, spans, novelty, cfg))
        found[row] = [{"kind": KINDS[kind], "begin": begin, "end": end} for begin, kind, end in spans]
    return found


def _job(words: bytes, cfg: SecretConfig) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = _Novelty(words, cfg.level)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for start, end in slices(texts, SLICE_CHARS):
                found = _scan_slice(texts.slice(start, end - start), novelty, cfg)
                ids = batch.column("doc_id").slice(start, end - start)
                yield pa.RecordBatch.from_arrays([ids, pa.array(found, _SPAN)], names=["doc_id", "spans"])

    return run


def scan(docs: DataFrame, cfg: SecretConfig = SecretConfig()) -> DataFrame:
    """One row per document: ``doc_id`` and ``spans`` of (kind, begin, end), by begin and kind.

    Places are in code points, the end is exclusive. Spans of the fixed patterns do not overlap
    within a kind but may across kinds; ``novel`` ones overlap none of them. A null text counts
    as empty and has no spans. Rows that repeat, or share a doc_id or have none, are rows of their
    own with the same spans. Only ``doc_id`` and ``text`` are read. No rows give no rows.

    The texts are read twice, once for the dictionary, whose bound is named; only counts of
    words are shuffled.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    words = common_words(docs, cfg)
    return docs.select("doc_id", "text").mapInArrow(_job(words, cfg), f"doc_id {kind}, {SPANS}")


def digests(scanned: DataFrame) -> DataFrame:
    """Counts and digests of the rows of ``scan``."""
    def written(spans):
        parts = F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string")),
        )
        return F.array_join(parts, ",")

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != KINDS[-1])
    return scanned.select(
        "doc_id",
        *[number(kind) for kind in KINDS[:3]],
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
