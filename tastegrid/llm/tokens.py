"""Token ids of whole texts, with each distinct word of a worker encoded once.

A text is cut only at single spaces between two signs that are no white space. Both kinds of
tokenizer used here look at the pieces of such a cut one by one, so the ids of the pieces, put
together, are the ids of the text. Tests hold this against the plain way.

The words live on in the worker, within a bound, so the next texts and tasks find them there.
Where a tokenizer keeps the space before a word in its first id, new words are encoded as texts of
many words and told apart by these ids, since a call for each word takes longer than its ids.
"""

from __future__ import annotations

import ctypes
import json
import os
import sys
import types
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# The functions below travel to the workers inside the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TAILS = (".", ",")

# Characters that are encoded together; every distinct word of them is encoded once.
SLICE_CHARS = 16_000_000


# New words that are encoded as one text.
JOINED_WORDS = 100

# Bytes of words and ids that a worker keeps, and what one of them takes besides its letters and ids.
KEPT_BYTES = 16 << 20
ENTRY_BYTES = 180

# The functions of this module travel with each task; what is to stay in the worker stands here.
_HOME = "tastegrid_worker_words"


class WordEncoder:
    """Encodes texts with a tokenizer file."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        home = sys.modules.setdefault(_HOME, types.ModuleType(_HOME)).__dict__
        if path not in home:
            tokenizer = Tokenizer.from_file(path)
            settings = json.loads(tokenizer.to_str())
            folds_case = '"Lowercase"' in json.dumps(settings.get("normalizer"))
            home[path] = (tokenizer, folds_case, _spaced(settings), {}, [0])
        # The last two change: words with their ids, and the bytes they take.
        self.tokenizer, self.folds_case, self.spaced, self.known, self.kept = home[path]
        self.tails = self._plain(list(TAILS))

    def _plain(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces, as bytes."""
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [array("i", e.ids).tobytes() for e in found]

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of words without spaces, each after a space."""
        if self.spaced is None:
            return self._plain([" " + w for w in words])
        # A word that begins or ends with white space, or may hold a special token, goes alone.
        solid = [w for w in words if w and w == w.strip() and "<|" not in w]
        texts = [" " + " ".join(solid[i : i + JOINED_WORDS]) for i in range(0, len(solid), JOINED_WORDS)]
        raw = b"".join(self._plain(texts))
        places = np.append(np.flatnonzero(self.spaced.take(np.frombuffer(raw, dtype=np.int32))) * 4, len(raw)).tolist()
        if len(places) != len(solid) + 1:
            raise ValueError("the tokenizer does not keep one space before each word")
        if len(solid) == len(words):
            return [raw[a:b] for a, b in zip(places, places[1:])]
        found = dict(zip(solid, (raw[a:b] for a, b in zip(places, places[1:]))))
        others = [w for w in words if w not in found]
        found.update(zip(others, self._plain([" " + w for w in others])))
        return [found[w] for w in words]

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of different words; those that find room stay in the worker."""
        known = self.known
        new = [w for w in words if w not in known]
        fresh = dict(zip(new, self._words(new)))
        ids = [known[w] if w in known else fresh[w] for w in words]
        for word, found in fresh.items():
            if self.kept[0] > KEPT_BYTES:
                break
            known[word] = found
            self.kept[0] += ENTRY_BYTES + len(word) + len(found)
        return ids

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, each after a space, and where they begin and end.

        A full stop or comma after a plain letter is a piece of its own, and case makes no
        difference to a tokenizer that lowers all text; so many words share their ids.
        """
        tail = np.zeros(len(words), dtype=np.int64)
        places = np.int64 if pa.types.is_large_string(words.type) else np.int32
        ends = np.frombuffer(words.buffers()[1], places)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        signs = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        long = np.flatnonzero(np.diff(ends) > 1)
        last, before = signs.take(ends[long + 1] - 1), signs.take(ends[long + 1] - 2) | 32
        letter = (before >= ord("a")) & (before <= ord("z"))
        for i, sign in enumerate(TAILS):
            tail[long[letter & (last == ord(sign))]] = i + 1
        heads = pc.if_else(pa.array(tail > 0), pc.utf8_slice_codeunits(words, 0, -1), words)
        if self.folds_case:
            # Not so for other letters: composing them first may depend on their case.
            plain = pc.and_(pc.string_is_ascii(heads), pc.invert(pc.match_substring(heads, "<|")))
            heads = pc.if_else(plain, pc.ascii_lower(heads), heads)
        coded = heads.dictionary_encode()
        ids = self._ids_of(coded.dictionary.to_pylist())
        return _joined(ids, self.tails, np.asarray(coded.indices), tail)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text begins and ends in them; null is empty."""
        words = pc.split_pattern(pc.fill_null(texts, ""), " ")
        offsets = np.asarray(words.offsets)
        offsets = offsets - offsets[0]
        coded = words.flatten().dictionary_encode()
        known, codes = coded.dictionary, np.asarray(coded.indices)
        flat, starts = self._word_ids(known)
        filled = np.asarray(pc.greater(pc.binary_length(known), 0))
        solid_start = filled & np.asarray(pc.equal(pc.utf8_ltrim_whitespace(known), known))
        solid_end = filled & np.asarray(pc.equal(pc.utf8_rtrim_whitespace(known), known))
        # A piece begins where a text does, or at a space between two solid signs.
        first = np.zeros(len(codes), dtype=bool)
        first[offsets[:-1]] = True
        begins = first.copy()
        begins[1:] |= solid_end[codes[:-1]] & solid_start[codes[1:]]
        places = np.flatnonzero(begins)
        sizes = np.diff(places, append=len(codes))
        # The others are met once: pieces of several words, and the first of each text.
        rare = np.flatnonzero((sizes > 1) | first[places])
        pieces = []
        for at, size in zip(places[rare], sizes[rare]):
            piece = " ".join(known[c].as_py() for c in codes[at : at + size].tolist())
            pieces.append(piece if first[at] else " " + piece)
        units = codes[places].astype(np.int64)
        units[rare] = len(starts) - 1 + np.arange(len(pieces))
        flat, starts = _appended(flat, starts, self._plain(pieces))
        lengths = starts[units + 1] - starts[units]
        stops = np.cumsum(lengths)
        shift = np.repeat((starts[units] - (stops - lengths)).astype(np.int32), lengths)
        shift += np.arange(len(shift), dtype=np.int32)
        upto = np.concatenate([[0], stops])
        return flat[shift], upto[np.searchsorted(places, offsets)]


def _spaced(settings: dict) -> np.ndarray | None:
    """Which ids begin with a space, where each word of a text has exactly one such id, the first; else None."""
    cut = settings.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    marked = all("<|" in t["content"] for t in settings.get("added_tokens") or [])
    model = settings["model"]
    if not plain or not marked or settings.get("normalizer") or model["type"] != "BPE" or model.get("dropout"):
        return None
    found = np.zeros(1 + max([*model["vocab"].values(), *(t["id"] for t in settings.get("added_tokens") or [])]), dtype=bool)
    found[[i for word, i in model["vocab"].items() if word.startswith("\u0120")]] = True
    return found


def _appended(flat: np.ndarray, starts: np.ndarray, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, ids), np.int64, count=len(ids)) // 4
    more = np.frombuffer(b"".join(ids), dtype=np.int32)
    return np.concatenate([flat, more]), np.concatenate([starts, starts[-1] + np.cumsum(sizes)])


def _joined(
    heads: list[bytes], tails: list[bytes], head: np.ndarray, tail: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each word: those of its head, and of its tail where ``tail`` is not 0."""
    flat, starts = _appended(np.empty(0, np.int32), np.zeros(1, np.int64), heads + tails)
    pairs = np.stack([head, np.where(tail > 0, len(heads) + tail - 1, -1)], axis=1).ravel()
    keep = pairs >= 0
    parts = pairs[keep]
    lengths = starts[parts + 1] - starts[parts]
    stops = np.cumsum(lengths)
    shift = np.repeat(starts[parts] - (stops - lengths), lengths) + np.arange(lengths.sum())
    upto = np.concatenate([[0], stops])
    before = np.concatenate([[0], np.cumsum(keep)])[::2]
    return flat[shift], upto[before]


def give_back() -> None:
    """Return freed memory to the system; a worker lives on between jobs and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(texts: pa.Array, most: int = SLICE_CHARS) -> list[tuple[int, int]]:
    """Ranges of rows with about ``most`` characters, one row at least."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.utf8_length(texts), 0), dtype=np.int64))
    found, start = [], 0
    while start < len(sizes):
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + most, side="right")))
        found.append((start, end))
        start = end
    return found
