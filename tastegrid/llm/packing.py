"""Packing documents into sequences: best fit, then local search by swaps.

Only lengths decide where a piece can go, so the packing is worked out on the number of
pieces of each length, at most as many numbers as a sequence has tokens, whatever the size of
the corpus. Equal bins are one pattern with a multiplicity. Best fit on falling lengths gives
the first patterns; local search then moves pieces, exchanges one for one, or two for one
between underfull bins, always towards a larger sum of squared fills, until bins are empty.
Each piece finds its place in the plan by its rank among the pieces of its length.
"""

from __future__ import annotations

import sys
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.numbering import numbered
from tastegrid.llm.shelf import Shelf
from tastegrid.llm.tokens import SLICE_CHARS, WordEncoder, give_back, slices

# The functions below travel to the workers inside the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

END_ID = 0


@dataclass(frozen=True)
class PackConfig:
    """Settings of a packing.

    ``max_steps`` bounds the local search, and so the plan. A task encodes texts of about
    ``slice_chars`` characters together: more share more words and take more memory.
    """

    tokenizer: str
    capacity: int = 2048
    max_steps: int = 20_000
    slice_chars: int = SLICE_CHARS


# ---- the plan ----

Pattern = tuple[int, ...]  # lengths in a bin, falling


def best_fit(counts: Mapping[int, int], capacity: int) -> Counter[Pattern]:
    """Best fit on falling lengths, all pieces of one length at a time."""
    bins: dict[int, Counter[Pattern]] = defaultdict(Counter)  # by free room
    rooms: list[int] = []

    def put(pattern: Pattern, n: int) -> None:
        room = capacity - sum(pattern)
        if not bins[room]:
            insort(rooms, room)
        bins[room][pattern] += n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                pattern, n, room = (), left, capacity
            else:
                room = rooms[at]
                pattern, n = next(iter(bins[room].items()))
            times = min(room // length, left)
            used = min(n, left // times)
            if pattern:
                del bins[room][pattern]
                if not bins[room]:
                    rooms.pop(at)
                if n > used:
                    put(pattern, n - used)
            put(pattern + (length,) * times, used)
            left -= used * times
    plan: Counter[Pattern] = Counter()
    for group in bins.values():
        plan.update(group)
    return plan


class _Bins:
    """The plan during the search, with a table of what the underfull bins can take.

    A row of the table is a pattern, the piece it would give (0: none, a plain move), its
    free room and its fill. Rows of patterns that are gone stay behind, switched off.
    """

    def __init__(self, plan: Mapping[Pattern, int], capacity: int) -> None:
        self.capacity = capacity
        self.count: dict[Pattern, int] = {}
        self.rows: dict[Pattern, slice] = {}
        self.owner: list[Pattern] = []
        self.table = np.zeros((3, 1024), dtype=np.int64)
        self.on = np.zeros(1024, dtype=bool)
        for pattern, n in plan.items():
            self.change(pattern, n)

    def change(self, pattern: Pattern, n: int) -> None:
        """Add or take away ``n`` bins of a pattern."""
        left = self.count.get(pattern, 0) + n
        if left:
            self.count[pattern] = left
        else:
            self.count.pop(pattern, None)
        fill = sum(pattern)
        if fill == self.capacity:
            return
        if pattern not in self.rows:
            gives = (0, *sorted(set(pattern)))
            start, end = len(self.owner), len(self.owner) + len(gives)
            while end > len(self.on):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
                self.on = np.concatenate([self.on, np.zeros_like(self.on)])
            self.rows[pattern] = slice(start, end)
            self.owner.extend([pattern] * len(gives))
            self.table[:, start:end] = np.array([[g, self.capacity - fill, fill] for g in gives]).T
        self.on[self.rows[pattern]] = left > 0

    def best(self, donor: Pattern) -> tuple[Pattern, Pattern, Pattern] | None:
        """Target, what it gets and what it gives: the largest gain of the target that fits.

        A target at least as full as the donor that gets more than it gives raises the sum
        of squared fills. Two for one is tried where one piece finds no place.
        """
        size = len(self.owner)
        on = self.on[:size] & (self.table[2, :size] >= sum(donor))
        if self.count[donor] < 2:
            on[self.rows[donor]] = False
        where = np.flatnonzero(on)
        piece, room = self.table[0, where], self.table[1, where]
        lengths = sorted(set(donor), reverse=True)
        pairs = {(a, b) for a in lengths for b in lengths if a > b or (a == b and donor.count(a) > 1)}
        for choices, fit in ((((a,) for a in lengths), True), (sorted(pairs), piece > 0)):
            top, found = 0, None
            for given in choices:
                gain = sum(given) - piece
                fits = np.where((gain <= room) & fit, gain, 0)
                row = int(np.argmax(fits)) if len(fits) else 0
                if len(fits) and fits[row] > top:
                    top = int(fits[row])
                    found = self.owner[where[row]], given, ((int(piece[row]),) if piece[row] else ())
            if found:
                return found
        return None


def local_search(plan: Mapping[Pattern, int], capacity: int, max_steps: int) -> Counter[Pattern]:
    """Exchanges from the emptiest bins to fuller ones, until no bin can be emptied so."""
    bins = _Bins(plan, capacity)
    total = sum(sum(p) * n for p, n in bins.count.items())
    least, number = -(-total // capacity), sum(bins.count.values())
    queue = [(sum(p), p) for p in bins.count if sum(p) < capacity]
    heapify(queue)
    for _ in range(max_steps):
        while queue and queue[0][1] not in bins.count:
            heappop(queue)
        if number <= least or not queue:
            break
        donor = queue[0][1]
        found = bins.best(donor)
        if found is None:
            heappop(queue)
            continue
        target, given, taken = found
        n = bins.count[donor] // 2 if target == donor else min(bins.count[donor], bins.count[target])
        for old, lose, win in ((donor, given, taken), (target, taken, given)):
            bins.change(old, -n)
            rest = Counter(old) - Counter(lose) + Counter(win)
            fresh = tuple(sorted(rest.elements(), reverse=True))
            if not fresh:
                number -= n
                continue
            bins.change(fresh, n)
            if sum(fresh) < capacity:
                heappush(queue, (sum(fresh), fresh))
    return Counter(bins.count)


@dataclass
class Places:
    """For each length, in order of rank: where its pieces go.

    A segment covers ``bins * slots`` ranks: that many equal bins with as many places for the
    length, at the given offsets.
    """

    starts: dict[int, list[int]] = field(default_factory=lambda: defaultdict(list))
    first_bin: dict[int, list[int]] = field(default_factory=lambda: defaultdict(list))
    offsets: dict[int, list[list[int]]] = field(default_factory=lambda: defaultdict(list))


def places(plan: Counter[Pattern]) -> Places:
    found, next_bin, next_rank = Places(), 0, Counter()
    for pattern in sorted(plan, reverse=True):
        n, at, slots = plan[pattern], 0, defaultdict(list)
        for length in pattern:
            slots[length].append(at)
            at += length
        for length, offsets in slots.items():
            found.starts[length].append(next_rank[length])
            found.first_bin[length].append(next_bin)
            found.offsets[length].append(offsets)
            next_rank[length] += n * len(offsets)
        next_bin += n
    return found


def plan_bins(counts: Mapping[int, int], capacity: int, max_steps: int) -> Counter[Pattern]:
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError("pieces must have 1 to capacity tokens")
    return local_search(best_fit(counts, capacity), capacity, max_steps)


# ---- the jobs ----


def _cut_job(config: PackConfig, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(config.tokenizer)
        for batch in batches:
            docs, texts = batch.column("doc_id"), batch.column("text")
            for low, high in slices(texts, config.slice_chars):
                ids, ends = encoder.encode(texts.slice(low, high - low))
                rows: list[tuple] = []
                for i in range(high - low):
                    whole = np.append(ids[ends[i] : ends[i + 1]], END_ID).astype("<u4")
                    for start in range(0, len(whole), config.capacity):
                        raw = whole[start : start + config.capacity].tobytes()
                        rows.append((low + i, start // config.capacity, start, len(raw) // 4, zlib.crc32(raw), raw))
                at, *rest = zip(*rows)
                arrays = [docs.take(pa.array(at)), *map(pa.array, rest[:4], [pa.int32(), *[pa.int64()] * 3])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(rest[4], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
            give_back()

    return run


def _place_job(found: Places) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = {k: np.array(v) for k, v in found.starts.items()}
        for batch in batches:
            lengths, ranks = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            sequence, offset = np.empty((2, len(lengths)), dtype=np.int64)
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                segment = np.searchsorted(starts[length], ranks[rows], side="right") - 1
                for s in np.unique(segment).tolist():
                    these = rows[segment == s]
                    slots = np.array(found.offsets[length][s])
                    place = ranks[these] - starts[length][s]
                    sequence[these] = found.first_bin[length][s] + place // len(slots)
                    offset[these] = slots[place % len(slots)]
            names = [n for n in batch.schema.names if n != "rank"]
            columns = [*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    return run


PIECES = "doc_id BIGINT, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT"


def pack(docs: DataFrame, config: PackConfig, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its token ids and an end id; a null text is empty and gives the end id
    alone. Longer documents are cut into pieces of ``capacity`` ids, the last may be shorter.
    ``sequence_id`` runs from 0 without gaps; in a sequence the pieces lie at ``offset`` without
    gaps from 0. With ``with_ids`` the ids of the piece come along as little-endian unsigned
    32-bit numbers. Rows that repeat, also in doc_id, are packed each; doc_id may be null. Only
    ``doc_id`` and ``text`` are read. No rows give no rows.
    """
    shelf = Shelf(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = PIECES + (", ids BINARY" if with_ids else "")
    pieces = shelf.put("pieces", source.mapInArrow(_cut_job(config, with_ids), schema))
    # Only this table of lengths comes to the driver: ``capacity`` rows at most.
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    found = places(plan_bins(counts, config.capacity, config.max_steps))
    before, total = {}, 0
    for length in sorted(counts):
        before[length], total = total, total + counts[length]
    order = ["length", "doc_id", "piece", "start", "ids_crc32"]
    ranked = numbered(
        pieces.withColumn("_spread", F.xxhash64("doc_id", "piece", "ids_crc32")),
        ["length", "_spread", *order[1:]],
        shelf,
        "ranked",
        "_index",
    )
    shelf.drop("pieces")
    smaller = F.array(*[F.lit(before.get(n, 0)).cast("bigint") for n in range(config.capacity + 1)])
    rank = F.col("_index") - F.element_at(smaller, (F.col("length") + 1).cast("int"))
    ranked = ranked.withColumn("rank", rank).drop("_index", "_spread")
    return ranked.mapInArrow(_place_job(found), f"{schema}, sequence_id BIGINT, offset BIGINT")
