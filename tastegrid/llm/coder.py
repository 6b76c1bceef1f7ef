"""Adaptive range coder for token ids, with context mixing of orders 0 to 2.

A text of ids is cut into blocks that are coded independently of each other, all blocks of a
segment step by step at once. A block numbers its ids as they first occur, and all models
count these numbers. Order 0 counts every id of the block. For each previous id (order 1) and each
previous two (order 2) a table keeps the id that followed, with a count that grows with each hit.
The chance of each order to hit is learned for each pair of counts; these chances weigh
the orders against each other: the order-2 id, the order-1 id, or the counts of order 0.
An id that is new to the block is an escape of order 0, as likely as the block has
different ids, and its bytes with adaptive frequencies. All arithmetic is on integers.
"""

from __future__ import annotations

import struct
import sys
import zlib
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
from pyspark import cloudpickle

# The functions below travel to the workers inside the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_IDS = 4096
MAX_ID = 0xFFFFFFFF
SLOTS = 2048
TOP_CONFIDENCE = 7
MIX_BITS, BYTE_BITS = 12, 10
REFRESH = 64
RATE = 5

_U = np.uint64
_WORD = _U(32)
_LOW = _U(0xFFFFFFFF)
_WHOLE = 1 << MIX_BITS


# What a hit (last eight) or a miss does to an entry of a context, by its count.
_STEP = np.array([-(c + 1 >> 1) for c in range(8)] + [1] * 7 + [0], dtype=np.int16)


class _Contexts:
    """What followed each context of every block, and how far to trust it; the same in coder and decoder.

    Rows and entries of order 1 come first, those of order 2 after them.
    """

    def __init__(self, blocks: int) -> None:
        self.blocks = blocks
        # The number that followed, times 8, and how sure that is.
        self.table = np.zeros(2 * blocks * SLOTS, dtype=np.int16)
        kinds = 2 * (TOP_CONFIDENCE + 1) ** 2
        # The chance of order 2, and of order 1 where order 2 misses.
        self.chance = [np.full(blocks * kinds, 1 << 14, dtype=np.int32) for _ in range(2)]
        self.first_slot = np.arange(2 * blocks) * SLOTS
        self.first_kind = np.arange(blocks) * kinds

    def places(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Where the entries of both orders stand, from the last number and the one before it."""
        mixed = one * 40503
        slots = np.concatenate([mixed >> 3, mixed + two * 30011 >> 5], axis=-1)
        slots &= SLOTS - 1
        slots += self.first_slot
        return slots

    def kinds(self, sure: np.ndarray, same: np.ndarray) -> np.ndarray:
        one, two = sure[..., : self.blocks], sure[..., self.blocks :]
        return (two * np.int16(TOP_CONFIDENCE + 1) + one) * np.int16(2) + same + self.first_kind

    def useful(self, sure: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where order 1 and order 2 can hit: not without a count, nor order 1 with the id of order 2."""
        one, two = sure[..., : self.blocks] > 0, sure[..., self.blocks :] > 0
        return one & ~(two & same), two

    @staticmethod
    def parts(odds: list[np.ndarray], useful: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Where the range of order 2 ends, and that of order 1; none of the three is ever empty."""
        first = (odds[0] * (_WHOLE - 4) >> 16) * useful[1] + 1
        second = first + ((_WHOLE - 2 - first) * odds[1] >> 16) * useful[0] + 1
        return first, second

    def follow(self, at: np.ndarray, entry: np.ndarray, sure: np.ndarray, hit: np.ndarray, number: np.ndarray) -> None:
        """Count a hit or a miss; an entry without a count left takes the new number. ``number`` is times 8."""
        fresh = entry + _STEP.take(sure + (hit << 3))
        np.copyto(fresh, number + np.int16(1), where=(sure < 2) & ~hit)
        self.table[at] = fresh

    def trust(self, kind: np.ndarray, odds: list[np.ndarray], aims: list[np.ndarray], counts: tuple) -> None:
        """Move the chances that count towards 0 or 65535."""
        for chance, old, aim, some in zip(self.chance, odds, aims, counts):
            chance[kind] = old + (aim - old >> RATE) * some


class _Bytes:
    """Adaptive frequencies of the bytes of new ids, in ranges that are renewed every ``REFRESH`` steps."""

    def __init__(self, widths: np.ndarray) -> None:
        self.blocks, self.widths = len(widths), widths
        self.places = list(reversed(range(int(widths.max()))))
        self.seen = {k: np.zeros(self.blocks * 256, dtype=np.int64) for k in self.places}
        self.start = {k: np.zeros((self.blocks, 257), dtype=np.int32) for k in self.places}
        self.all_bytes = np.tile(np.arange(256, dtype=np.uint8), self.blocks)

    def renew(self) -> None:
        for k in self.places:
            seen = self.seen[k].reshape(-1, 256)
            total = np.maximum(seen.sum(axis=1), 1).astype(np.float32)[:, None]
            # Exact: counts have 12 bits, so no quotient is nearer to the next integer than it is rounded.
            size = (seen.astype(np.float32) * np.float32((1 << BYTE_BITS) - 256) / total).astype(np.int32) + 1
            np.cumsum(size, axis=1, out=self.start[k][:, 1:])
            self.start[k][:, 256] = 1 << BYTE_BITS

    def owners(self, k: int) -> np.ndarray:
        """The byte at each place of the range, for each block."""
        sizes = np.diff(self.start[k], axis=1).ravel()
        return np.repeat(self.all_bytes, sizes)

    def range(self, k: int, block: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, flat = block * 257 + byte, self.start[k].ravel()
        start = flat.take(at)
        return start, flat.take(at + 1) - start

    def add(self, k: int, block: np.ndarray, byte: np.ndarray) -> None:
        self.seen[k] += np.bincount(block * 256 + byte, minlength=len(self.seen[k]))


class _Range:
    """Low end and width of the range of every block, in 64 bits; the leading 32 leave once they are settled."""

    def __init__(self, blocks: int, move) -> None:
        self.low, self.width = np.zeros(blocks, dtype=_U), np.full(blocks, ~_U(0))
        self.move = move

    def narrow(self, part: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        self.low += part * start
        np.multiply(part, size, out=self.width)

    def narrow_some(self, some: np.ndarray, part: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        self.low[some] += part * start
        self.width[some] = part * size

    def settle(self, some: np.ndarray | None = None) -> None:
        """Move blocks with settled words on, among ``some`` of them or all; a range too narrow is cut at the word's end.

        Widths are at least 2 ** 32 after that, so no block has two settled words.
        """
        low, width = (self.low, self.width) if some is None else (self.low.take(some), self.width.take(some))
        apart = low ^ (low + width)
        ready = np.flatnonzero(np.minimum(apart, width) <= _LOW)
        if not len(ready):
            return
        low, width, apart = low.take(ready), width.take(ready), apart.take(ready)
        width = np.where(apart > _LOW, ~low + _U(1), width)
        if some is not None:
            ready = some.take(ready)
        self.move(ready, low)
        self.low[ready], self.width[ready] = low << _WORD, width << _WORD


def _blocks_of(ids: np.ndarray) -> list[int]:
    return [min(BLOCK_IDS, len(ids) - at) for at in range(0, len(ids), BLOCK_IDS)]


def _numbered(block: np.ndarray) -> np.ndarray:
    """Each id as its number in the order of first occurrence."""
    _, first, inverse = np.unique(block, return_index=True, return_inverse=True)
    rank = np.empty(len(first), dtype=np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    return rank[inverse]


class _Chunk:
    """What the coder knows of ``REFRESH`` steps of all blocks: ranges of order 0 and of the orders together.

    All ids are known to the coder, so only what one step learns for the next goes step by step.
    """

    def __init__(self, contexts: _Contexts, begin: int, number: np.ndarray, before: tuple, counts: np.ndarray, known: np.ndarray):
        steps, blocks = number.shape
        # Contexts: entries as they stood before each step.
        at = contexts.places(*before)
        entries = np.empty((steps, 2 * blocks), dtype=np.int16)
        twice = np.concatenate([number, number], axis=1).astype(np.int16)
        eight = twice << 3
        for step in range(steps):
            entry = entries[step]
            contexts.table.take(at[step], out=entry, mode="clip")
            contexts.follow(at[step], entry, entry & TOP_CONFIDENCE, (entry >> 3) == twice[step], eight[step])
        sure, seen = entries & TOP_CONFIDENCE, entries >> 3
        same = seen[:, :blocks] == seen[:, blocks:]
        hits, useful, kind = seen == twice, contexts.useful(sure, same), contexts.kinds(sure, same)
        two, one = useful[1] & hits[:, blocks:], useful[0] & hits[:, :blocks]
        one &= ~two
        aims = [two * np.int32(65535), one * np.int32(65535)]
        count = useful[1], useful[0] & ~two
        odds = [np.empty((steps, blocks), dtype=np.int32) for _ in range(2)]
        for step in range(steps):
            now = [c.take(kind[step]) for c in contexts.chance]
            odds[0][step], odds[1][step] = now
            contexts.trust(kind[step], now, [a[step] for a in aims], (count[0][step], count[1][step]))
        first, second = contexts.parts(odds, useful)
        start = np.where(two, 0, np.where(one, first, second))
        self.start, self.size = start.astype(_U), (np.where(two, first, np.where(one, second, _WHOLE)) - start).astype(_U)

        # Order 0: counts before the chunk, and those of earlier steps in it.
        most = int(number.max()) + 1
        flat = np.arange(blocks) * most + number
        part = counts[:, :most]
        smaller = (np.cumsum(part, axis=1, dtype=np.int16) - part).take(flat).astype(np.int64)
        own = part.ravel().take(flat).astype(np.int64)
        narrow = number.astype(np.int16)
        for step in range(1, steps):
            smaller[step] += np.add.reduce(narrow[:step] < narrow[step], axis=0, dtype=np.uint8)
            own[step] += np.add.reduce(narrow[:step] == narrow[step], axis=0, dtype=np.uint8)
        part += np.bincount(flat.ravel(), minlength=blocks * most).reshape(blocks, most).astype(np.int16)
        upto = np.maximum.accumulate(np.concatenate([known[None], number + 1]), axis=0)
        known[:] = upto[-1]
        place = (begin + np.arange(steps))[:, None]
        escape = np.maximum(upto[:-1], 1)
        # Where an order has the id, order 0 has one range, which changes nothing.
        rest = ~(two | one)
        self.new = rest & (number >= upto[:-1])
        self.total = np.where(rest, place + escape, 1).astype(_U)
        self.start0 = (np.where(self.new, place, smaller) * rest).astype(_U)
        self.size0 = np.where(rest, np.where(self.new, escape, own), 1).astype(_U)


def encode_blocks(ids: np.ndarray, sizes: list[int] | None = None) -> list[np.ndarray]:
    """The 32-bit words of each block of ids: the bytes that an id takes, two or four, then the code.

    Blocks have ``BLOCK_IDS`` ids, the last one the rest, or ``sizes``, no more than that each.
    """
    sizes = _blocks_of(ids) if sizes is None else sizes
    if not sizes:
        return []
    if ids.min() < 0 or ids.max() > MAX_ID:
        raise ValueError(f"ids must lie between 0 and {MAX_ID}")
    blocks, steps = len(sizes), max(sizes)
    table = np.zeros((blocks, steps), dtype=np.uint32)
    # Two numbers before the first; a block that has ended goes on with number 0.
    numbers = np.zeros((blocks, steps + 2), dtype=np.int16)
    ends = np.cumsum(sizes).tolist()
    for row, block, size, end in zip(numbers, table, sizes, ends):
        block[:size] = ids[end - size : end]
        row[2 : size + 2] = _numbered(block[:size])
    # After how many steps some blocks end before the others.
    short: dict[int, list[int]] = {}
    for block, size in enumerate(sizes):
        if size < steps:
            short.setdefault(size, []).append(block)
    widths = np.where(table.max(axis=1) >> 16 > 0, 4, 2)
    table, numbers = np.ascontiguousarray(table.T), np.ascontiguousarray(numbers.T)
    log: list[tuple[np.ndarray, np.ndarray]] = []
    code = _Range(blocks, lambda ready, low: log.append((ready, (low >> _WORD).astype(np.uint32))))
    contexts, bytes_ = _Contexts(blocks), _Bytes(widths)
    counts = np.zeros((blocks, steps), dtype=np.int16)
    known = np.zeros(blocks, dtype=np.int64)
    low, log_end = np.zeros(blocks, dtype=_U), np.full(blocks, 1 << 40)

    for begin in range(0, steps, REFRESH):
        end = min(begin + REFRESH, steps)
        number, one, two = (numbers[begin + k : end + k].astype(np.int64) for k in (2, 1, 0))
        chunk = _Chunk(contexts, begin, number, (one, two), counts, known)
        bytes_.renew()
        escapes = []
        row, block = np.nonzero(chunk.new)
        ids_new = table[begin:end][row, block].astype(np.int64)
        for k in bytes_.places:
            wide = widths[block] > k
            some, byte = block[wide], ids_new[wide] >> 8 * k & 255
            start, size = (a.astype(_U) for a in bytes_.range(k, some, byte))
            bytes_.add(k, some, byte)
            bounds = np.searchsorted(row[wide], np.arange(end - begin + 1)).tolist()
            escapes.append((k, some, start, size, bounds))
        for step in range(end - begin):
            if begin + step in short:
                ended = short[begin + step]
                low[ended], log_end[ended] = code.low[ended], len(log)
            code.narrow(code.width >> _U(MIX_BITS), chunk.start[step], chunk.size[step])
            code.narrow(code.width // chunk.total[step], chunk.start0[step], chunk.size0[step])
            for k, some, start, size, bounds in escapes:
                a, b = bounds[step], bounds[step + 1]
                if a < b:
                    if k % 2:
                        code.settle(some[a:b])
                    code.narrow_some(some[a:b], code.width.take(some[a:b]) >> _U(BYTE_BITS), start[a:b], size[a:b])
            code.settle()
    # What a block wrote after its end is not part of it.
    low = np.where(log_end < 1 << 40, low, code.low)
    every = np.arange(blocks)
    if log:
        owner, words = (np.concatenate(column) for column in zip(*log))
        keep = np.repeat(np.arange(len(log)), [len(ready) for ready, _ in log]) < log_end.take(owner)
        log = [(owner[keep], words[keep])]
    log.insert(0, (every, widths.astype(np.uint32)))
    log += [(every, (low >> _WORD).astype(np.uint32)), (every, (low & _LOW).astype(np.uint32))]
    owner, words = (np.concatenate(column) for column in zip(*log))
    order = np.argsort(owner.astype(np.int32), kind="stable")
    return np.split(words[order], np.cumsum(np.bincount(owner, minlength=blocks))[:-1])


# A tree of three levels with 16 branches holds the counts of up to 4,096 numbers.
_LATER = np.tri(16, k=-1, dtype=np.uint16).T.copy()
# The 16 counts of a node as one thing to copy.
_NODE = np.dtype("V32")


class _Counts:
    """How often each number occurred in each block, with sums over all smaller numbers.

    A node keeps for each branch the count of the branches before it. Nodes of the second level
    come first in ``below``, those of the third after them.
    """

    def __init__(self, blocks: int) -> None:
        self.top = np.zeros((blocks, 16), dtype=np.uint16)
        self.below = np.zeros(blocks * (16 + 256), dtype=_NODE)
        self.count = np.zeros(blocks * BLOCK_IDS, dtype=np.uint16)
        self.second, self.third = np.arange(blocks) * 16, np.arange(blocks) * 256 + blocks * 16
        self.own = np.arange(blocks) * BLOCK_IDS

    def find(self, block: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number whose range holds ``place``, which lies below the count of all; where it starts, and its count."""
        number, rest = np.zeros(len(block), dtype=np.int64), place.astype(np.uint16)
        first_place = np.arange(0, 16 * len(block), 16)
        for first in (None, self.second, self.third):
            nodes = self.top.view(_NODE).ravel().take(block) if first is None else self.below.take(first.take(block) + number)
            rows = nodes.view(np.uint16)
            # Sixteen answers are two words of bytes that are 0 or 1.
            lower = np.bitwise_count((rows.reshape(-1, 16) <= rest[:, None]).view(np.uint64))
            branch = lower[:, 0].astype(np.int64) + lower[:, 1] - 1
            rest -= rows.take(first_place + branch)
            number = number * 16 + branch
        return number, place - rest, self.count.take(self.own.take(block) + number)

    def add(self, number: np.ndarray) -> None:
        """One more of ``number`` in each of all blocks."""
        high = number >> 4
        self.top += _LATER.take(number >> 8, axis=0)
        nodes = np.concatenate([self.second + (number >> 8), self.third + high])
        rows = self.below.take(nodes)
        more = _LATER.view(_NODE).ravel().take(np.concatenate([high, number]) & 15)
        counts = rows.view(np.uint64)
        counts += more.view(np.uint64)
        self.below[nodes] = rows
        self.count[self.own + number] += 1


def decode_blocks(coded: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    """The ids of blocks coded by ``encode_blocks``."""
    if not sizes:
        return np.empty(0, dtype=np.int64)
    blocks, steps, longest = len(sizes), max(sizes), max(map(len, coded)) + 2
    words = np.zeros((blocks, longest), dtype=np.uint32)
    for row, block in zip(words, coded):
        row[: len(block)] = block
    widths = words[:, 0].astype(np.int64)
    if not np.isin(widths, (2, 4)).all():
        raise ValueError("a block of ids is damaged")
    code = (words[:, 1].astype(_U) << _WORD) | words[:, 2]
    # The next word of each block; a block that has ended goes on with its last word.
    words, place, stop = words.ravel(), np.arange(blocks) * longest + 3, np.arange(1, blocks + 1) * longest - 1

    def take(ready: np.ndarray, _: np.ndarray) -> None:
        at = np.minimum(place.take(ready), stop.take(ready))
        code[ready] = (code.take(ready) << _WORD) | words.take(at)
        place[ready] = at + 1

    span, contexts, bytes_, counts = _Range(blocks, take), _Contexts(blocks), _Bytes(widths), _Counts(blocks)
    found = np.zeros((steps, blocks), dtype=np.int16)
    ids_of = np.zeros(blocks * BLOCK_IDS, dtype=np.uint32)
    known = np.zeros(blocks, dtype=np.int64)
    one = two = np.zeros(blocks, dtype=np.int64)
    owners: dict[int, np.ndarray] = {}

    def inside(some: np.ndarray, part: np.ndarray, total: np.ndarray | int) -> np.ndarray:
        value = (code.take(some) - span.low.take(some)) // part
        return np.minimum(value, np.asarray(total - 1).astype(_U)).astype(np.int64)

    for step in range(steps):
        if step % REFRESH == 0:
            bytes_.renew()
            owners = {k: bytes_.owners(k) for k in bytes_.places}
        at = contexts.places(one, two)
        entry = contexts.table.take(at)
        sure, seen = entry & TOP_CONFIDENCE, entry >> 3
        same = seen[:blocks] == seen[blocks:]
        useful, kind = contexts.useful(sure, same), contexts.kinds(sure, same)
        odds = [c.take(kind) for c in contexts.chance]
        first, second = contexts.parts(odds, useful)
        part = span.width >> _U(MIX_BITS)
        value = np.minimum((code - span.low) // part, _U(_WHOLE - 1)).astype(np.int32)
        hit, known_to_both = value < first, value < second
        start = np.where(hit, 0, np.where(known_to_both, first, second))
        end = np.where(hit, first, np.where(known_to_both, second, _WHOLE))
        span.narrow(part, start.astype(_U), (end - start).astype(_U))
        number = np.where(hit, seen[blocks:], seen[:blocks]).astype(np.int64)
        rest = np.flatnonzero(~known_to_both)
        if len(rest):
            escape = np.maximum(known.take(rest), 1)
            total = escape + step
            part = span.width.take(rest) // total.astype(_U)
            value = inside(rest, part, total)
            new = value >= step
            old, fresh = np.flatnonzero(~new), np.flatnonzero(new)
            start, size = np.full(len(rest), step), escape
            number[rest] = known.take(rest)
            if len(old):
                number[rest.take(old)], start[old], size[old] = counts.find(rest.take(old), value.take(old))
            span.narrow_some(rest, part, start.astype(_U), size.astype(_U))
            fresh = rest.take(fresh)
            for k in bytes_.places if len(fresh) else ():
                some = fresh[widths.take(fresh) > k]
                if not len(some):
                    continue
                if k % 2:
                    span.settle(some)
                part = span.width.take(some) >> _U(BYTE_BITS)
                byte = owners[k].take((some << BYTE_BITS) + inside(some, part, 1 << BYTE_BITS)).astype(np.int64)
                start, size = bytes_.range(k, some, byte)
                span.narrow_some(some, part, start.astype(_U), size.astype(_U))
                bytes_.seen[k][some * 256 + byte] += 1
                ids_of[some * BLOCK_IDS + known.take(some)] |= (byte << 8 * k).astype(np.uint32)
        span.settle()
        found[step] = number
        aims = [hit * np.int32(65535), (known_to_both & ~hit) * np.int32(65535)]
        contexts.trust(kind, odds, aims, (useful[1], useful[0] & ~hit))
        twice = np.concatenate([number, number]).astype(np.int16)
        contexts.follow(at, entry, sure, seen == twice, twice << 3)
        counts.add(number)
        known = np.maximum(known, number + 1)
        one, two = number, one
    flat = np.empty(sum(sizes), dtype=np.int64)
    end = 0
    for ids, number, size in zip(ids_of.reshape(blocks, BLOCK_IDS), np.ascontiguousarray(found.T), sizes):
        flat[end : end + size] = ids.take(number[:size])
        end += size
    return flat


# ---- segments: some documents' ids with their coded blocks ----

MAGIC = b"TGIDS1\0\0"
HEADER = "<8sQQQ"  # magic, document pieces, ids, blocks


@dataclass(frozen=True)
class Pieces:
    """Which ids of a segment belong to which document.

    ``doc_id`` where ``known``; the document has ``whole`` ids in all, ``before`` of them in
    earlier segments and ``size`` in this one.
    """

    doc_id: np.ndarray
    known: np.ndarray
    whole: np.ndarray
    before: np.ndarray
    size: np.ndarray


def write_segment(pieces: Pieces, ids: np.ndarray) -> bytes:
    return write_segments([(pieces, ids)])[0]


def write_segments(segments: list[tuple[Pieces, np.ndarray]]) -> list[bytes]:
    """Each as ``write_segment`` gives it, with all their blocks coded side by side."""
    sizes = [_blocks_of(ids) for _, ids in segments]
    every = iter(encode_blocks(np.concatenate([ids for _, ids in segments]), list(chain(*sizes)))) if segments else iter(())
    return [_packed(p, ids, own, list(islice(every, len(own)))) for (p, ids), own in zip(segments, sizes)]


def _packed(pieces: Pieces, ids: np.ndarray, sizes: list[int], coded: list[np.ndarray]) -> bytes:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    raw = ids.astype("<u4")
    sums = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
    return b"".join(
        [
            struct.pack(HEADER, MAGIC, len(pieces.doc_id), len(ids), len(sizes)),
            *(a.astype("<i8").tobytes() for a in (pieces.doc_id, pieces.known, pieces.whole, pieces.before, pieces.size)),
            np.array([len(c) for c in coded], dtype="<u4").tobytes(),
            np.array(sums, dtype="<u4").tobytes(),
            *(c.astype("<u4").tobytes() for c in coded),
        ]
    )


def read_segment(data: bytes) -> tuple[Pieces, np.ndarray]:
    """The inverse; a block whose ids do not have the stored checksum is an error."""
    return read_segments([data])[0]


def read_segments(segments: list[bytes]) -> list[tuple[Pieces, np.ndarray]]:
    """Each as ``read_segment`` gives it, with all their blocks decoded side by side."""
    parsed = [_unpacked(data) for data in segments]
    ids = decode_blocks([c for _, coded, _, _ in parsed for c in coded], [s for _, _, sizes, _ in parsed for s in sizes])
    found, end = [], 0
    for pieces, _, sizes, sums in parsed:
        begin, end = end, end + sum(sizes)
        own = ids[begin:end]
        raw = own.astype("<u4")
        for b, expected in enumerate(sums):
            if zlib.crc32(raw[b * BLOCK_IDS : (b + 1) * BLOCK_IDS].tobytes()) != expected:
                raise ValueError(f"block {b} of a segment is damaged")
        found.append((pieces, own))
    return found


def _unpacked(data: bytes) -> tuple[Pieces, list[np.ndarray], list[int], np.ndarray]:
    """The pieces, and the words, sizes and checksums of the blocks."""
    magic, n, total, blocks = struct.unpack_from(HEADER, data)
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    at = struct.calcsize(HEADER)
    tables = np.frombuffer(data, "<i8", 5 * n, at).reshape(5, n)
    at += tables.nbytes
    counts, sums = np.frombuffer(data, "<u4", 2 * blocks, at).reshape(2, blocks)
    at += 8 * blocks
    words = np.frombuffer(data, "<u4", int(counts.sum()), at)
    ends = np.cumsum(counts.astype(np.int64))
    sizes = [min(BLOCK_IDS, total - b * BLOCK_IDS) for b in range(blocks)]
    return Pieces(*tables), np.split(words, ends[:-1]) if blocks else [], sizes, sums
