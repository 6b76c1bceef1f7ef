"""Groups of spelling variants: k-d trees over the letter counts of words.

One inserted or deleted letter changes the letter counts of a word by one, one replaced letter by
two, so words that are one edit apart lie within a distance of two (sum of differences). Space
is cut by a k-d tree on length and letter counts, fitted to a bounded sample; each word is stored
in the one box that holds it, and sent to all boxes its distance reaches, for its own length and
the next. A task builds a finer tree for each length in its box, prunes by boxes again, and
compares the letters, in order, of what is left. Boxes with too many letters are dealt over
several tasks. All words are searched: the sample decides only where boxes end.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.shelf import Shelf

# The functions below travel to the workers inside the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Letters are counted in columns by code point, so that words of any script have counts. Letters
# that share a column only make distances smaller, which loses no pair.
COLUMNS = 96
LENGTH = COLUMNS  # the number of the dimension that is the length
MOST = 255  # counts above are cut off, which makes no distance larger either
REACH = 2

# Words that a task holds counts for before it passes them on, and words it searches at a time.
WORDS_AT_ONCE = 500_000
QUERIES_AT_ONCE = 32_000
LETTERS_AT_ONCE = 4_000_000
# Words in the smallest box of a task, and the most pairs it compares at a time.
BOX_WORDS = 48
PAIRS_AT_ONCE = 1_000_000


@dataclass(frozen=True)
class SpellingConfig:
    """``sample`` words decide where boxes end; a task holds about ``box_letters`` letters."""

    min_chars: int = 5
    min_count: int = 3
    drop_one_in: int | None = 97
    times: int = 2
    sample: int = 20_000
    box_letters: int = 100_000


# ---- words ----

_RUN = "[A-Za-zÀ-ÿ]"


def _count_job(cfg: SpellingConfig) -> Callable:
    # Shorter runs give no word, whether they lose a letter or not.
    runs = re.compile(f"{_RUN}{{{max(1, cfg.min_chars)},}}")

    def passed_on(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
        )

    def altered(doc_id: object, found: Counter) -> Counter:
        """Runs of one document; one in some loses a letter, the same each time it occurs."""
        seed = crc32(f"{'' if doc_id is None else doc_id}:".encode())
        changed = {}
        for run in found:
            h = crc32(run.encode(), seed)
            if h % cfg.drop_one_in == 0:
                at = h % len(run)
                changed[run] = run[:at] + run[at + 1 :]
        moved = [(word, found.pop(run)) for run, word in changed.items()]
        for word, n in moved:
            if len(word) >= cfg.min_chars:
                found[word] += n
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                if not text.is_valid:
                    continue
                # On bytes, only A to Z are lowered.
                found = Counter(runs.findall(text.as_py().encode().lower().decode()))
                counts.update(altered(doc_id, found) if cfg.drop_one_in else found)
                if len(counts) > WORDS_AT_ONCE:
                    yield passed_on(counts)
                    counts = Counter()
        yield passed_on(counts)

    return run


def word_counts(docs: DataFrame, cfg: SpellingConfig = SpellingConfig()) -> DataFrame:
    """``word, n``: words of enough letters and occurrences in all texts.

    A null or empty text has no words. Rows that repeat count each time; a null doc_id is hashed
    as an empty one. Only ``doc_id`` and ``text`` are read.
    """
    partial = docs.select("doc_id", "text").mapInArrow(_count_job(cfg), "word STRING, n BIGINT")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= cfg.min_count)


# ---- letter counts and boxes ----


@dataclass(frozen=True)
class Letters:
    """Words as one run of code points, and their letter counts."""

    codes: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(words: list[str]) -> Letters:
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, count=len(words))
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        cell = np.repeat(np.arange(len(words)), lengths) * COLUMNS + codes % COLUMNS
        counts = np.bincount(cell, minlength=len(words) * COLUMNS).reshape(len(words), COLUMNS)
        return Letters(codes, starts, lengths, np.minimum(counts, MOST).astype(np.uint8))

    def rows(self, which: np.ndarray, length: int) -> np.ndarray:
        """The letters of words of one length, a word a row."""
        return self.codes[self.starts[which][:, None] + np.arange(length)]


@dataclass(frozen=True)
class Node:
    """A cut of space (words up to ``at`` in ``dim`` go left), or a box with a number."""

    box: int = -1
    dim: int = -1
    at: int = 0
    left: Node | None = None
    right: Node | None = None


def _best_cut(points: np.ndarray) -> tuple[int, int] | None:
    """The cut into the most equal halves; a cut by length is taken if it is nearly as good."""
    best, found = 0.0, None
    for dim in range(points.shape[1]):
        column = points[:, dim]
        at = int(np.partition(column, (len(column) - 1) // 2)[(len(column) - 1) // 2])
        for cut in (at - 1, at):
            low = int((column <= cut).sum())
            worth = min(low, len(column) - low) * (2.0 if dim == LENGTH else 1.0)
            if worth > best:
                best, found = worth, (dim, cut)
    return found


def fit_boxes(points: np.ndarray, boxes: int) -> tuple[Node, int]:
    """A tree of about so many boxes over sampled points, and how many boxes it has."""
    numbers = iter(range(1 << 62))

    def grow(part: np.ndarray, share: float) -> Node:
        cut = _best_cut(part) if share > 1 and len(part) > 1 else None
        if cut is None:
            return Node(box=next(numbers))
        dim, at = cut
        low = part[:, dim] <= at
        ratio = float(low.mean())
        return Node(dim=dim, at=at, left=grow(part[low], share * ratio), right=grow(part[~low], share * (1 - ratio)))

    tree = grow(points, float(boxes))
    return tree, next(numbers)


def _home(tree: Node, points: np.ndarray) -> np.ndarray:
    """The box that holds each point."""
    found = np.empty(len(points), dtype=np.int32)
    todo = [(tree, np.arange(len(points)))]
    while todo:
        node, rows = todo.pop()
        if node.box >= 0:
            found[rows] = node.box
            continue
        low = points[rows, node.dim] <= node.at
        todo += [(node.left, rows[low]), (node.right, rows[~low])]
    return found


def _visits(tree: Node, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of point and box: the boxes with a point in reach, of its length or the next."""
    rows_found, boxes_found = [], []
    unbounded = (-1, 1 << 30)
    todo = [(tree, np.arange(len(points)), np.zeros(len(points), dtype=np.int64), {})]
    while todo:
        node, rows, far, bounds = todo.pop()
        if not len(rows):
            continue
        if node.box >= 0:
            rows_found.append(rows)
            boxes_found.append(np.full(len(rows), node.box, dtype=np.int32))
            continue
        low, high = bounds.get(node.dim, unbounded)
        value = points[rows, node.dim].astype(np.int64)
        if node.dim == LENGTH:
            left, right = value <= node.at, value + 1 > node.at
            todo.append((node.left, rows[left], far[left], bounds))
            todo.append((node.right, rows[right], far[right], bounds))
            continue
        now = np.maximum(0, np.maximum(low - value, value - high))
        for child, a, b in ((node.left, low, node.at), (node.right, node.at + 1, high)):
            further = far - now + np.maximum(0, np.maximum(a - value, value - b))
            near = further <= REACH
            todo.append((child, rows[near], further[near], bounds | {node.dim: (a, b)}))
    if not rows_found:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    return np.concatenate(rows_found), np.concatenate(boxes_found)


def _points(letters: Letters) -> np.ndarray:
    return np.concatenate([letters.counts.astype(np.int32), letters.lengths[:, None].astype(np.int32)], axis=1)


def _point_job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Points as bytes, so that a long word is no longer than a short one."""
    for batch in batches:
        points = _points(Letters.of(batch.column("word").to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in points], pa.binary())], names=["point"])


def _home_job(tree: Node) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = Letters.of(batch.column("word").to_pylist())
            arrays = [pa.array(_home(tree, _points(letters))), pa.array(letters.lengths)]
            yield pa.RecordBatch.from_arrays(arrays, names=["box", "letters"])

    return run


def _route_job(tree: Node, first: np.ndarray, tasks: np.ndarray) -> Callable:
    """Each word to one task of its box, and as a query to all tasks of all boxes in reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            points = _points(Letters.of(words))
            home = _home(tree, points)
            share = np.fromiter((crc32(w.encode()) for w in words), np.int64, count=len(words)) % tasks[home]
            rows, boxes = _visits(tree, points)
            times = tasks[boxes]
            into = np.repeat(first[boxes], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            task = np.concatenate([first[home] + share, into])
            side = np.concatenate([np.zeros(len(words), np.int8), np.ones(len(into), np.int8)])
            which = pa.array(np.concatenate([np.arange(len(words)), np.repeat(rows, times)]))
            for at in range(0, len(task), WORDS_AT_ONCE):
                part = slice(at, at + WORDS_AT_ONCE)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(task[part].astype(np.int32)),
                        pa.array(side[part]),
                        batch.column("word").take(which[part]),
                        batch.column("n").take(which[part]),
                    ],
                    names=["task", "side", "word", "n"],
                )

    return run


# ---- the search of one task ----


class _Tree:
    """The words of one length in a box, cut into small boxes by their letter counts.

    A box keeps the counts of its words as bits, as many for a letter as its count, so that a
    distance is the number of differing bits.
    """

    def __init__(self, letters: Letters, which: np.ndarray, length: int) -> None:
        self.letters, self.length = letters, length
        counts = letters.counts[which]
        self.most = counts.max(axis=0)
        self.bits = _bits(counts, self.most)
        self.which = which
        self.root = self._grow(counts, np.arange(len(which)))

    def _grow(self, counts: np.ndarray, rows: np.ndarray) -> tuple:
        if len(rows) > BOX_WORDS:
            part = counts[rows]
            middle = np.partition(part, len(rows) // 2, axis=0)[len(rows) // 2]
            low = (part < middle).sum(axis=0)
            high = (part > middle).sum(axis=0)
            # Cut below the middle value, or above it.
            below, above = np.minimum(low, len(rows) - low), np.minimum(high, len(rows) - high)
            dim = int(np.argmax(np.maximum(below, above)))
            if max(below[dim], above[dim]):
                at = int(middle[dim]) - (1 if below[dim] >= above[dim] else 0)
                left = part[:, dim] <= at
                return dim, at, self._grow(counts, rows[left]), self._grow(counts, rows[~left])
        return (rows,)

    def search(self, counts: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of query and word with letter counts in reach."""
        # Letters that no word here has count whole.
        absent = np.maximum(counts.astype(np.int16) - self.most, 0).sum(axis=1)
        bits = _bits(np.minimum(counts, self.most), self.most)
        start = np.flatnonzero(absent <= reach)
        todo = [(self.root, start, absent[start].astype(np.int16), {})]
        while todo:
            node, rows, far, bounds = todo.pop()
            if not len(rows):
                continue
            if len(node) == 1:
                words = node[0]
                step = max(1, PAIRS_AT_ONCE // len(words))
                for at in range(0, len(rows), step):
                    some = rows[at : at + step]
                    apart = absent[some].astype(np.int16)[:, None]
                    for word in range(self.bits.shape[1]):
                        differ = bits[some, word][:, None] ^ self.bits[words, word][None, :]
                        apart = apart + np.bitwise_count(differ)
                    q, w = np.nonzero(apart <= reach)
                    yield some[q], self.which[words[w]]
                continue
            dim, cut, left, right = node
            low, high = bounds.get(dim, (0, MOST))
            value = np.minimum(counts[rows, dim], self.most[dim]).astype(np.int16)
            now = np.maximum(0, np.maximum(low - value, value - high))
            for child, a, b in ((left, low, cut), (right, cut + 1, high)):
                further = far - now + np.maximum(0, np.maximum(a - value, value - b))
                near = further <= reach
                todo.append((child, rows[near], further[near], bounds | {dim: (a, b)}))


def _bits(counts: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Counts as runs of set bits, packed into 64-bit words."""
    dims = np.repeat(np.arange(COLUMNS), most)
    steps = np.concatenate([np.arange(m) for m in most]) if len(dims) else np.empty(0, np.int64)
    packed = np.packbits(counts[:, dims] > steps, axis=1)
    words = max(1, -(-packed.shape[1] // 8))
    padded = np.zeros((len(counts), words * 8), dtype=np.uint8)
    padded[:, : packed.shape[1]] = packed
    return padded.view(np.uint64)


def _gathered(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of small boxes put together, so that many are compared at a time."""
    held, number = [], 0
    for part in parts:
        if len(part[0]):
            held.append(part)
            number += len(part[0])
        if number >= PAIRS_AT_ONCE // 8:
            yield tuple(map(np.concatenate, zip(*held)))
            held, number = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def _one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of ``b``, one letter longer, are those of ``a`` with a letter put in."""
    length = a.shape[1]
    same_from_left = np.cumprod(a == b[:, :-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    same_from_right = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    return same_from_left + same_from_right >= length


class _Box:
    """The index of one task, by length of the words."""

    def __init__(self, words: list[str], numbers: list[int]) -> None:
        self.words, self.numbers = np.array(words, dtype=object), np.array(numbers, dtype=np.int64)
        self.letters = Letters.of(words)
        self.trees = {
            int(length): _Tree(self.letters, np.flatnonzero(self.letters.lengths == length), int(length))
            for length in np.unique(self.letters.lengths)
        }

    def pairs(self, words: list[str], numbers: list[int]) -> Iterator[pa.RecordBatch]:
        queries = Letters.of(words)
        names, sizes = np.array(words, dtype=object), np.array(numbers, dtype=np.int64)
        for length in np.unique(queries.lengths).tolist():
            mine = np.flatnonzero(queries.lengths == length)
            for other, reach in ((length, 2), (length + 1, 1)):
                tree = self.trees.get(other)
                if tree is None:
                    continue
                for q, w in _gathered(tree.search(queries.counts[mine], reach)):
                    yield from self._checked(queries, mine[q], w, length, other, names, sizes)

    def _checked(self, queries, q, w, length, other, names, sizes) -> Iterator[pa.RecordBatch]:
        step = max(1, 4 * PAIRS_AT_ONCE // max(length, 1))
        for at in range(0, len(q), step):
            i, j = q[at : at + step], w[at : at + step]
            a, b = queries.rows(i, length), self.letters.rows(j, other)
            near = _one_replaced(a, b) if length == other else _one_inserted(a, b)
            i, j = i[near], j[near]
            if length == other:
                # Such a pair is met from both sides.
                once = names[i] < self.words[j]
                i, j = i[once], j[once]
            if len(i):
                arrays = [pa.array(names[i], pa.string()), pa.array(sizes[i]), pa.array(self.words[j], pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, pa.array(self.numbers[j])], names=["word", "n", "near", "near_n"]
                )


class _Part:
    """Words held until there are enough."""

    def __init__(self) -> None:
        self.words: list[str] = []
        self.numbers: list[int] = []
        self.letters = 0

    def add(self, batch: pa.RecordBatch) -> None:
        self.words.extend(batch.column("word").to_pylist())
        self.numbers.extend(batch.column("n").to_pylist())
        self.letters += pc.sum(pc.utf8_length(batch.column("word"))).as_py()

    def full(self) -> bool:
        return len(self.words) >= QUERIES_AT_ONCE or self.letters >= LETTERS_AT_ONCE


def _search_job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by task, the words of the index before the queries."""
    task, box, index, queries = None, None, _Part(), _Part()

    def answers() -> Iterator[pa.RecordBatch]:
        nonlocal box, queries
        if index.words and queries.words:
            box = box or _Box(index.words, index.numbers)
            yield from box.pairs(queries.words, queries.numbers)
        queries = _Part()

    for batch in batches:
        tasks = np.asarray(batch.column("task"))
        sides = np.asarray(batch.column("side"))
        cuts = np.flatnonzero((np.diff(tasks) != 0) | (np.diff(sides) != 0)) + 1
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(tasks)]):
            if tasks[begin] != task:
                yield from answers()
                task, box, index = tasks[begin], None, _Part()
            (queries if sides[begin] else index).add(batch.slice(begin, end - begin))
            if queries.full():
                yield from answers()
    yield from answers()


PAIRS = "word STRING, n BIGINT, near STRING, near_n BIGINT"


def near_pairs(words: DataFrame, cfg: SpellingConfig = SpellingConfig()) -> DataFrame:
    """``word, n, near, near_n``: all pairs of words one edit apart, each pair once.

    ``words`` has distinct words in ``word`` and their number in ``n``; it is read three times, so
    it should be stored. Words are of any script. Besides the sample only the letters of each box
    come to the driver, as many numbers as there are tasks. No word has more near ones than its
    length allows: about twice as many as it has letters, for each letter of the alphabet.
    """
    letters = words.agg(F.sum(F.length("word")).alias("letters"), F.count(F.lit(1)).alias("words")).first()
    boxes = -(-(letters["letters"] or 0) // cfg.box_letters)
    one_in = max(1, (letters["words"] or 0) // cfg.sample)
    sampled = words.where(F.pmod(F.xxhash64("word"), F.lit(one_in)) == 0).select("word")
    rows = sampled.mapInArrow(_point_job, "point BINARY").collect()
    points = np.frombuffer(b"".join(r["point"] for r in rows), dtype=np.int32).reshape(len(rows), COLUMNS + 1)
    tree, number = fit_boxes(points, max(1, boxes))
    homes = words.select("word").mapInArrow(_home_job(tree), "box INT, letters BIGINT")
    sizes = dict(homes.groupBy("box").agg(F.sum("letters")).collect())
    tasks = np.array([max(1, -(-sizes.get(b, 0) // (2 * cfg.box_letters))) for b in range(number)], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(tasks)])
    routed = words.select("word", "n").mapInArrow(
        _route_job(tree, first[:-1], tasks), "task INT, side TINYINT, word STRING, n BIGINT"
    )
    dealt = routed.repartitionById(int(first[-1]), F.col("task")).sortWithinPartitions("task", "side")
    return dealt.mapInArrow(_search_job, PAIRS)


# ---- forms and roots ----


def variant_forms(docs: DataFrame, cfg: SpellingConfig = SpellingConfig()) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for the words of all texts.

    Near words differ by one inserted, deleted or replaced letter. The form of a word is its
    near word with the largest number, of equal ones the first, if that is ``times`` the own
    number or more. The root is where a walk along the forms ends. See ``word_counts`` on odd rows; no
    rows give no rows. Groups are small tables next to the texts: only words, never texts, are shuffled.
    """
    shelf = Shelf(docs.sparkSession)
    words = shelf.put("words", word_counts(docs, cfg))
    pairs = shelf.put("word-pairs", near_pairs(words, cfg))
    there = pairs.select("word", F.struct((-F.col("near_n")).alias("less"), "near").alias("other"))
    back = pairs.select(F.col("near").alias("word"), F.struct((-F.col("n")).alias("less"), F.col("word").alias("near")).alias("other"))
    best = there.unionByName(back).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("other").alias("best"))
    joined = words.join(best, "word", "left")
    fits = -F.col("best.less") >= cfg.times * F.col("n")
    named = joined.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(fits, F.col("best.near")).alias("form"),
        F.when(fits, -F.col("best.less")).alias("form_n"),
    )
    stored = shelf.put("word-forms", named)
    shelf.drop("word-pairs")
    roots = _roots(stored.where("form IS NOT NULL").select("word", "form"), shelf)
    full = stored.join(roots, "word", "left")
    return full.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame, shelf: Shelf) -> DataFrame:
    """The last word of the walk from each word that has a form.

    Each round doubles the steps taken. A walk has at most as many steps as numbers can double,
    so there are no more than six or seven rounds.
    """
    label, round_ = "word-roots-0", 0
    now = shelf.put(label, forms.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = now.join(onward, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
        )
        round_ += 1
        moved = shelf.put(f"word-roots-{round_}", step)
        shelf.drop(label)
        label = f"word-roots-{round_}"
        now = moved.select("word", "root")
        if not moved.where("moved").take(1):
            return now
