"""Best items per user over all items, by dot product of factors.

The items are stored once, the longest vectors first, in files of bounded size. Users are cut into
blocks, one block a task, and each task reads the files one after the other. No product exceeds the
product of the lengths, so a user is done once the items to come are too short to reach the k-th
score, and a task stops when all its users are. Nothing but the users goes through a shuffle. A
task holds the factors and the current best k of its users, nothing that grows with the number
of items, and returns k rows a user.

Items travel to each block through the shuffle where all these copies together are small, and
where Python cannot open the shared folder. Both ways give the same lists.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.sources.workspace import fresh_path

# The functions below travel to the workers inside the task, so the package need not be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bytes that a task may hold for its users: factors as doubles, the k best, and room to merge.
BLOCK_BYTES = 64 << 20
# Upper bound for the score matrix of one step, in numbers.
SCORES_PER_STEP = 1_000_000
# Bytes of the factors in one file of items, and items that a task reads at a time.
ITEM_FILE_BYTES = 64 << 20
ITEMS_PER_STEP = 4_096
# Copies of the items for all blocks, in bytes, that a shuffle takes sooner than a stored table.
SHUFFLED_BYTES = 64 << 20
# Room for rounding between a score and the bound on it.
SLACK = 1e-9
# A product of n numbers in single precision is off by less than SINGLE * (n + 4) times the two lengths, the
# rounding of the factors included, and SMALL * n where numbers vanish; lengths must stay below LONGEST_SINGLE.
SINGLE = 1.01 * 2.0**-24
SMALL = 1e-37
LONGEST_SINGLE = 1e15
# Lists are ranked again once a share of 1 / WAITING of all places waits.
WAITING = 4


@dataclass(frozen=True)
class ItemFiles:
    """Stored items: paths with the largest length of a vector in each, the longest first."""

    scheme: str
    paths: tuple[str, ...]
    longest: tuple[float, ...]


def _local(path: str) -> tuple[str, str]:
    """The file system and the path in it, as Python names them."""
    uri = path if "://" in path else "file://" + path.removeprefix("file:")
    # Spark and Arrow name one store differently.
    uri = uri.replace("s3a://", "s3://", 1)
    return uri.split("://", 1)[0] + "://", pyarrow.fs.FileSystem.from_uri(uri)[1]


def _file_system(scheme: str, path: str) -> pyarrow.fs.FileSystem:
    return pyarrow.fs.LocalFileSystem() if scheme == "file://" else pyarrow.fs.FileSystem.from_uri(scheme + path)[0]


def _open(scheme: str, path: str) -> pyarrow.parquet.ParquetFile:
    return pyarrow.parquet.ParquetFile(_file_system(scheme, path).open_input_file(path))


def store_items(items: DataFrame, width: int, number: int) -> ItemFiles | None:
    """Items with an ``id`` and ``features``, stored by length of the vector; null vectors go.

    None if Python on the driver cannot read the shared folder.
    """
    spark = items.sparkSession
    path = fresh_path(spark, "items")
    squares = F.aggregate("features", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    files = max(1, math.ceil(8 * width * number / ITEM_FILE_BYTES))
    measured = items.where(F.col("features").isNotNull()).select(
        F.col("id").cast("bigint").alias("id"), "features", F.sqrt(squares).alias("length")
    )
    ordered = measured.repartitionByRange(files, F.desc("length")) if files > 1 else measured.coalesce(1)
    ordered.sortWithinPartitions(F.desc("length")).write.option("parquet.block.size", 8 << 20).parquet(path)
    stored = spark.read.schema("id BIGINT, length DOUBLE").parquet(path)
    found = stored.groupBy("_metadata.file_path").agg(F.max("length").alias("longest")).orderBy(F.desc("longest")).collect()
    try:
        places = [_local(row["file_path"]) for row in found]
        for scheme, place in places[:1]:
            _open(scheme, place)
    except (OSError, NotImplementedError, ValueError, pa.ArrowException):
        return None
    scheme = places[0][0] if places else "file://"
    return ItemFiles(scheme, tuple(place for _, place in places), tuple(row["longest"] for row in found))


def top_items(
    users: DataFrame,
    items: DataFrame,
    k: int,
    score_type: str = "DOUBLE",
    users_per_block: int | None = None,
    stored: bool | None = None,
) -> DataFrame:
    """``user_id`` and ``recommendations``: the k best (item_id, rating), best first.

    Both frames hold a unique ``id`` and ``features`` of the same width; rows with null features
    take no part. Equal scores are ordered by item id. A block has as many users as fit in the
    memory of a task. ``stored`` names the way of the items, which else follows their size.
    """
    spark = users.sparkSession
    number, width = users.agg(F.count(F.lit(1)), F.max(F.size("features"))).first()
    if users_per_block is None:
        users_per_block = max(1, BLOCK_BYTES // (8 * (width or 1) + 48 * k))
    spread = min(spark.sparkContext.defaultParallelism, math.ceil(number / 64))
    blocks = max(1, math.ceil(number / users_per_block), spread)
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    key = F.col("id").cast("bigint").alias("id")
    schema = f"user_id BIGINT, recommendations ARRAY<STRUCT<item_id: BIGINT, rating: {score_type}>>"
    kind = pa.float32() if score_type == "FLOAT" else pa.float64()
    left = users.where(F.col("features").isNotNull()).select(block, F.lit(0).alias("side"), key, "features")
    many = items.count() if stored is not False else 0
    if stored is None:
        stored = blocks * many * 8 * (width or 1) > SHUFFLED_BYTES
    files = store_items(items, width or 1, many) if stored else None
    if files is not None:
        return left.repartitionById(blocks, F.col("block")).mapInArrow(_reader(k, kind, files), schema)
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    right = items.where(F.col("features").isNotNull()).select(every, F.lit(1).alias("side"), key, "features")
    tiles = left.unionByName(right).repartitionById(blocks, F.col("block")).sortWithinPartitions("side")
    return tiles.mapInArrow(_scorer(k, kind), schema)


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column("id").to_numpy(zero_copy_only=False)
    values = batch.column("features").flatten().to_numpy(zero_copy_only=False)
    return ids, values.reshape(len(ids), -1).astype(np.float64, copy=False)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest of each row; of equal scores those with the smallest ids."""
    if scores.shape[1] <= k:
        return scores, ids
    chosen = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    last = np.take_along_axis(scores, chosen, axis=1).min(axis=1)
    tied = np.flatnonzero((scores >= last[:, None]).sum(axis=1) > k)
    for row in tied:
        chosen[row] = np.lexsort((ids[row], -scores[row]))[:k]
    return np.take_along_axis(scores, chosen, axis=1), np.take_along_axis(ids, chosen, axis=1)


def _beside(row: np.ndarray, scores: np.ndarray, ids: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids, sorted by ``row``, side by side in their row, as wide as the row that has most; others give no room."""
    counts = np.bincount(row, minlength=number)
    width = int(counts.max(initial=0))
    best, names = np.full((number, width), -np.inf), np.full((number, width), np.iinfo(np.int64).max)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    best[row, place], names[row, place] = scores, ids
    return best, names


def _marked(flags: np.ndarray) -> np.ndarray:
    """Places of the few true flags, looked up eight at a time."""
    whole = len(flags) // 8 * 8
    eights = np.flatnonzero(flags[:whole].view(np.uint64))
    at, inside = np.nonzero(flags[:whole].reshape(-1, 8)[eights])
    return np.concatenate([eights[at] * 8 + inside, whole + np.flatnonzero(flags[whole:])])


class _Block:
    """Users of one task and their best items so far.

    Once the lists are full, a product in single precision finds the pairs whose score may enter: it is
    off by less than a bound, which is taken from the last score of the list. Only these are scored in
    doubles. They wait until there is a share of a list for each user, then all lists are ranked again;
    a list that is behind lets more pairs in and loses none.
    """

    def __init__(self, ids: list[np.ndarray], factors: list[np.ndarray], k: int) -> None:
        self.k = k
        self.ids, self.matrix = np.concatenate(ids), np.concatenate(factors)
        self.lengths = np.sqrt(np.einsum("ij,ij->i", self.matrix, self.matrix))
        with np.errstate(over="ignore"):
            self.single = self.matrix.astype(np.float32)
        self._scores = np.empty((len(self.ids), 0))
        self._items = np.empty((len(self.ids), 0), dtype=np.int64)
        self.last = np.full(len(self.ids), -np.inf)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waits = 0

    @property
    def scores(self) -> np.ndarray:
        self.settle()
        return self._scores

    @property
    def items(self) -> np.ndarray:
        self.settle()
        return self._items

    def open(self, longest: float) -> np.ndarray:
        """The users whose list items of that length may still enter, ties included."""
        if self._scores.shape[1] < self.k:
            return np.arange(len(self.ids))
        reach = self.lengths * longest
        # Written so that a length or score that is no number leaves the user open.
        return np.flatnonzero(~(reach + SLACK * (1 + reach) < self.last))

    def add(self, item_ids: np.ndarray, items: np.ndarray, users: np.ndarray | None = None) -> None:
        """Score items for the given users, for all of them if the lists are not full."""
        if self._scores.shape[1] < self.k:
            self._fill(item_ids, items)
            return
        if users is None:
            users = np.arange(len(self.ids))
        longest = math.sqrt(np.einsum("ij,ij->i", items, items).max(initial=0.0))
        off = SINGLE * (items.shape[1] + 4) * (self.lengths[users] * longest) + SMALL * items.shape[1]
        # Lengths that single precision cannot hold, or that are no numbers, take doubles.
        fits = max(longest, self.lengths[users].max(initial=0.0)) < LONGEST_SINGLE
        left, right = (self.single, items.astype(np.float32)) if fits else (self.matrix, items)
        least = self.last[users] - (off if fits else SLACK * (1 + np.abs(self.last[users])))
        least = np.nextafter(least.astype(left.dtype), left.dtype.type(-np.inf))
        step = max(1, SCORES_PER_STEP // len(item_ids)) if len(item_ids) else len(users)
        for at in range(0, len(users), step):
            rows = users[at : at + step]
            enters = left[rows] @ right.T >= least[at : at + step, None]
            row, column = np.divmod(_marked(enters.ravel()), max(1, len(item_ids)))
            if not len(row):
                continue
            row = rows[row]
            exact = np.empty(len(row))
            some = max(1, SCORES_PER_STEP // max(1, items.shape[1]))
            for low in range(0, len(row), some):
                part = slice(low, low + some)
                exact[part] = np.einsum("ij,ij->i", self.matrix[row[part]], items[column[part]])
            stays = exact >= self.last[row]
            self.waiting.append((row[stays], exact[stays], item_ids[column[stays]]))
            self.waits += len(self.waiting[-1][0])
            if self.waits * WAITING >= len(self.ids) * self.k:
                self.settle()

    def _fill(self, item_ids: np.ndarray, items: np.ndarray) -> None:
        """All items for all users, as long as the lists are not full."""
        width = min(self.k, self._scores.shape[1] + len(item_ids))
        scores, names = np.empty((len(self.ids), width)), np.empty((len(self.ids), width), dtype=np.int64)
        step = max(1, SCORES_PER_STEP // (len(item_ids) + self.k))
        for at in range(0, len(self.ids), step):
            rows = slice(at, at + step)
            fresh = self.matrix[rows] @ items.T
            scores[rows], names[rows] = _best(
                np.concatenate([self._scores[rows], fresh], axis=1),
                np.concatenate([self._items[rows], np.broadcast_to(item_ids, fresh.shape)], axis=1),
                self.k,
            )
        self._scores, self._items = scores, names
        if width == self.k:
            self.last = scores.min(axis=1)

    def settle(self) -> None:
        """Rank the lists again with the pairs that wait."""
        if not self.waits:
            return
        row, scores, ids = (np.concatenate(c) for c in zip(*self.waiting))
        self.waiting, self.waits = [], 0
        order = np.argsort(row, kind="stable")
        row, scores, ids = row[order], scores[order], ids[order]
        met, place = np.unique(row, return_inverse=True)
        ends = np.searchsorted(place, np.arange(len(met)), "right")
        done, low = 0, 0
        while done < len(met):
            # As many users as a step takes, by the one that has most.
            step = max(1, SCORES_PER_STEP // (self.k + int(np.diff(ends[done:], prepend=low).max())))
            users = met[done : done + step]
            high = int(ends[done + len(users) - 1])
            part = slice(low, high)
            fresh, names = _beside(place[part] - done, scores[part], ids[part], len(users))
            self._scores[users], self._items[users] = _best(
                np.concatenate([self._scores[users], fresh], axis=1),
                np.concatenate([self._items[users], names], axis=1),
                self.k,
            )
            self.last[users] = self._scores[users].min(axis=1)
            done, low = done + len(users), high


def _visit(block: _Block, steps: Iterator[tuple[np.ndarray, np.ndarray, float]]) -> int:
    """Score items, the longest first, until no list can change; the number of steps taken."""
    taken = 0
    for item_ids, items, longest in steps:
        users = block.open(longest)
        if not len(users):
            break
        block.add(item_ids, items, users)
        taken += 1
    return taken


def _steps(files: ItemFiles, block: _Block) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Items of the files in steps; a file is not opened when nothing in it is long enough."""
    for path, longest in zip(files.paths, files.longest):
        if not len(block.open(longest)):
            return
        for batch in _open(files.scheme, path).iter_batches(ITEMS_PER_STEP):
            yield *_matrix(batch), batch.column("length")[0].as_py()


def _reader(k: int, kind: pa.DataType, files: ItemFiles) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_matrix(batch) for batch in batches if batch.num_rows]
        if held:
            block = _Block(*map(list, zip(*held)), k)
            _visit(block, _steps(files, block))
            yield from _lists(block.ids, block.scores, block.items, kind)

    return score


def _scorer(k: int, kind: pa.DataType) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = [], None
        for batch in batches:
            sides = batch.column("side").to_numpy(zero_copy_only=False)
            split = int(np.searchsorted(sides, 1))
            if split:
                held.append(_matrix(batch.slice(0, split)))
            if split == batch.num_rows or not held:
                continue
            block = block or _Block(*map(list, zip(*held)), k)
            block.add(*_matrix(batch.slice(split)))
        if held:
            block = block or _Block(*map(list, zip(*held)), k)
            yield from _lists(block.ids, block.scores, block.items, kind)

    return score


def _lists(
    users: np.ndarray, scores: np.ndarray, ids: np.ndarray, kind: pa.DataType
) -> Iterator[pa.RecordBatch]:
    """Sorted lists as Arrow batches of bounded size; no list is empty."""
    width = scores.shape[1]
    if not width:
        return
    step = max(1, SCORES_PER_STEP // max(width, 1) // 8)
    for at in range(0, len(users), step):
        part, names = scores[at : at + step], ids[at : at + step]
        order = np.lexsort((names, -part), axis=1)
        flat = np.take_along_axis(part, order, axis=1).ravel()
        items = np.take_along_axis(names, order, axis=1).ravel()
        entries = pa.StructArray.from_arrays(
            [pa.array(items, pa.int64()), pa.array(flat, pa.float64()).cast(kind)],
            names=["item_id", "rating"],
        )
        offsets = np.arange(0, len(part) * width + 1, width, dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)
        yield pa.RecordBatch.from_arrays(
            [pa.array(users[at : at + step], pa.int64()), lists],
            names=["user_id", "recommendations"],
        )
