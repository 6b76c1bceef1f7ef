"""Alternating least squares over explicit ratings, in blocks of whole users and of whole items.

The ratings pass through one shuffle by user and one by item, once a fit, and stay on the executors
as blocks of bounded size: the ids of the block, and for each rating the place of the other id in the
list of those that the block needs. A half iteration is one map over the blocks of one side. Its tasks
write the factors to the shared folder, one Arrow file a block, and hand on the names only. The tasks of the
next half iteration take the rows that their block needs out of these files one after the other; a local file
is mapped, so that no other row is read. So no factor is sent once to each block,
and a task holds one block with its factors, however many users and items there are.

The equations are those of Spark ML: (X'X + reg n I) x = X'r for the n ratings r of an id and the
factors X of their other ids, in doubles. With fewer ratings than factors the same x comes from the
smaller system, X'(XX' + reg n I)^-1 r.
"""

from __future__ import annotations

import math
import sys
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.operators.scoring import _file_system, _local
from tastegrid.sources.workspace import fresh_path, remove

# The functions below travel to the workers inside the task, so the package need not be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Numbers in the factors of a block's ratings: at most, and what pays for a task of its own.
BLOCK_VALUES = 1 << 24
TASK_VALUES = 1 << 19
# Numbers in the factors that are solved for at a time.
STEP_VALUES = 1 << 19

BLOCKS = "ids BINARY, counts BINARY, others BINARY, at BINARY, ratings BINARY"
FILES = "path STRING, first INT, last INT"
ROWS = "id INT, features ARRAY<FLOAT>"
# Spark does not take names with an underscore for its own files.
FOLDER = "_factors"


@dataclass(frozen=True)
class FactorFiles:
    """Stored factors: files of sorted ids with their factors, no id in two of them, each with its first and last id."""

    scheme: str
    paths: tuple[str, ...]
    first: tuple[int, ...] = ()
    last: tuple[int, ...] = ()

    def rows(self, wanted: np.ndarray, rank: int) -> np.ndarray:
        """The factors of these sorted ids, which all have some, and a last row of zeros."""
        found = np.zeros((len(wanted) + 1, rank), dtype=np.float32)
        known = np.zeros(len(wanted), dtype=bool)
        lows, highs = np.searchsorted(wanted, self.first), np.searchsorted(wanted, self.last, "right")
        for path, low, high in zip(self.paths, lows, highs):
            if low == high:
                continue
            ids, values = _factors(self.scheme, path)
            at = np.searchsorted(ids, wanted[low:high])
            hit = np.flatnonzero(ids[at] == wanted[low:high])
            found[low + hit] = values[at[hit]]
            known[low + hit] = True
        if not known.all():
            raise ValueError("ids without factors")
        return found


def _factors(scheme: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and factors of one file; those of a local file are read as they are used."""
    file = pa.memory_map(path) if scheme == "file://" else _file_system(scheme, path).open_input_file(path)
    batch = pa.ipc.open_file(file).get_batch(0)
    ids = batch.column("ids").to_numpy()
    return ids, batch.column("features").flatten().to_numpy().reshape(len(ids), -1)


def _write_factors(scheme: str, folder: str, ids: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """A new file of sorted ids with their factors; its row of ``FILES``. A task that runs again writes another."""
    path = f"{folder}/{uuid.uuid4().hex}.arrow"
    flat = pa.array(np.ascontiguousarray(values, dtype=np.float32).ravel())
    lists = pa.FixedSizeListArray.from_arrays(flat, values.shape[1])
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), lists], names=["ids", "features"])
    with _file_system(scheme, path).open_output_stream(path) as file, pa.ipc.new_file(file, batch.schema) as out:
        out.write_batch(batch)
    ends = [pa.array([int(ids[i])], pa.int32()) for i in (0, -1)]
    return pa.RecordBatch.from_arrays([pa.array([path]), *ends], names=["path", "first", "last"])


def factor_folder(path: str) -> tuple[str, str] | None:
    """A new folder under ``path`` for the files of tasks; None if Python on the driver cannot write there."""
    try:
        scheme, place = _local(path)
        _file_system(scheme, place).create_dir(f"{place}/{FOLDER}", recursive=True)
    except (OSError, NotImplementedError, ValueError, pa.ArrowException):
        return None
    return scheme, f"{place}/{FOLDER}"


def factor_files(spark: SparkSession, path: str) -> FactorFiles | None:
    """The files that the table under ``path`` names; None if Python on the driver cannot read them."""
    found = sorted(tuple(row) for row in spark.read.schema(FILES).parquet(path).collect())
    try:
        scheme = _local(path)[0]
        for name, _, _ in found[:1]:
            _factors(scheme, name)
    except (OSError, NotImplementedError, ValueError, pa.ArrowException):
        return None
    return FactorFiles(scheme, *(zip(*found) if found else ()))


def _record(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    """One row with each array as its bytes."""
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=names)


def _block(keys: np.ndarray, others: np.ndarray, ratings: np.ndarray) -> pa.RecordBatch:
    ids, counts = np.unique(keys, return_counts=True)
    distinct, at = np.unique(others, return_inverse=True)
    return _record(BLOCKS, ids, counts.astype(np.int64), distinct, at.astype(np.int32), ratings)


def _block_job(per_block: int) -> Callable:
    """Sorted ratings cut into blocks of about ``per_block``, always between two keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += batch.num_rows
            last = held[-1][0][-1]
            if size >= per_block and held[0][0][0] != last:
                whole = [np.concatenate(c) for c in zip(*held)]
                end = int(np.searchsorted(whole[0], last))
                yield _block(*(c[:end] for c in whole))
                held, size = [[c[end:] for c in whole]], size - end
        if size:
            yield _block(*(np.concatenate(c) for c in zip(*held)))

    return run


def _pack_job(scheme: str, folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = batch.column("id").to_numpy(zero_copy_only=False)
                values = batch.column("features").flatten().to_numpy(zero_copy_only=False)
                yield _write_factors(scheme, folder, ids, values.reshape(len(ids), -1))

    return run


def _unpack_job(scheme: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                ids, values = _factors(scheme, path)
                rank = values.shape[1]
                step = max(1, STEP_VALUES // rank)
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    ends = np.arange(len(part) + 1, dtype=np.int32) * rank
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values[at : at + step].ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(part), lists], names=["id", "features"])

    return run


def _solve_long(near: np.ndarray, at: np.ndarray, ratings: np.ndarray, reg: float) -> np.ndarray:
    """The factors of one id with very many ratings, which are summed up step by step."""
    rank = near.shape[1]
    left, right = np.eye(rank) * (reg * len(at)), np.zeros(rank)
    step = max(1, STEP_VALUES // rank)
    for low in range(0, len(at), step):
        x = near[at[low : low + step]].astype(np.float64)
        left += x.T @ x
        right += x.T @ ratings[low : low + step]
    return np.linalg.solve(left, right)


def solve(counts: np.ndarray, at: np.ndarray, ratings: np.ndarray, near: np.ndarray, reg: float) -> np.ndarray:
    """The factors of each id: ``counts`` ratings of it in turn, ``at`` the row in ``near`` of the other id.

    The last row of ``near`` is zero. Ids are solved together with others of about as many
    ratings, filled up with zero rows, which add nothing.
    """
    rank, starts = near.shape[1], np.cumsum(counts) - counts
    found = np.empty((len(counts), rank), dtype=np.float32)
    order, place = np.argsort(counts, kind="stable"), 0
    sizes = counts[order]
    while place < len(order):
        if sizes[place] * rank > STEP_VALUES:
            low = starts[order[place]]
            rows = slice(low, low + sizes[place])
            found[order[place]] = _solve_long(near, at[rows], ratings[rows], reg)
            place += 1
            continue
        # Widths within an eighth of each other, and no more ids than a step takes.
        end = int(np.searchsorted(sizes, sizes[place] + sizes[place] // 8, "right"))
        many = STEP_VALUES // (int(sizes[end - 1]) * rank + rank * rank)
        end = min(end, place + max(1, many))
        some, width = order[place:end], int(sizes[end - 1])
        inside = np.arange(width) < counts[some][:, None]
        rows = np.where(inside, starts[some][:, None] + np.arange(width), 0)
        x = near[np.where(inside, at[rows], len(near) - 1)].astype(np.float64)
        r = np.where(inside, ratings[rows], 0.0).astype(np.float64)[:, :, None]
        turned = x.transpose(0, 2, 1)
        short = width < rank and reg > 0
        left = x @ turned if short else turned @ x
        diagonal = np.arange(left.shape[1])
        left[:, diagonal, diagonal] += reg * counts[some][:, None]
        values = turned @ np.linalg.solve(left, r) if short else np.linalg.solve(left, turned @ r)
        found[some] = values[:, :, 0]
        place = end
    return found


def _solve_job(files: FactorFiles, rank: int, reg: float, folder: str = "") -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, counts, others, at, ratings = (
                    np.frombuffer(batch.column(c)[i].as_buffer(), kind)
                    for c, kind in enumerate((np.int32, np.int64, np.int32, np.int32, np.float32))
                )
                found = solve(counts, at, ratings, files.rows(others, rank), reg)
                yield _write_factors(files.scheme, folder, ids, found)

    return run


def _blocks(rows: DataFrame, key: str, other: str, tasks: int, per_block: int) -> DataFrame:
    dealt = rows.select(key, other, "rating").repartitionByRange(tasks, key)
    ordered = dealt.sortWithinPartitions(key, other, "rating")
    return ordered.mapInArrow(_block_job(per_block), BLOCKS).persist(StorageLevel.MEMORY_AND_DISK)


def _store(df: DataFrame, path: str) -> str:
    """Write the names of the files that the tasks leave under ``path``; the commit decides which task counts."""
    df.write.mode("append").parquet(path)
    return path


@dataclass(frozen=True)
class Start:
    """What all fits of one rank begin with: the blocks of both sides, and where the first factors of the users are."""

    rank: int
    by_item: DataFrame
    by_user: DataFrame
    path: str
    files: FactorFiles

    def close(self) -> None:
        for blocks in (self.by_item, self.by_user):
            blocks.unpersist()
        remove(self.by_item.sparkSession, self.path)


def prepare(rows: DataFrame, first_users: DataFrame, rank: int) -> Start | None:
    """Blocks of the ratings, and the files of the first factors of each user.

    ``rows`` has the 32-bit ``user_id`` and ``item_id`` and the ``rating`` and should be stored, as it is
    read several times. None if Python cannot use the shared folder.
    """
    spark = rows.sparkSession
    number = rows.count()
    per_block = max(1, BLOCK_VALUES // rank)
    spread = min(spark.sparkContext.defaultParallelism, math.ceil(number * rank / TASK_VALUES))
    tasks = max(1, spread, math.ceil(number / per_block))
    packed = first_users.select("id", "features").repartitionByRange(tasks, "id").sortWithinPartitions("id")
    path = fresh_path(spark, "user-factors")
    place, files = factor_folder(path), None
    if place is not None:
        files = factor_files(spark, _store(packed.mapInArrow(_pack_job(*place), FILES), path))
    if files is None:
        remove(spark, path)
        return None
    by_item = _blocks(rows, "item_id", "user_id", tasks, per_block)
    return Start(rank, by_item, _blocks(rows, "user_id", "item_id", tasks, per_block), path, files)


def factorise(start: Start, reg: float, iterations: int) -> tuple[str, str]:
    """Where the factors of users and of items are stored, as Parquet with ``id`` and ``features``.

    There must be an iteration. What ``start`` holds stays for other fits.
    """
    spark, rank = start.by_item.sparkSession, start.rank

    def half(blocks: DataFrame, others: FactorFiles, label: str) -> tuple[str, FactorFiles]:
        path = fresh_path(spark, label)
        job = _solve_job(others, rank, reg, factor_folder(path)[1])
        return path, factor_files(spark, _store(blocks.mapInArrow(job, FILES), path))

    users = items = None
    files = start.files
    try:
        for _ in range(iterations):
            now, files = half(start.by_item, files, "item-factors")
            if items:
                remove(spark, items)
            items = now
            now, files = half(start.by_user, files, "user-factors")
            if users:
                remove(spark, users)
            users = now
        stored = []
        for label, path in (("user-rows", users), ("item-rows", items)):
            to = fresh_path(spark, label)
            spark.read.schema(FILES).parquet(path).mapInArrow(_unpack_job(files.scheme), ROWS).write.parquet(to)
            stored.append(to)
        return stored[0], stored[1]
    finally:
        for path in filter(None, (users, items)):
            remove(spark, path)
