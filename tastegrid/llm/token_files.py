"""Token ids of a corpus in a binary format, written in ascending doc_id order and read back.

A file set is a folder of Parquet files whose rows are segments: the ids of consecutive
documents, range coded in independent blocks with checksums (``coder.py``). ``part`` and ``before``
give a segment its place: the range of documents it lies in, and the ids before it there.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.llm.coder import BLOCK_IDS, Pieces, read_segments, write_segments
from tastegrid.llm.shelf import Shelf
from tastegrid.llm.tokens import WordEncoder, slices

# The functions below travel to the workers inside the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

END_ID = 0
SEGMENT_IDS = 1024 * 4096
# Blocks that are coded side by side, of several segments where these are small; one segment may have more.
TOGETHER = 2048
SEGMENTS = "part INT, before BIGINT, n_ids BIGINT, data BINARY"
PARTS = (
    "doc_id BIGINT, part INT, first BIGINT, n_tokens BIGINT, piece_start BIGINT, size BIGINT, crc BIGINT"
)


@dataclass
class _Segment:
    """A segment as it fills up."""

    rows: list[tuple]
    ids: list[np.ndarray]
    size: int = 0

    def add(self, doc_id: int | None, whole: int, before: int, ids: np.ndarray) -> None:
        self.rows.append((doc_id or 0, doc_id is not None, whole, before, len(ids)))
        self.ids.append(ids)
        self.size += len(ids)

    def content(self) -> tuple[Pieces, np.ndarray]:
        columns = (np.array(c, dtype=np.int64) for c in zip(*self.rows))
        return Pieces(*columns), np.concatenate(self.ids)


def _together(sized: Iterator[tuple[int, Any]]) -> Iterator[list]:
    """Things with so many ids each, in order, in lists of at most ``TOGETHER`` blocks or of one thing."""
    found, blocks = [], 0
    for ids, thing in sized:
        more = -(-ids // BLOCK_IDS)
        if found and blocks + more > TOGETHER:
            yield found
            found, blocks = [], 0
        found.append(thing)
        blocks += more
    if found:
        yield found


def _write_job(tokenizer: str, segment_ids: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = WordEncoder(tokenizer), TaskContext.get().partitionId()

        def filled() -> Iterator[tuple[int, _Segment]]:
            segment = _Segment([], [])
            for batch in batches:
                docs, texts = batch.column("doc_id").to_pylist(), batch.column("text")
                for low, high in slices(texts):
                    ids, ends = encoder.encode(texts.slice(low, high - low))
                    for i in range(high - low):
                        whole = np.append(ids[ends[i] : ends[i + 1]], np.int32(END_ID))
                        at = 0
                        while at < len(whole):
                            piece = whole[at : at + segment_ids - segment.size]
                            segment.add(docs[low + i], len(whole), at, piece)
                            at += len(piece)
                            if segment.size == segment_ids:
                                yield segment.size, segment
                                segment = _Segment([], [])
            if segment.size:
                yield segment.size, segment

        schema = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])
        before = 0
        for segments in _together(filled()):
            for segment, data in zip(segments, write_segments([s.content() for s in segments])):
                row = {"part": part, "before": before, "n_ids": segment.size, "data": data}
                before += segment.size
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return run


def write(docs: DataFrame, path: str, tokenizer: str, segment_ids: int = SEGMENT_IDS) -> None:
    """Write the ids of ``docs(doc_id, text)``, each document with an end id, to ``path``.

    Documents are in ascending doc_id order, those without doc_id first; a null text is empty. Rows that
    share a doc_id, or have none, go by a hash of their text, so they fall into several ranges
    and come in one order however they were dealt before.
    """
    text = F.coalesce("text", F.lit(""))
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    source = source.withColumn("hash", F.xxhash64("text"))
    order = [F.asc_nulls_first("doc_id"), F.asc("hash")]
    ordered = source.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select("doc_id", "text").mapInArrow(_write_job(tokenizer, segment_ids), SEGMENTS).write.parquet(path)


def _read_job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in PARTS.split(", ")]
    rows = ((row["n_ids"], row) for batch in batches for row in batch.to_pylist())
    for several in _together(rows):
        for row, (pieces, ids) in zip(several, read_segments([row["data"] for row in several])):
            ends = np.concatenate([[0], np.cumsum(pieces.size)])
            raw = memoryview(ids.astype("<u4").tobytes())
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:])]
            number = len(pieces.size)
            columns = [
                pa.array(pieces.doc_id, mask=pieces.known == 0),
                pa.array(np.full(number, row["part"], dtype=np.int32)),
                pa.array(row["before"] + ends[:-1] - pieces.before),
                pa.array(pieces.whole),
                pa.array(pieces.before),
                pa.array(pieces.size),
                pa.array(sums, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def crc32_of_both(one: int, two: int, size: int) -> int:
    """The checksum of two byte strings put together, from theirs and the second's length.

    Appending a zero byte is a linear map on the 32 bits of a checksum; its powers by repeated
    squaring carry the first checksum past the second string.
    """
    step = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit

    def times(matrix: list[int], value: int) -> int:
        total = 0
        for i, column in enumerate(matrix):
            if value >> i & 1:
                total ^= column
        return total

    bits = size * 8
    while bits:
        if bits & 1:
            one = times(step, one)
        step = [times(step, column) for column in step]
        bits >>= 1
    return one ^ two


def _join_job(table: pa.Table) -> pa.Table:
    """The pieces of one document, which lies in several segments, in one row."""
    rows = sorted(table.to_pylist(), key=lambda r: r["piece_start"])
    crc = rows[0]["crc"]
    for row in rows[1:]:
        crc = crc32_of_both(crc, row["crc"], 4 * row["size"])
    first = {k: rows[0][k] for k in ("doc_id", "part", "first", "n_tokens")} | {"crc": crc}
    return pa.Table.from_pylist([first], schema=pa.schema([table.schema.field(k) for k in first]))


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document in a file set, from its ids.

    ``start`` is the number of ids before the document in the whole set. A block whose ids do
    not have their checksum is an error.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    # Stored, without the ids: whole and split documents both read them, and nothing is decoded twice.
    pieces = Shelf(spark).put("pieces", segments.mapInArrow(_read_job, PARTS))
    whole = F.col("size") == F.col("n_tokens")
    one = pieces.where(whole).select("doc_id", "part", "first", "n_tokens", "crc")
    split = _split_documents(segments, pieces.where(~whole))
    both = one if split is None else one.unionByName(split)
    sizes = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    count = {r["part"]: r["n"] for r in sizes}
    starts = list(accumulate((count.get(p, 0) for p in range(max(count, default=-1) + 1)), initial=0))
    start = F.element_at(F.array(*[F.lit(s).cast("bigint") for s in starts]), F.col("part") + 1)
    return both.select(
        "doc_id", (start + F.col("first")).alias("start"), "n_tokens", F.col("crc").alias("ids_crc32")
    )


def _split_documents(segments: DataFrame, pieces: DataFrame) -> DataFrame | None:
    """Documents that lie in several segments; only parts with several segments can have any."""
    several = segments.where("before > 0").select("part").limit(1)
    if several.isEmpty():
        return None
    schema = "doc_id BIGINT, part INT, first BIGINT, n_tokens BIGINT, crc BIGINT"
    return pieces.groupBy("part", "first").applyInArrow(_join_job, schema)


def round_trip(docs: DataFrame, path: str, tokenizer: str, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Write ``docs`` and read the files back: one row per input row, as ``read`` gives it.

    Rows that repeat a doc_id follow each other. No rows give no rows. Only ``doc_id`` and
    ``text`` are read.
    """
    write(docs, path, tokenizer, segment_ids)
    return read(docs.sparkSession, path)
