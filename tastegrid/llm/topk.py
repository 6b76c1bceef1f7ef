"""Exact top-k by inner product, in three phases with a uniform threshold.

The components of a vector are dealt to a few nodes; the score of a pair is the sum of its
partial scores there.

1. Each node gives the k best partial scores of every query. The exact k-th best score of what
   is seen so far is a cutoff that is safe: at least k candidates reach it.
2. The cutoff goes out to all nodes. A candidate that reaches it has, with m nodes, a partial
   score of at least cutoff / m on one of them; each node gives all such candidates.
3. The scores of these candidates are resolved exactly.

Queries lie in blocks, candidates stream past them. A task holds its queries and their k best.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.llm.shelf import Shelf

# The functions below travel to the workers inside the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODES = 2
QUERIES_PER_BLOCK = 16_384
# Upper bound for one matrix of scores, in numbers.
SCORES_PER_STEP = 2_000_000
QUERY, CANDIDATE = 0, 1


def usable(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    bad = F.exists(
        vector,
        lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")),
    )
    return vector.isNotNull() & ~bad


def _vectors(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The vectors of a batch as a matrix of doubles; shorter ones end in zeros."""
    lists = batch.column("vector")
    ends = np.asarray(lists.offsets)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    matrix = np.zeros((len(sizes), width), dtype=np.int64)
    matrix[np.arange(width) < sizes[:, None]] = flat
    return matrix


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows; doubles do them exactly while they are small."""
    width = max(left.shape[1], 1)
    top = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * width
    if top < 2**53:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left @ right.T


class _Best:
    """The k best candidates of each query of a block: larger score, then smaller id and row."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.rows = [np.empty(0, dtype=np.int64) for _ in range(4)]  # query, score, id, row
        self.pending: list[tuple[np.ndarray, ...]] = []
        self.waiting, self.queries = 0, queries

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        self.pending.append((query, score, ids, row))
        self.waiting += len(query)
        if self.waiting > max(SCORES_PER_STEP, self.queries * self.k):
            self.settle()

    def settle(self) -> list[np.ndarray]:
        if self.pending:
            columns = [np.concatenate(c) for c in zip(self.rows, *self.pending)]
            order = np.lexsort((columns[3], columns[2], -columns[1], columns[0]))
            query = columns[0][order]
            first = np.searchsorted(query, query, side="left")
            order = order[np.arange(len(query)) - first < self.k]
            self.rows = [c[order] for c in columns]
            self.pending, self.waiting = [], 0
        return self.rows


LISTS = "q BIGINT, score BIGINT, vec_id BIGINT, row BIGINT"


def _out(columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in columns], names=names)


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batches of a sorted partition, cut where queries end and candidates begin."""
    for batch in batches:
        split = int(np.searchsorted(batch.column("side").to_numpy(), CANDIDATE))
        if split:
            yield QUERY, batch.slice(0, split)
        if split < batch.num_rows:
            yield CANDIDATE, batch.slice(split)


def _phase(width: int, k: int, visit: Callable) -> Callable:
    """A job over sorted tiles; ``visit`` sees each batch of candidates with all queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        matrix = rows = cut = best = None
        for side, batch in _sides(batches):
            if side == QUERY:
                parts.append(batch)
                continue
            if matrix is None:
                if not parts:
                    return
                matrix = np.concatenate([_vectors(p, width) for p in parts])
                rows = np.concatenate([p.column("row").to_numpy() for p in parts])
                cut = np.concatenate([p.column("cut").to_numpy(zero_copy_only=False) for p in parts])
                best = _Best(len(rows), k)
            yield from visit(matrix, rows, cut, best, batch, width)
        if best is not None:
            query, *rest = best.settle()
            yield from _out([rows[query], *rest], ["q", "score", "vec_id", "row"])

    return run


def _local_lists(matrix, rows, cut, best, batch, width):
    """Phase 1: the best partial scores of each query among these candidates."""
    vectors = _vectors(batch, width)
    ids, names = batch.column("vec_id").to_numpy(), batch.column("row").to_numpy()
    step = max(1, SCORES_PER_STEP // max(len(ids), 1))
    for at in range(0, len(matrix), step):
        partial = _products(matrix[at : at + step], vectors)
        own = rows[at : at + step, None] == names[None, :]
        partial[own] = np.iinfo(np.int64).min
        n = min(best.k + 1, len(ids))
        top = np.argpartition(-partial, n - 1, axis=1)[:, :n]
        query = np.repeat(np.arange(at, at + len(partial)), n)
        top = top.ravel()
        score = partial[query - at, top]
        real = score > np.iinfo(np.int64).min
        best.add(query[real], score[real], ids[top[real]], names[top[real]])
    return iter(())


def _over_cutoff(nodes: int) -> Callable:
    def visit(matrix, rows, cut, best, batch, width):
        """Phase 2: per candidate the queries for which its partial score is high enough."""
        vectors, names = _vectors(batch, width), batch.column("row").to_numpy()
        step = max(1, SCORES_PER_STEP // max(len(names), 1))
        for at in range(0, len(matrix), step):
            partial = _products(matrix[at : at + step], vectors)
            high = partial >= (cut[at : at + step] / nodes)[:, None]
            high &= rows[at : at + step, None] != names[None, :]
            candidate, query = np.nonzero(high.T)
            counts = np.bincount(candidate, minlength=len(names))
            some = np.flatnonzero(counts)
            ends = np.concatenate([[0], np.cumsum(counts[some])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(rows[at + query]))
            if len(some):
                block = batch.column("qb").take(pa.array(np.zeros(len(some), dtype=np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [block, pa.array(names[some]), lists], names=["qb", "row", "queries"]
                )

    return visit


def _resolve(matrix, rows, cut, best, batch, width):
    """Phase 3: exact scores of the candidates given, for the queries they were given for."""
    vectors, lists = _vectors(batch, width), batch.column("queries")
    sizes = np.diff(np.asarray(lists.offsets))
    order = np.argsort(rows, kind="stable")
    query = order[np.searchsorted(rows, lists.flatten().to_numpy(), sorter=order)]
    candidate = np.repeat(np.arange(len(sizes)), sizes)
    ids, names = batch.column("vec_id").to_numpy(), batch.column("row").to_numpy()
    step = max(1, SCORES_PER_STEP // max(width, 1))
    for at in range(0, len(query), step):
        q, c = query[at : at + step], candidate[at : at + step]
        score = np.einsum("ij,ij->i", matrix[q], vectors[c])
        best.add(q, score, ids[c], names[c])
    return iter(())


class _Search:
    def __init__(self, vectors: DataFrame, is_query: Column, k: int) -> None:
        self.shelf, self.k = Shelf(vectors.sparkSession), k
        chosen = vectors.where(usable(F.col("vector")) & F.col("vec_id").isNotNull()).select(
            F.col("vec_id").cast("bigint").alias("vec_id"),
            F.transform("vector", lambda x: x.cast("bigint")).alias("vector"),
            F.coalesce(is_query, F.lit(False)).alias("asks"),
        )
        stored = self.shelf.put("vectors", chosen.withColumn("row", F.monotonically_increasing_id()))
        facts = stored.agg(F.count_if("asks"), F.max(F.size("vector"))).first()
        self.width = facts[1] or 0
        tasks = vectors.sparkSession.sparkContext.defaultParallelism
        self.blocks = max(1, math.ceil(facts[0] / QUERIES_PER_BLOCK))
        self.parts = max(1, math.ceil(tasks / self.blocks))
        self.candidates = stored.drop("asks")
        block = F.pmod(F.xxhash64("row"), F.lit(self.blocks)).cast("int")
        self.queries = stored.where("asks").drop("asks").withColumn("qb", block)

    def tiles(self, queries: DataFrame, candidates: DataFrame) -> DataFrame:
        """One partition per query block and part of the candidates, queries first.

        ``queries`` have ``cut``; ``candidates`` have ``qb`` and ``queries``.
        """
        part = F.pmod(F.xxhash64("row"), F.lit(self.parts)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1))).alias("part")
        none = F.lit(None).cast("array<bigint>").alias("queries")
        left = queries.select("qb", every, F.lit(QUERY).alias("side"), "row", "vec_id", "vector", "cut", none)
        right = candidates.select(
            "qb", part.alias("part"), F.lit(CANDIDATE).alias("side"), "row", "vec_id", "vector",
            F.lit(None).cast("bigint").alias("cut"), "queries",
        )
        both = left.unionByName(right)
        return both.repartitionById(
            self.blocks * self.parts, F.col("qb") * self.parts + F.col("part")
        ).sortWithinPartitions("side")

    def everywhere(self, candidates: DataFrame) -> DataFrame:
        """Candidates once for each query block."""
        every = F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))).alias("qb")
        return candidates.select("*", every).withColumn("queries", F.lit(None).cast("array<bigint>"))

    def node(self, df: DataFrame, g: int) -> DataFrame:
        """The components of one node."""
        low, high = self.width * g // NODES, self.width * (g + 1) // NODES
        return df.withColumn("vector", F.slice("vector", low + 1, high - low))

    def node_width(self, g: int) -> int:
        return self.width * (g + 1) // NODES - self.width * g // NODES

    def best(self, lists: DataFrame) -> DataFrame:
        """The k best of each query, numbered from 1."""
        order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "row")
        return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.k)

    def resolved(self, asked: DataFrame, label: str) -> DataFrame:
        """Exact best scores among candidates ``row`` asked for by ``queries`` of block ``qb``."""
        given = asked.join(self.candidates, "row")
        job = _phase(self.width, self.k, _resolve)
        tiles = self.tiles(self.queries.withColumn("cut", F.lit(0).cast("bigint")), given)
        return self.shelf.put(label, self.best(tiles.mapInArrow(job, LISTS)))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best candidates of each query row.

    ``vectors`` has ``vec_id`` and ``vector``, an array of whole numbers of any numeric type.
    Candidates of a query are all rows but its own; equal scores go by smaller vec_id. Rows
    that repeat a vec_id are rows of their own. Vectors that are null or hold null or
    non-finite components, and rows without vec_id, take no part; shorter vectors count as
    padded with zeros. A query with fewer candidates has them all. No rows give no rows.
    Scores must fit in 64 bits. Other columns of ``vectors`` are not read.
    """
    search = _Search(vectors, is_query, k)
    none = search.queries.withColumn("cut", F.lit(0).cast("bigint"))
    seen = None
    for g in range(NODES):
        tiles = search.tiles(search.node(none, g), search.everywhere(search.node(search.candidates, g)))
        lists = search.best(tiles.mapInArrow(_phase(search.node_width(g), k, _local_lists), LISTS))
        seen = lists.select("q", "row") if seen is None else seen.unionByName(lists.select("q", "row"))
    block = F.pmod(F.xxhash64("q"), F.lit(search.blocks)).cast("int").alias("qb")
    asked = seen.distinct().groupBy(block, "row").agg(F.collect_list("q").alias("queries"))
    first = search.resolved(asked, "first")
    cuts = first.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("cut"))
    # Fewer than k seen: every candidate is needed.
    lowest = F.lit(-(2**62)).cast("bigint")
    cuts = cuts.select(F.col("q").alias("row"), F.when(F.col("n") < k, lowest).otherwise(F.col("cut")).alias("cut"))
    limited = search.queries.join(cuts, "row", "left").withColumn("cut", F.coalesce("cut", lowest))
    limited = search.shelf.put("limited", limited)
    needed = None
    for g in range(NODES):
        tiles = search.tiles(search.node(limited, g), search.everywhere(search.node(search.candidates, g)))
        over = tiles.mapInArrow(
            _phase(search.node_width(g), k, _over_cutoff(NODES)), "qb INT, row BIGINT, queries ARRAY<BIGINT>"
        )
        needed = over if needed is None else needed.unionByName(over)
    asked = needed.groupBy("qb", "row").agg(
        F.array_distinct(F.flatten(F.collect_list("queries"))).alias("queries")
    )
    final = search.resolved(asked, "final")
    ids = search.queries.select(F.col("row").alias("q"), F.col("vec_id").alias("query_id"))
    return final.join(ids, "q").select("query_id", "rank", "vec_id", "score")
