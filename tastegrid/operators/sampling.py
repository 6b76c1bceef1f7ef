"""Resampling with replacement: draws meet the rows in the buckets these are numbered in."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.config import ROWS_PER_TASK, ViewConfig
from tastegrid.functions.hashing import draw
from tastegrid.operators.ordinals import ROWS_WORTH_A_TASK, bucket_bits, fine_counts, rows_at

# Draws of one class that are made at a time.
PIECE = 1 << 16
# Tasks for each core that make draws, if there are as many pieces.
PIECES_TASKS = 8


def sample_size(rows: int, percent: float) -> int:
    """Rows in a percentage, halves rounded to even."""
    return round(rows * percent / 100)


def resample_percent(
    df: DataFrame,
    percent: float,
    seed: int,
    keys: Sequence[str],
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Draw a percentage of the rows with replacement, with ``draw_id`` 0, 1, 2, ...

    Each draw picks one place in a seeded shuffle of the rows. The rows are read twice, once for
    their keys alone, and shuffled once. Every pick reduces 64 hash bits.
    """
    counts = fine_counts(df, "place", seed, keys)
    rows = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    draws = df.sparkSession.range(sample_size(rows, percent)).select(
        F.col("id").alias("draw_id"),
        _pick(F.lit(rows), seed, [F.col("id")]).alias("ordinal"),
        F.lit(rows).cast("bigint").alias("n"),
    )
    tasks = df.sparkSession.sparkContext.defaultParallelism
    bits = bucket_bits(rows, rows_per_task, tasks)
    picked = rows_at(df, draws, counts, bits, "place", seed, keys)
    return picked.select("draw_id", *[F.col("_row")[c].alias(c) for c in df.columns])


def _pick(rows: Column, seed: int, keys: list) -> Column:
    """A draw of 64 bits reduced to ``[0, rows)``; the bias is below rows / 2^64."""
    low, high = draw("pick", seed, keys), draw("pick-high", seed, keys)
    rows = F.greatest(rows.cast("bigint"), F.lit(1).cast("bigint"))
    # Below 2^31 rows the product of two remainders fits in 64 bits.
    short = F.pmod(F.pmod(high, rows) * F.pmod(F.lit(1 << 32), rows) + low, rows)
    wide = high.cast("decimal(38,0)") * F.lit(1 << 32).cast("decimal(38,0)") + low
    return F.when(rows < 1 << 31, short).otherwise(F.pmod(wide, rows).cast("bigint"))


def class_sizes(df: DataFrame, by: str) -> DataFrame:
    """Rows per class that occurs."""
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def smallest_class(df: DataFrame, by: str) -> DataFrame:
    """One row: the size of the smallest class that occurs."""
    return class_sizes(df, by).agg(F.min("n").alias("min_count"))


def resample_to_smallest(
    df: DataFrame,
    by: str,
    seed: int,
    keys: Sequence[str],
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Draw from every class, with replacement, as many rows as the smallest has.

    ``draw_id`` counts the draws of one class. A class may hold most of the table: its rows lie in
    many buckets, and its draws are made in pieces. Rows without a class take no part.
    """
    known = df.where(F.col(by).isNotNull())
    counts = fine_counts(known, "place", seed, keys, [by])
    classes = counts.groupBy(by).agg(F.sum("n").alias("n"))
    shape = classes.agg(F.min("n").alias("least"), F.max("n").alias("largest"), F.count(F.lit(1)).alias("classes")).first()
    least, largest = shape["least"] or 0, shape["largest"] or 0
    tasks = df.sparkSession.sparkContext.defaultParallelism
    pieces = classes.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.lit(max(least - 1, 0) // PIECE))))
    start = F.col("_piece").cast("bigint") * PIECE
    ids = F.sequence(start, F.least(start + PIECE, F.lit(max(least, 1)).cast("bigint")) - 1)
    # The pieces are few and short, the draws made of them are not: a fixed number keeps them apart.
    spread = max(1, min(shape["classes"] * math.ceil(least / PIECE), PIECES_TASKS * tasks))
    draws = pieces.repartition(spread, by, "_piece").select(by, "n", F.explode(ids).alias("draw_id"))
    pick = _pick(F.col("n"), seed, [F.col(by), F.col("draw_id")])
    draws = draws.withColumn("ordinal", pick)
    bits = bucket_bits(largest, min(rows_per_task, ROWS_WORTH_A_TASK))
    picked = rows_at(known, draws, counts, bits, "place", seed, keys, [by])
    rest = [F.col("_row")[c].alias(c) for c in df.columns if c != by]
    return picked.select(by, "draw_id", *rest)


def plot_points(df: DataFrame, keys: Sequence[str], cfg: ViewConfig = ViewConfig()) -> DataFrame:
    """Points to show: a resample of all, balanced over categories, flagged if in view.

    Expects ``category_id``, ``x`` and ``y``. A plot percentage of 0 keeps all rows.
    """
    shown = df
    if cfg.plot_percent:
        shown = resample_percent(df, cfg.plot_percent, cfg.seed, keys)
    if cfg.balance:
        drawn = [*keys, "draw_id"] if cfg.plot_percent else list(keys)
        first = shown.withColumnRenamed("draw_id", "first_draw") if cfg.plot_percent else shown
        names = ["first_draw" if c == "draw_id" else c for c in drawn]
        shown = resample_to_smallest(first, "category_id", cfg.seed, names)
    limit = F.lit(cfg.limit)
    inside = F.col("x").between(-limit, limit) & F.col("y").between(-limit, limit)
    return shown.withColumn("in_view", inside)
