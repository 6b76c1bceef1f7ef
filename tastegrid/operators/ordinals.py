"""Row numbers over whole tables and whole groups, without a task that sees it all.

A number has two parts: how many rows lie in earlier buckets, and the place inside
the row's own bucket. Buckets are ranges of the sort order, so the sum is the exact
number, and each bucket is small enough for one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.config import ROWS_PER_TASK
from tastegrid.functions.hashing import DRAW_BITS, digest, leading_bits
from tastegrid.operators.skew import small
from tastegrid.sources.workspace import cut

ROWS_WORTH_A_TASK = 50_000
FINE_BITS = 16
BUCKET = "_bucket"
DIGEST = "_digest"


def bucket_bits(rows: int, rows_per_task: int = ROWS_PER_TASK, tasks: int = 1) -> int:
    """Leading hash bits that cut ``rows`` rows into pieces of about one task each.

    Fewer rows are still spread over the available tasks, as far as that pays.
    """
    pieces = max(rows / rows_per_task, min(tasks, rows // ROWS_WORTH_A_TASK), 1)
    return min(DRAW_BITS, math.ceil(math.log2(pieces)))


def hash_bucket(hex_digest: Column, bits: Column | int) -> Column:
    """The first ``bits`` bits of a digest: buckets in digest order."""
    shift = F.lit(DRAW_BITS) - (F.lit(bits) if isinstance(bits, int) else bits)
    return F.floor(leading_bits(hex_digest) / F.pow(F.lit(2.0), shift)).cast("bigint")


def rows_before(counts: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Running total of ``n`` over the earlier rows of each group, as ``before``."""
    earlier = (
        Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def hash_ordinal(
    df: DataFrame,
    purpose: str,
    seed: int,
    keys: Sequence[str],
    rows: int,
    by: Sequence[str] = (),
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``ordinal``: 0-based place in a seeded shuffle, in the table or per group.

    ``rows`` is the size of the table; it sets the number of buckets. The bucket
    table has about ``rows / rows_per_task`` rows for each group.
    """
    tasks = 1 if by else df.sparkSession.sparkContext.defaultParallelism
    bits = bucket_bits(rows, rows_per_task, tasks)
    marked = df.withColumn(DIGEST, digest(purpose, seed, keys)).withColumn(
        BUCKET, hash_bucket(F.col(DIGEST), bits)
    )
    place = Window.partitionBy(*by, BUCKET).orderBy(DIGEST, *keys)
    numbered = marked.withColumn("_place", F.row_number().over(place) - 1)
    if bits == 0:
        return numbered.withColumn("ordinal", F.col("_place").cast("bigint")).drop(
            "_place", BUCKET, DIGEST
        )
    counts = marked.groupBy(*by, BUCKET).agg(F.count(F.lit(1)).alias("n"))
    before = rows_before(counts, by or [F.lit(0)], [BUCKET]).drop("n")
    return (
        numbered.join(before, [*by, BUCKET])
        .withColumn("ordinal", F.col("before") + F.col("_place"))
        .drop("_place", "before", BUCKET, DIGEST)
    )


def fine_counts(
    df: DataFrame, purpose: str, seed: int, keys: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Rows ``n`` of each fine bucket of a seeded shuffle, in the table or per group; stored.

    Only the key columns are read. There are at most 2^16 rows for each group.
    """
    bucket = hash_bucket(digest(purpose, seed, keys), FINE_BITS)
    marked = df.select(*by, bucket.alias(BUCKET))
    return cut(marked.groupBy(*by, BUCKET).agg(F.count(F.lit(1)).alias("n")))


def rows_at(
    df: DataFrame,
    draws: DataFrame,
    counts: DataFrame,
    bits: int,
    purpose: str,
    seed: int,
    keys: Sequence[str],
    by: Sequence[str] = (),
) -> DataFrame:
    """``draws`` with the row of ``df`` at their place in a seeded shuffle, as ``_row``.

    A draw has a ``draw_id``, the ``by`` columns, an ``ordinal`` and ``n``, the rows to draw from.
    ``counts`` are the ``fine_counts`` of the same shuffle. The bucket of a draw is looked up in
    the small table of buckets. Then rows and draws go to their buckets in one shuffle; there the
    rows are numbered, and each draw meets the row with its number.
    """
    bits = min(bits, FINE_BITS)
    bucket = F.shiftright(BUCKET, FINE_BITS - bits).alias(BUCKET)
    coarse = counts.select(*by, bucket, "n").groupBy(*by, BUCKET).agg(F.sum("n").alias("_rows"))
    whole = Window.partitionBy(*(by or [F.lit(0)]))
    starts = rows_before(coarse.withColumnRenamed("_rows", "n"), by or [F.lit(0)], [BUCKET])
    starts = starts.withColumn("_width", _cell_width(F.sum("n").over(whole), bits))
    # A bucket lies in all cells of ordinals that it touches, about two.
    first, last = (F.floor(c / F.col("_width")) for c in (F.col("before"), F.col("before") + F.col("n") - 1))
    cells = starts.select(
        *by, BUCKET, "before", (F.col("before") + F.col("n")).alias("_end"), F.explode(F.sequence(first, last)).alias("_cell")
    )
    cell = F.floor(F.col("ordinal") / _cell_width(F.col("n"), bits)).alias("_cell")
    dealt = draws.select(*by, "draw_id", "ordinal", cell).join(small(cells), [*by, "_cell"])
    dealt = dealt.where((F.col("ordinal") >= F.col("before")) & (F.col("ordinal") < F.col("_end"))).select(
        *by, BUCKET, "draw_id", (F.col("ordinal") - F.col("before")).alias("_place")
    )
    mark = digest(purpose, seed, keys)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    rows = df.select(*by, hash_bucket(mark, bits).alias(BUCKET), mark.alias(DIGEST), row)
    both = rows.unionByName(dealt, allowMissingColumns=True)
    # Rows come before draws, so the draws take no numbers away.
    order = [F.col("draw_id").isNotNull(), F.col(DIGEST), *[F.col("_row")[k] for k in keys]]
    number = F.row_number().over(Window.partitionBy(*by, BUCKET).orderBy(*order)) - 1
    met = both.withColumn("_place", F.coalesce(F.col("_place"), number.cast("bigint")))
    same = Window.partitionBy(*by, BUCKET, "_place").orderBy(F.col("draw_id").asc_nulls_first())
    found = F.first("_row").over(same.rowsBetween(Window.unboundedPreceding, 0))
    return met.withColumn("_row", found).where("draw_id IS NOT NULL").select(*by, "draw_id", "_row")


def _cell_width(rows: Column, bits: int) -> Column:
    """Ordinals in a cell, if ``rows`` of them are cut into as many cells as there are buckets."""
    return F.greatest(F.ceil(rows / (1 << bits)), F.lit(1).cast("bigint"))


def key_offsets(
    counts: DataFrame, by: str, key: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Add ``before``: rows of all smaller keys in the same ``by`` group.

    ``counts`` holds one row per key with its number of rows ``n``. It is read several
    times and should be stored. Keys are cut into ranges of their own order, whatever
    their type; the ranges shape the work only, the totals are exact for any of them.
    """
    pieces = math.ceil(counts.count() / rows_per_task)
    if pieces <= 1:
        return rows_before(counts, [by], [key])
    ranged = cut(
        counts.repartitionByRange(pieces, key).withColumn(BUCKET, F.spark_partition_id())
    )
    sums = ranged.groupBy(by, BUCKET).agg(F.sum("n").alias("n"))
    starts = rows_before(sums, [by], [BUCKET]).select(by, BUCKET, F.col("before").alias("_start"))
    return (
        rows_before(ranged, [by, BUCKET], [key])
        .join(starts, [by, BUCKET])
        .withColumn("before", F.col("_start") + F.col("before"))
        .drop("_start", BUCKET)
    )
