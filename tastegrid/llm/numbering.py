"""Global row numbers after one range shuffle."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.shelf import Shelf

_ROW_BITS = 33  # of monotonically_increasing_id, below the partition


def numbered(df: DataFrame, order: list[str], shelf: Shelf, label: str, index: str) -> DataFrame:
    """``df`` stored in the order of ``order``, with the 0-based place of each row as ``index``.

    The rows are cut into ranges of ``order``; only the number of rows of each range comes to
    the driver. ``order`` should tell rows apart, so that equal keys do not share a range.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = shelf.put(label, ranged.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", _ROW_BITS)
    rows = stored.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    counts = dict((r["part"], r["n"]) for r in rows)
    parts = sorted(counts)
    starts = list(accumulate((counts[p] for p in parts), initial=0))
    before = dict(zip(parts, starts))
    top = max(parts, default=-1)
    first = F.array(*[F.lit(before.get(p, 0)).cast("bigint") for p in range(top + 1)]) if parts else F.array(F.lit(0).cast("bigint"))
    in_part = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    place = F.element_at(first, (part + 1).cast("int")) + in_part
    return stored.withColumn(index, place).drop("_place")
