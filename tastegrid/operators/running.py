"""Running totals over the ordered rows of a user, with heavy users in several tasks.

A heavy user's rows are cut into ranges of their order. The total before a row is the total of the
earlier ranges, a small table with one row a range, and the total inside its own range. Users
that are not heavy take one window each.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.operators.skew import HeavyKeys, small
from tastegrid.sources.workspace import cut

RANGE = "_range"
RANGES_PER_PIECE = 2


def _before(order: Window) -> Window:
    return order.rowsBetween(Window.unboundedPreceding, -1)


def _in_one_window(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], totals: Mapping[str, Column], run: Column | None
) -> DataFrame:
    ordered = Window.partitionBy(*by).orderBy(*order)
    found = df.withColumns(
        {name: F.coalesce(F.sum(value).over(_before(ordered)), F.lit(0)).cast("bigint") for name, value in totals.items()}
    )
    if run is None:
        return found
    # The first row of a run of equal values opens it for all of the run.
    is_first = F.lag(F.lit(1)).over(ordered).isNull()
    first = next(iter(totals))
    opens = F.when(is_first | ~F.lag(run).over(ordered).eqNullSafe(run), F.col(first))
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return found.withColumn("_opens", opens).withColumn("run_start", F.max("_opens").over(upto)).drop("_opens")


def _in_ranges(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    totals: Mapping[str, Column],
    run: Column | None,
    pieces: int,
) -> DataFrame:
    """The same for rows of heavy users; a range holds a piece of one or of several users."""
    keys = [*by, RANGE]
    ranged = df.repartitionByRange(pieces, *by, *order).withColumn(RANGE, F.spark_partition_id())
    # Ranges come from a sample, so they are stored before two steps rely on them.
    ranged = cut(ranged)
    inside = _in_one_window(ranged, keys, order, {f"_in_{name}": value for name, value in totals.items()}, run)
    sums = [F.sum(value).alias(f"_sum_{name}") for name, value in totals.items()]
    first = next(iter(totals))
    earlier = Window.partitionBy(*by).orderBy(RANGE)
    if run is not None:
        # The value a range begins and ends with, and where the run at its end begins in it.
        inside = inside.withColumn("_value", run).withColumnRenamed("run_start", "_run")
        ends = [
            F.min_by("_value", f"_in_{first}").alias("_begins"),
            F.max_by("_value", F.struct("_run", f"_in_{first}")).alias("_ends"),
            F.max("_run").alias("_last_run"),
        ]
        shape = inside.groupBy(*keys).agg(*ends).join(ranged.groupBy(*keys).agg(*sums), keys)
    else:
        shape = ranged.groupBy(*keys).agg(*sums)
    shape = shape.withColumns(
        {f"_start_{n}": F.coalesce(F.sum(f"_sum_{n}").over(_before(earlier)), F.lit(0)) for n in totals}
    )
    if run is not None:
        last = F.lag("_ends").over(earlier)
        goes_on = (F.lag(F.lit(1)).over(earlier) == 1) & last.eqNullSafe(F.col("_begins"))
        # A range that is all one run, begun before it, opens no run of its own.
        fresh = ~F.coalesce(goes_on, F.lit(False)) | (F.col("_last_run") > 0)
        shape = shape.withColumn("_goes_on", F.coalesce(goes_on, F.lit(False)))
        opened = F.when(fresh, F.col(f"_start_{first}") + F.col("_last_run"))
        shape = shape.withColumn("_opened", opened).withColumn("_carried", F.max("_opened").over(_before(earlier)))
    keep = [*keys, *[f"_start_{n}" for n in totals], *(["_goes_on", "_carried"] if run is not None else [])]
    joined = inside.join(small(shape.select(*keep)), keys)
    joined = joined.withColumns({n: (F.col(f"_start_{n}") + F.col(f"_in_{n}")).cast("bigint") for n in totals})
    if run is not None:
        own = F.col(f"_start_{first}") + F.col("_run")
        carried = F.col("_goes_on") & (F.col("_run") == 0)
        joined = joined.withColumn("run_start", F.when(carried, F.col("_carried")).otherwise(own).cast("bigint"))
    names = [*df.columns, *totals, *(["run_start"] if run is not None else [])]
    return joined.select(*names)


def totals_before(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    totals: Mapping[str, Column],
    run: Column | None = None,
    heavy: HeavyKeys | None = None,
) -> DataFrame:
    """Add, for each name in ``totals``, the sum of its value over the earlier rows of the group.

    With ``run`` also ``run_start``: the first total where the run of equal ``run`` values begins that
    the row is part of; ``run`` has to be what ``order`` begins with, and the first value positive. The
    order should tell rows apart. ``heavy`` are keys out of ``by`` whose rows are spread; without them
    each group is one window.
    """
    if not heavy:
        return _in_one_window(df, by, order, totals, run)
    hot, cold = heavy.divide(df)
    pieces = RANGES_PER_PIECE * sum(heavy.pieces)
    spread = _in_ranges(hot, by, order, totals, run, pieces)
    plain = _in_one_window(cold, by, order, totals, run)
    return plain.select(*spread.columns).unionByName(spread)
