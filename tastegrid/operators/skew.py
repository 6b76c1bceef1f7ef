"""Joins and counts that hold up when one key owns a third of all rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.config import MAX_HEAVY_KEYS, ROWS_PER_TASK, SkewConfig

SALT = "_salt"
SALTS = "_salts"


@dataclass(frozen=True)
class HeavyKeys:
    """The heavy keys of one frame with the number of pieces to cut each into.

    The list is at most ``SkewConfig.max_keys`` long, whatever the data, and may
    therefore be broadcast.
    """

    columns: tuple[str, ...]
    rows: tuple[tuple, ...] = ()
    pieces: tuple[int, ...] = ()

    def __bool__(self) -> bool:
        return bool(self.rows)

    def broadcast(self, like: DataFrame) -> DataFrame:
        """The list as a frame, with the key types of ``like``."""
        types = ", ".join(f"`{c}` {like.schema[c].dataType.simpleString()}" for c in self.columns)
        data = [(*row, n) for row, n in zip(self.rows, self.pieces)]
        return F.broadcast(like.sparkSession.createDataFrame(data, f"{types}, {SALTS} INT"))

    def divide(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of heavy keys, and all other rows, those with null keys included."""
        hot = self.broadcast(df).drop(SALTS)
        keys = list(self.columns)
        return df.join(hot, keys, "left_semi"), df.join(hot, keys, "left_anti")


def heavy_keys(df: DataFrame, columns: Sequence[str], skew: SkewConfig) -> HeavyKeys:
    """Find the heavy keys in one job that reads the key columns alone.

    Counts are combined before the shuffle, and only the top of the list reaches the
    driver. A key that is missed would cost time and never change a result.
    """
    keys = df.select(*columns).dropna(subset=list(columns))
    return heavy_from_counts(copies(keys, columns, "n"), columns, skew)


def heavy_from_counts(counts: DataFrame, columns: Sequence[str], skew: SkewConfig) -> HeavyKeys:
    """The same from a table that already holds one count ``n`` per key."""
    top = (
        counts.where(F.col("n") > skew.rows_per_task)
        .select(*columns, "n")
        .orderBy(F.desc("n"), *columns)
        .limit(skew.max_keys)
        .collect()
    )
    return HeavyKeys(
        tuple(columns),
        tuple(tuple(row[c] for c in columns) for row in top),
        tuple(math.ceil(row["n"] / skew.rows_per_task) for row in top),
    )


def salted_join(
    left: DataFrame, right: DataFrame, how: str, heavy: HeavyKeys, on: Sequence[str] | None = None
) -> DataFrame:
    """Equi-join whose heavy keys are spread over several tasks.

    Left rows of a heavy key get a salt, right rows of that key are repeated once a
    salt, so every left row meets all its partners exactly once. The salt depends on
    row content and on the partition the row sits in, both of which survive a retry;
    the partition also separates identical copies. Columns come out in the order of
    the left frame, followed by those of the right.
    """
    keys = list(on or heavy.columns)
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    semi = how in ("left_semi", "left_anti")
    rest = [] if semi else [c for c in right.columns if c not in keys]
    columns = [F.col(f"`{c}`") for c in left.columns + rest]
    if not heavy:
        return left.join(right, keys, how).select(*columns)
    by = list(heavy.columns)
    hot = heavy.broadcast(left)
    content = F.xxhash64(*[F.col(f"`{c}`") for c in left.columns], F.spark_partition_id())
    salted = (
        left.join(hot, by, "left")
        .withColumn(SALT, F.coalesce(F.pmod(content, F.col(SALTS)), F.lit(0)).cast("int"))
        .drop(SALTS)
    )
    last = F.coalesce(F.col(SALTS), F.lit(1)) - 1
    repeated = (
        right.join(hot, by, "left")
        .withColumn(SALT, F.explode(F.sequence(F.lit(0), last)))
        .drop(SALTS)
    )
    return salted.join(repeated, [*keys, SALT], how).select(*columns)


def small(df: DataFrame, limit: int = MAX_HEAVY_KEYS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows, else unchanged."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def copies(df: DataFrame, columns: Sequence[str], name: str = "copies") -> DataFrame:
    """Identical rows folded into one, with their number."""
    return df.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count(F.lit(1)).alias(name))


def expand_copies(df: DataFrame, name: str, chunk: int = ROWS_PER_TASK // 16) -> DataFrame:
    """The inverse of ``copies``: every row repeated ``name`` times.

    Two steps keep the generated arrays short even for billions of copies, and the
    shuffle between them spreads the pieces of one row over the cluster. Rows with
    few copies take the short way.
    """
    n = F.col(name)
    kept = [F.col(f"`{c}`") for c in df.columns if c != name]
    few = df.where(n.between(1, chunk)).select(
        *kept, F.explode(F.sequence(F.lit(1), n)).alias("_copy")
    )
    pieces = (
        df.where(n > chunk)
        .withColumn("_piece", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("bigint"))))
        .repartition("_piece", *kept)
    )
    size = F.least(F.lit(chunk).cast("bigint"), n - F.col("_piece") * chunk)
    many = pieces.select(*kept, F.explode(F.sequence(F.lit(1).cast("bigint"), size)).alias("_copy"))
    return few.select(*kept).unionByName(many.select(*kept))
