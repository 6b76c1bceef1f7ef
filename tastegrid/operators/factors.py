"""Item factors next to categories: joins, wide form, linear projection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.functions.shapes import array_width, quoted, widen_array
from tastegrid.operators.skew import small


def factors_by_category(factors: DataFrame, categories: DataFrame) -> DataFrame:
    """Item factors with the category of the item; both sides have unique ids."""
    return factors.join(categories, factors["id"] == categories["item_id"]).select(
        "item_id", "category_id", "features"
    )


def wide_factors(df: DataFrame, width: int | None = None) -> DataFrame:
    """``item_id``, ``category_id`` and one column per factor.

    An unknown width is measured; an empty input has no factor columns.
    """
    if width is None:
        width = array_width(df, "features").first()["width"]
    return widen_array(df, "features", width, ["item_id", "category_id"])


def with_category_name(df: DataFrame, cmap: DataFrame) -> DataFrame:
    """Category names by id, null where the map has none.

    The few categories would make for few, large join tasks, so the map is broadcast if
    its size allows.
    """
    return df.join(small(cmap), "category_id", "left")


def factor_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``i, j, n, mean, covariance`` for each two coordinates with j >= i; the mean is that of i.

    ``n`` rows have all coordinates; rows with a null one are left out. The sample covariance is summed
    in mergeable aggregates, one group for each coordinate, and is null below two rows. There are
    as many rows as pairs of coordinates, none if no row is complete.
    """
    values = F.array(*[F.col(quoted(c)).cast("double") for c in columns])
    complete = df.select(values.alias("v")).where(~F.exists("v", lambda x: x.isNull()))
    spread = complete.select(F.posexplode("v").alias("i", "x"), "v")
    others = [F.covar_samp("x", F.get("v", F.lit(j))).alias(f"c{j}") for j in range(len(columns))]
    rows = spread.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), *others)
    pairs = F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"c{j}").alias("covariance")) for j in range(len(columns))])
    return rows.select("i", "n", "mean", F.inline(pairs)).where("j >= i").select("i", "j", "n", "mean", "covariance")


def project_2d(df: DataFrame, columns: list[str]) -> DataFrame:
    """The two directions of largest variance as ``x`` and ``y``, in place of the coordinates.

    The covariance is summed on the executors; only a matrix of the size of the
    factors squared is handled in one place. Signs are fixed so that the largest
    loading of each direction is positive. A row with a null coordinate is null in both and
    takes no part in the covariance.
    """
    width = len(columns)
    matrix = np.zeros((max(width, 2), max(width, 2)))
    for row in factor_moments(df, columns).collect():
        matrix[row["i"], row["j"]] = matrix[row["j"], row["i"]] = row["covariance"] or 0.0
    axes = np.linalg.eigh(matrix)[1][:width, ::-1][:, :2].T
    axes = [axis * (1.0 if axis[np.abs(axis).argmax()] >= 0 else -1.0) for axis in axes]
    values = F.array(*[F.col(quoted(c)).cast("double") for c in columns])

    def along(axis: np.ndarray) -> Column:
        weights = F.array(*[F.lit(float(w)) for w in axis])
        return F.aggregate(F.zip_with(values, weights, lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)

    kept = [F.col(quoted(c)) for c in df.columns if c not in columns]
    return df.select(*kept, *[along(axis).alias(name) for axis, name in zip(axes, "xy")])
