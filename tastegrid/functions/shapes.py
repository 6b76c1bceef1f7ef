"""Expressions and projections over structs and arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    """A column name that may hold commas, spaces, dots or backticks."""
    return "`" + name.replace("`", "``") + "`"


def expand_struct(df: DataFrame, struct: str, keep: Sequence[str]) -> DataFrame:
    """One column per field of ``struct``, next to the ``keep`` columns."""
    return df.select(*[F.col(quoted(c)) for c in keep], F.col(f"{quoted(struct)}.*"))


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Null to zero on the named columns only."""
    return df.withColumns({c: F.coalesce(F.col(quoted(c)), F.lit(0)) for c in cols}) if cols else df


def largest_column(cols: Sequence[str], empty: str = "first") -> Column:
    """Name of the column with the largest value; the first of several wins.

    With ``empty="null"`` a row without a positive value gets null instead of the
    first name.
    """
    ranked = F.array(
        *[
            F.struct(F.col(quoted(c)).alias("value"), F.lit(-i).alias("place"), F.lit(c).alias("name"))
            for i, c in enumerate(cols)
        ]
    )
    best = F.array_max(ranked)
    if empty == "first":
        return best["name"]
    if empty == "null":
        return F.when(best["value"] > 0, best["name"])
    raise ValueError(f"empty must be 'first' or 'null', not {empty!r}")


def largest_entry(counts: str) -> Column:
    """Key of the largest positive value of a map, the first of several; null if there is none."""
    entries = F.filter(F.map_entries(quoted(counts)), lambda e: e["value"] > 0)
    most = F.array_max(F.transform(entries, lambda e: e["value"]))
    return F.array_min(F.transform(F.filter(entries, lambda e: e["value"] == most), lambda e: e["key"]))


def array_width(df: DataFrame, col: str) -> DataFrame:
    """One row with the longest length in an array column; null if there are no rows."""
    return df.agg(F.max(F.size(F.col(quoted(col)))).alias("width"))


def widen_array(df: DataFrame, col: str, width: int | None, keep: Sequence[str]) -> DataFrame:
    """Array elements as columns ``x0 ... x{width-1}``; shorter arrays give nulls."""
    elements = [F.get(F.col(quoted(col)), F.lit(i)).alias(f"x{i}") for i in range(width or 0)]
    return df.select(*keep, *elements)


def numeric_fields(schema: T.StructType) -> list[str]:
    """Names of the numeric fields in alphabetical order."""
    return sorted(f.name for f in schema.fields if isinstance(f.dataType, T.NumericType))
