"""Top category per item, dense category ids, and id translation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.functions.shapes import (
    expand_struct,
    fill_zero,
    largest_column,
    largest_entry,
    numeric_fields,
)
from tastegrid.sources.workspace import cut


def expand_counts(counts: DataFrame, struct: str = "categories") -> tuple[DataFrame, list[str]]:
    """Item id and one zero-filled count column per category, with the category names.

    Names come back in alphabetical order, which decides ties later on.
    """
    names = numeric_fields(counts.schema[struct].dataType)
    flat = expand_struct(counts, struct, ["item_id"])
    return fill_zero(flat, names), names


def top_category(df: DataFrame, names: Sequence[str], empty: str = "first") -> DataFrame:
    """The category with the highest count for each item."""
    return df.select("item_id", largest_column(names, empty).alias("top_category"))


def top_category_of_map(counts: DataFrame, empty: str = "first", column: str = "categories") -> DataFrame:
    """The category with the highest count for each item, from counts in a map.

    The rows of ``top_category`` over the same counts: a missing or null count is 0, and an item
    without a positive one gets the alphabetically first category of all items, or null with
    ``empty="null"``. Counts are not negative. The frame is read once, and categories are values in it, not columns.
    """
    if empty not in ("first", "null"):
        raise ValueError(f"empty must be 'first' or 'null', not {empty!r}")
    best = counts.select("item_id", largest_entry(column).alias("top_category"), F.array_min(F.map_keys(column)).alias("_least"))
    if empty == "null":
        return best.drop("_least")
    stored = cut(best)
    first = F.lit(stored.agg(F.min("_least")).first()[0]).cast("string")
    return stored.select("item_id", F.coalesce("top_category", first).alias("top_category"))


def category_map(top: DataFrame) -> DataFrame:
    """Dense ids from 0 in alphabetical order for the categories that occur.

    Names are column names of the counts, so the one-task numbering sees at most as
    many rows as the counts have columns.
    """
    names = top.select("top_category").where(F.col("top_category").isNotNull()).distinct()
    place = F.row_number().over(Window.orderBy("top_category")) - 1
    return names.withColumn("category_id", place.cast("bigint"))


def attach_category_id(top: DataFrame, cmap: DataFrame) -> DataFrame:
    """Category id by name; the map is bounded by the number of count columns.

    An item without a category keeps its row, with a null id.
    """
    return top.join(F.broadcast(cmap), "top_category", "left").select(
        "item_id", "category_id", "top_category"
    )


def remap_ids(df: DataFrame, id_map: DataFrame) -> DataFrame:
    """Replace item ids by the ids of the interaction files.

    Ids that are no number have no partner and drop out; ``rejected_ids`` counts them. Items
    have one row each on either side, so no key is heavy.
    """
    keyed = df.withColumn("item_id", F.col("item_id").try_cast("int")).where(
        F.col("item_id").isNotNull()
    )
    joined = keyed.join(id_map, "item_id")
    rest = [c for c in df.columns if c != "item_id"]
    return joined.select(F.col("item_id_csv").alias("item_id"), *rest)


def rejected_ids(df: DataFrame) -> DataFrame:
    """One row: how many ids are present but no number."""
    bad = F.col("item_id").isNotNull() & F.col("item_id").try_cast("int").isNull()
    return df.agg(F.count_if(bad).alias("rejected"))
