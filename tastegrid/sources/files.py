"""Parquet, JSON and CSV tables, SQL text, and stored models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.recommendation import ALSModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ID_MAP_SCHEMA = "item_id_csv INT, item_id INT"
CATEGORY_MAP_SCHEMA = "category_id BIGINT, category STRING"


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_counts_json(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """Nested counts, one JSON object a line.

    Without a schema Spark reads all lines once more to infer it, with the struct
    fields in alphabetical order; name the schema for large inputs.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def read_counts_map(
    spark: SparkSession, path: str, id_type: str = "STRING", value_type: str = "BIGINT"
) -> DataFrame:
    """Nested counts as a map from category to count, one JSON object a line.

    The lines are read once: no categories have to be known or inferred, and none is a field of the
    schema, however many there are.
    """
    schema = f"item_id {id_type}, categories MAP<STRING, {value_type}>"
    return spark.read.schema(schema).json(path)


def counts_schema(categories: Sequence[str], id_type: T.DataType | None = None) -> T.StructType:
    """Schema for ``read_counts_json`` with the categories in alphabetical order."""
    counts = T.StructType([T.StructField(c, T.LongType()) for c in sorted(categories)])
    return T.StructType(
        [
            T.StructField("item_id", id_type or T.StringType()),
            T.StructField("categories", counts),
        ]
    )


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """Translation of item ids: CSV with a header line."""
    return spark.read.csv(path, header=True, schema=ID_MAP_SCHEMA)


def read_category_map(spark: SparkSession, path: str) -> DataFrame:
    """Category ids and names: CSV without a header line."""
    return spark.read.csv(path, header=False, schema=CATEGORY_MAP_SCHEMA)


def wide_schema(width: int, value_type: str = "FLOAT") -> str:
    columns = ["item_id INT", "category_id BIGINT"]
    return ", ".join(columns + [f"x{i} {value_type}" for i in range(width)])


def read_wide_factors(
    spark: SparkSession, path: str, width: int | None = None, value_type: str = "FLOAT"
) -> DataFrame:
    """Wide factors from a folder of CSV parts, each with a header line.

    An unknown width is taken from the header of one part.
    """
    if width is None:
        width = len(spark.read.csv(path, header=True).columns) - 2
    return spark.read.csv(path, header=True, schema=wide_schema(max(width, 0), value_type))


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write; an existing path is an error."""
    df.write.partitionBy(*partition_by).parquet(path)


def write_wide_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_csv(df: DataFrame, path: str, header: bool) -> None:
    df.write.option("header", header).csv(path)


def run_sql(
    spark: SparkSession, text: str, frames: Mapping[str, DataFrame], **params: object
) -> DataFrame:
    """SQL text over DataFrames, which it names in braces; no view stays in the session."""
    return spark.sql(text, args=params or None, **frames)


def save_model(model: ALSModel, path: str) -> None:
    model.save(path)


def load_model(path: str) -> ALSModel:
    return ALSModel.load(path)
