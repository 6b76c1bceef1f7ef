"""Interactions, counts and factors derived from the test tables.

Orders play the interactions: the customer is the user, the part is the item, the
quantity gives the rating and the buyer's market segment the category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.config import EvalConfig, SplitConfig
from tastegrid.operators.scoring import top_items

# The market segments of the customer table.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

SPLIT = SplitConfig(row_key=("row_key",))
TOP_10 = EvalConfig(k=10)
RECS_K = 50
# The longest array that the list queries return; longer lists go on in further rows.
LIST_LIMIT = 100_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def interactions(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, folder, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents]
    text = [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key]
    return lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        F.ceil(F.col("l_quantity") / 10).cast("int").alias("rating"),
        F.md5(F.concat_ws(":", F.lit("1"), *text)).alias("row_key"),
    )


def fixed_score(item_step: int = 7919) -> Column:
    """A fixed integer that takes the place of a prediction and has ties."""
    return (F.col("item_id") * item_step + F.col("user_id") * 104729) % 97


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Interactions with a fixed integer prediction that has ties."""
    return interactions(spark, folder).withColumn("prediction", fixed_score())


def item_counts(spark: SparkSession, folder: str) -> DataFrame:
    buyers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    bought = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        buyers, F.col("o_custkey") == F.col("c_custkey")
    )
    counts = [F.count_if(F.col("c_mktsegment") == s).alias(s) for s in SEGMENTS]
    return bought.groupBy(F.col("l_partkey").alias("item_id")).agg(*counts)


def nested_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts folded into a struct whose zero fields are null."""
    fields = [F.when(F.col(s) != 0, F.col(s)).alias(s) for s in SEGMENTS]
    counts = item_counts(spark, folder)
    return counts.select("item_id", F.struct(*fields).alias("categories"))


def item_map(spark: SparkSession, folder: str) -> DataFrame:
    """Every part, one in fifty under an id that no item has."""
    part = F.col("p_partkey")
    return table(spark, folder, "part").select(
        (part + 100000).cast("int").alias("item_id_csv"),
        F.when(part % 50 == 0, part + 1000000).otherwise(part).cast("int").alias("item_id"),
    )


def factors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("int").alias("id"),
        F.col("embedding").alias("features"),
        F.col("label").cast("bigint").alias("category_id"),
    )


def points(spark: SparkSession, folder: str) -> DataFrame:
    """Two factors as coordinates, scaled so that some points fall out of view."""
    return factors(spark, folder).select(
        F.col("id").alias("item_id"),
        "category_id",
        (F.col("features")[0].cast("double") * 100).alias("x"),
        (F.col("features")[1].cast("double") * 100).alias("y"),
    )


def fixed_recs(spark: SparkSession, folder: str, k: int = RECS_K, stored: bool | None = None) -> DataFrame:
    """Recommendations with the embeddings as the factors of users and of items."""
    both = factors(spark, folder).select("id", "features")
    return top_items(both, both, k, stored=stored)


