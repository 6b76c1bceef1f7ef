"""Filters, joins and counts over interaction rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.config import MIN_INTERACTIONS, MIN_RELEVANT_RATING, SkewConfig
from tastegrid.operators.skew import HeavyKeys, copies, heavy_from_counts, salted_join
from tastegrid.sources.files import run_sql
from tastegrid.sources.workspace import cut


def user_counts(df: DataFrame, n: int = 1) -> DataFrame:
    """Rows per user, users with fewer than ``n`` rows left out."""
    return copies(df, ["user_id"], "n").where(F.col("n") >= n)


def active_users_sql(spark: SparkSession, df: DataFrame, n: int = MIN_INTERACTIONS) -> DataFrame:
    """Rows of users with at least ``n`` rows, in SQL.

    The users are stored in between. That leaves a plain join of two shuffled tables,
    which adaptive execution can split where one user has most of the rows.
    """
    busy = run_sql(
        spark,
        "SELECT user_id FROM {interactions} GROUP BY user_id HAVING count(*) >= :least",
        {"interactions": df},
        least=n,
    )
    return run_sql(
        spark,
        """
        SELECT rows.*
        FROM {interactions} AS rows
        LEFT SEMI JOIN {busy_users} AS busy ON rows.user_id = busy.user_id
        """,
        {"interactions": df, "busy_users": cut(busy)},
    )


def active_users(
    df: DataFrame, n: int = MIN_INTERACTIONS, skew: SkewConfig = SkewConfig()
) -> DataFrame:
    """Rows of users with at least ``n`` rows; heavy users are spread over tasks.

    One stored count of users serves the search for heavy ones and the join.
    """
    counts = cut(user_counts(df.select("user_id").dropna(), n))
    heavy = heavy_from_counts(counts, ["user_id"], skew)
    return salted_join(df, counts.select("user_id"), "left_semi", heavy)


def restrict_users(df: DataFrame, users: DataFrame, heavy: HeavyKeys) -> DataFrame:
    """Rows of the given users."""
    return salted_join(df, users.select("user_id"), "left_semi", heavy)


def distinct_items(df: DataFrame) -> DataFrame:
    return df.select("item_id").distinct()


def warm_items(df: DataFrame, train: DataFrame, heavy: HeavyKeys) -> DataFrame:
    """Rows whose item occurs in the training rows.

    The item set is small next to the rows. Whether it is small enough to broadcast
    is decided from its measured size while the query runs; otherwise both sides are
    shuffled and the heavy items are salted.
    """
    return salted_join(df, distinct_items(train), "left_semi", heavy)


def relevant(df: DataFrame, min_rating: int = MIN_RELEVANT_RATING) -> DataFrame:
    return df.where(F.col("rating") >= min_rating)


def rated_pairs(test: DataFrame, min_rating: int = MIN_RELEVANT_RATING) -> DataFrame:
    """Test rows folded to one row a (user, item) pair.

    Everything the evaluation needs of the test rows survives: how often the pair
    occurs, whether one of its ratings is relevant, and the sums behind the squared
    error. Copies are combined before the shuffle, and afterwards a user has at most
    as many rows as there are items.
    """
    rating = F.col("rating").cast("double")
    return test.groupBy("user_id", "item_id").agg(
        F.count(F.lit(1)).alias("copies"),
        F.max(F.coalesce(F.col("rating") >= min_rating, F.lit(False))).alias("relevant"),
        F.count("rating").alias("rated"),
        F.sum(rating).alias("rating_sum"),
        F.sum(rating * rating).alias("rating_squares"),
    )


