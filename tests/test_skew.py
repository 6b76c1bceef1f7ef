import pytest
from pyspark.sql import functions as F

from tastegrid.config import SkewConfig
from tastegrid.operators.interactions import active_users
from tastegrid.operators.skew import copies, expand_copies, heavy_keys, salted_join

SMALL = SkewConfig(rows_per_task=50)


def bag(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows belongs to key 1, a third of those are copies of one row."""
    hot = spark.range(400).select(F.lit(1).alias("k"), F.greatest("id", F.lit(130)).alias("v"))
    cold = spark.range(800).select((F.col("id") % 97 + 2).cast("int").alias("k"), F.col("id").alias("v"))
    nulls = spark.range(60).select(F.lit(None).cast("int").alias("k"), F.col("id").alias("v"))
    return hot.unionByName(cold).unionByName(nulls).repartition(6)


def test_heavy_keys(rows):
    heavy = heavy_keys(rows, ["k"], SMALL)
    assert heavy.rows == ((1,),)
    assert heavy.pieces == (8,)
    assert not heavy_keys(rows, ["k"], SkewConfig())


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, rows, how):
    right = spark.createDataFrame(
        [(1, "a"), (1, "b"), (2, "c"), (5, "d"), (500, "e")], "k INT, name STRING"
    )
    plain = rows.join(right, ["k"], how)
    salted = salted_join(rows, right, how, heavy_keys(rows, ["k"], SMALL))
    assert salted.columns == plain.columns
    assert bag(salted) == bag(plain)


def test_salts_spread_the_heavy_key(rows):
    heavy = heavy_keys(rows, ["k"], SMALL)
    right = rows.select("k").distinct()
    plan = salted_join(rows, right, "left_semi", heavy)._jdf.queryExecution().toString()
    assert "_salt" in plan


def test_divide_keeps_null_keys(rows):
    hot, cold = heavy_keys(rows, ["k"], SMALL).divide(rows)
    assert hot.count() == 400
    assert cold.count() == 860
    assert cold.where("k IS NULL").count() == 60


def test_copies_round_trip(rows):
    folded = copies(rows, ["k", "v"])
    assert folded.agg(F.max("copies")).first()[0] == 131
    assert bag(expand_copies(folded, "copies")) == bag(rows)
    assert bag(expand_copies(folded, "copies", chunk=7)) == bag(rows)


def test_active_users_with_a_heavy_user(spark, rows):
    df = rows.select(F.col("k").alias("user_id"), "v")
    plain = active_users(df, 9)
    assert bag(active_users(df, 9, SMALL)) == bag(plain)
    assert plain.groupBy("user_id").count().agg(F.min("count")).first()[0] >= 9


def test_activity_limit_is_inclusive(spark):
    df = spark.createDataFrame(
        [(u, i) for u, n in ((1, 9), (2, 10), (3, 11)) for i in range(n)], "user_id INT, item_id INT"
    )
    assert {r["user_id"] for r in active_users(df, 10).collect()} == {2, 3}
