from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tastegrid.config import SkewConfig, SplitConfig
from tastegrid.operators.ordinals import key_offsets
from tastegrid.plans.split import (
    assign_parts,
    halves,
    merge_train,
    sample_users,
    split_interactions,
    split_users,
)

KEYED = SplitConfig(row_key=("row_key",))
SMALL = SkewConfig(rows_per_task=40)


def bag(df):
    return Counter(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def rows(spark):
    """120 users of which every seventh has a third of a thousand rows or more."""
    n = F.when(F.col("id") % 7 == 0, 90 + F.col("id")).otherwise(8 + F.col("id") % 9)
    users = spark.range(120).select(
        F.col("id").alias("user_id"), F.explode(F.sequence(F.lit(1).cast("bigint"), n)).alias("i")
    )
    return users.select(
        "user_id",
        (F.col("i") * 31 % 57).alias("item_id"),
        (F.col("i") % 5 + 1).cast("int").alias("rating"),
        F.md5(F.concat_ws(":", "user_id", "i")).alias("row_key"),
    )


@pytest.fixture(scope="module")
def labeled(rows):
    return assign_parts(rows, KEYED).persist()


def test_every_active_row_has_one_part(rows, labeled):
    active = rows.groupBy("user_id").count().where("count >= 10").select("user_id")
    assert bag(labeled.drop("part")) == bag(rows.join(active, "user_id", "left_semi"))


def test_users_of_val_and_test_are_disjoint(labeled):
    val = labeled.where("part = 'val'").select("user_id").distinct()
    test = labeled.where("part = 'test'").select("user_id").distinct()
    assert val.count() > 5 and test.count() > 5
    assert val.intersect(test).count() == 0


def test_halves_of_a_user_differ_by_at_most_one(rows):
    counts = halves(rows, KEYED).groupBy("user_id").pivot("half", [0, 1]).count().fillna(0)
    assert counts.where("abs(`0` - `1`) > 1").count() == 0


def test_halves_follow_the_global_index(rows):
    total = rows.count()
    first = halves(rows, KEYED).where("half = 0").count()
    assert first == (total + 1) // 2


def test_result_does_not_depend_on_partitioning(spark, rows, labeled):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert bag(assign_parts(rows.repartition(13), KEYED)) == bag(labeled)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_heavy_users_give_the_same_split(rows, labeled):
    assert bag(assign_parts(rows, replace(KEYED, skew=SMALL))) == bag(labeled)
    assert bag(halves(rows, replace(KEYED, skew=SMALL))) == bag(halves(rows, KEYED))


def test_without_row_key_copies_are_kept(rows):
    bare = rows.drop("row_key")
    copied = bare.unionByName(bare.where("user_id = 7")).unionByName(bare.where("user_id = 14"))
    for skew in (SkewConfig(), SMALL):
        cfg = SplitConfig(min_interactions=1, skew=skew)
        assert bag(assign_parts(copied, cfg).drop("part")) == bag(copied)
        counts = halves(copied, cfg).groupBy("user_id").pivot("half", [0, 1]).count().fillna(0)
        assert counts.where("abs(`0` - `1`) > 1").count() == 0
    plain = assign_parts(copied, SplitConfig(min_interactions=1))
    assert bag(assign_parts(copied, cfg)) == bag(plain)


def test_warm_items_schema_and_totals(rows, labeled, tmp_path):
    for store in (None, str(tmp_path / "labeled")):
        train, val, test = split_interactions(rows, KEYED, store)
        assert train.schema.names == val.schema.names == test.schema.names == rows.columns
        assert [f.dataType for f in train.schema] == [f.dataType for f in rows.schema]
        items = train.select("item_id").distinct()
        for part, name in ((val, "val"), (test, "test")):
            assert part.join(items, "item_id", "left_anti").count() == 0
            warm = labeled.where(F.col("part") == name).join(items, "item_id", "left_semi")
            assert part.count() == warm.count()
        assert bag(train) == bag(labeled.where("part = 'train'").drop("part"))


def test_item_only_in_val_is_dropped(spark, rows):
    val_user = assign_parts(rows, KEYED).where("part = 'val'").first()["user_id"]
    odd = rows.withColumn(
        "item_id", F.when(F.col("user_id") == val_user, F.hash("row_key").cast("bigint")).otherwise(F.col("item_id"))
    )
    train, val, _ = split_interactions(odd, KEYED)
    assert val.where(F.col("user_id") == val_user).count() == 0
    assert train.where(F.col("user_id") == val_user).count() > 0


def test_split_and_sample_shares(spark):
    users = spark.range(20000).select(F.col("id").alias("user_id"))
    shares = dict(split_users(users, (0.6, 0.2, 0.2), 1).groupBy("part").count().collect())
    assert abs(shares["train"] - 12000) < 300 and abs(shares["val"] - 4000) < 250
    assert sample_users(users, 100, 1) is users
    sampled = sample_users(users, 10, 1)
    assert abs(sampled.count() - 2000) < 200
    shares = dict(split_users(sampled, (0.6, 0.2, 0.2), 1).groupBy("part").count().collect())
    assert abs(shares["train"] / sampled.count() - 0.6) < 0.05


def test_key_offsets_by_ranges_equal_one_window(spark):
    counts = spark.range(1000).select(
        (F.col("id") * F.col("id")).alias("user_id"),
        (F.col("id") % 7 + 1).alias("n"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("part"),
    )
    one = key_offsets(counts, "part", "user_id")
    many = key_offsets(counts, "part", "user_id", rows_per_task=70)
    assert bag(many.select("user_id", "before")) == bag(one.select("user_id", "before"))


def test_merge_train_matches_by_name_and_keeps_duplicates(spark):
    a = spark.createDataFrame([(1, 2)], "user_id INT, item_id INT")
    b = spark.createDataFrame([(2, 1), (2, 1)], "item_id INT, user_id INT")
    assert bag(merge_train(a, b)) == {(1, 2): 3}


def test_text_ids_work_beyond_one_task(spark):
    counts = spark.range(1000).select(
        F.concat(F.lit("u"), F.md5(F.col("id").cast("string"))).alias("user_id"),
        (F.col("id") % 7 + 1).alias("n"),
        F.lit("a").alias("part"),
    )
    one = key_offsets(counts, "part", "user_id")
    many = key_offsets(counts, "part", "user_id", rows_per_task=70)
    assert bag(many.select("user_id", "before")) == bag(one.select("user_id", "before"))


def test_row_key_that_is_not_unique_gives_one_split(spark, rows):
    """Rows with equal keys go by their other columns, under any partitioning."""
    same = rows.withColumn("row_key", F.lit("same"))
    one = bag(assign_parts(same.repartition(7), KEYED))
    assert one == bag(assign_parts(same.repartition(3), KEYED))
    train, val, test = split_interactions(same, KEYED)
    assert sum(one.values()) >= train.count() + val.count() + test.count()
