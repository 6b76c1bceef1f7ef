from collections import Counter

import pytest
from pyspark.sql import functions as F

from tastegrid.config import ViewConfig
from tastegrid.functions.hashing import draw
from tastegrid.operators.ordinals import bucket_bits, hash_ordinal
from tastegrid.operators.sampling import (
    _pick,
    plot_points,
    resample_percent,
    resample_to_smallest,
    sample_size,
    smallest_class,
)


def bag(df):
    return Counter(map(tuple, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def points(spark):
    """Class 3 has most rows, class 1 is missing."""
    kind = F.when(F.col("id") % 10 == 0, 0).when(F.col("id") % 10 == 1, 2).otherwise(3)
    return spark.range(605).select(
        F.col("id").alias("item_id"),
        kind.cast("bigint").alias("category_id"),
        (F.col("id") % 60 - 30.0).alias("x"),
        F.lit(0.0).alias("y"),
    )


def test_sizes_round_halves_to_even():
    assert [sample_size(n, 50) for n in (1, 3, 5, 7)] == [0, 2, 2, 4]
    assert sample_size(1000, 5) == 50
    assert bucket_bits(10, 100) == 0
    assert bucket_bits(800, 100) == 3
    assert bucket_bits(600_000, tasks=8) == 3
    assert bucket_bits(100, tasks=8) == 0


def test_ordinals_are_complete_and_independent_of_buckets(points):
    one = hash_ordinal(points, "p", 1, ["item_id"], 605)
    many = hash_ordinal(points, "p", 1, ["item_id"], 605, rows_per_task=40)
    assert bag(one) == bag(many)
    assert sorted(r["ordinal"] for r in many.collect()) == list(range(605))
    by = hash_ordinal(points, "p", 1, ["item_id"], 605, ["category_id"])
    by_many = hash_ordinal(points, "p", 1, ["item_id"], 605, ["category_id"], rows_per_task=40)
    assert bag(by) == bag(by_many)
    ends = {r[0]: (r[1], r[2], r[3]) for r in by_many.groupBy("category_id").agg(F.min("ordinal"), F.max("ordinal"), F.count_distinct("ordinal")).collect()}
    assert ends == {0: (0, 60, 61), 2: (0, 60, 61), 3: (0, 482, 483)}


def test_resample_percent(points):
    drawn = resample_percent(points, 30, 1, ["item_id"])
    assert drawn.count() == round(605 * 0.3)
    assert drawn.select("draw_id").distinct().count() == drawn.count()
    assert drawn.select("item_id").distinct().count() < drawn.count()
    assert bag(drawn) == bag(resample_percent(points.repartition(7), 30, 1, ["item_id"], 40))
    assert bag(drawn) != bag(resample_percent(points, 30, 2, ["item_id"]))


def test_resample_percent_picks_by_draw(spark, points):
    order = {
        r["ordinal"]: r["item_id"]
        for r in hash_ordinal(points, "place", 1, ["item_id"], 605).collect()
    }
    halves = (draw("pick-high", 1, ["id"]).alias("high"), draw("pick", 1, ["id"]).alias("low"))
    draws = spark.range(61).select("id", *halves).collect()
    expected = {r["id"]: order[(r["high"] * 2**32 + r["low"]) % 605] for r in draws}
    got = resample_percent(points, 10, 1, ["item_id"])
    assert {r["draw_id"]: r["item_id"] for r in got.collect()} == {
        i: expected[i] for i in range(60)
    }


def test_resample_to_smallest(points):
    assert smallest_class(points, "category_id").first()["min_count"] == 61
    drawn = resample_to_smallest(points, "category_id", 1, ["item_id"])
    sizes = dict(drawn.groupBy("category_id").count().collect())
    assert sizes == {0: 61, 2: 61, 3: 61}
    assert bag(drawn) == bag(
        resample_to_smallest(points.repartition(5), "category_id", 1, ["item_id"], 40)
    )
    original = points.select("item_id", "category_id")
    assert drawn.select("item_id", "category_id").subtract(original).count() == 0


def test_resample_of_nothing(points):
    empty = points.where("item_id < 0")
    assert resample_percent(empty, 50, 1, ["item_id"]).count() == 0
    assert resample_to_smallest(empty, "category_id", 1, ["item_id"]).count() == 0


def test_plot_points(points):
    whole = plot_points(points, ["item_id"], ViewConfig(plot_percent=0, balance=False))
    assert whole.count() == 605
    flags = {r["x"]: r["in_view"] for r in whole.collect()}
    assert flags[-25.0] and flags[25.0] and not flags[-26.0] and not flags[26.0]
    sampled = plot_points(points, ["item_id"], ViewConfig(plot_percent=50, balance=False))
    assert sampled.count() == sample_size(605, 50)
    balanced = plot_points(points, ["item_id"], ViewConfig(plot_percent=50))
    sizes = {r["count"] for r in balanced.groupBy("category_id").count().collect()}
    least = sampled.groupBy("category_id").count().agg(F.min("count")).first()[0]
    assert sizes == {least}


def test_picks_are_even_for_very_large_tables(spark):
    """Three billion rows: the lower ordinals get their share of the draws, and no more."""
    n, rows = 200_000, 3_000_000_000
    picks = spark.range(n).select(_pick(F.lit(rows), 1, [F.col("id")]).alias("p"))
    low = picks.where(F.col("p") < (1 << 32) % rows).count() / n
    assert abs(low - ((1 << 32) % rows) / rows) < 0.01
    assert picks.agg(F.max("p")).first()[0] < rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("by", [None, "category_id"])
def test_resampling_shuffles_the_rows_once(spark, points, tmp_path, by):
    """With forced buckets: one scan, and one exchange that carries rows."""
    points.write.parquet(str(tmp_path / "points"))
    rows = spark.read.parquet(str(tmp_path / "points"))
    if by:
        drawn = resample_to_smallest(rows, by, 1, ["item_id"], 40)
    else:
        drawn = resample_percent(rows, 30, 1, ["item_id"], 40)
    text = plan(drawn)
    assert text.count("FileScan parquet") == 1
    assert sum("_row" in line or "_digest" in line for line in text.splitlines() if "Exchange" in line) <= 1
    # Both windows keep the one partitioning by bucket.
    above = text[: text.index("Union")]
    assert above.count("Exchange hashpartitioning") == 1 and "Join" not in above
    plain = resample_to_smallest(points, by, 1, ["item_id"]) if by else resample_percent(points, 30, 1, ["item_id"])
    assert bag(drawn) == bag(plain)


def test_draws_are_even_over_seeds(spark):
    """Every row is drawn equally often, whatever its bucket, over many seeds."""
    rows = spark.range(40).withColumn("k", F.lit(1))
    drawn = [resample_percent(rows, 100, seed, ["id"], 10).select("id") for seed in range(12)]
    every = drawn[0]
    for more in drawn[1:]:
        every = every.unionByName(more)
    counts = dict(every.groupBy("id").count().collect())
    assert sum(counts.values()) == 480
    chi = sum((counts.get(i, 0) - 12) ** 2 / 12 for i in range(40))
    assert chi < 80  # 39 degrees of freedom: exceeded by chance once in about 8,000


def test_one_class_may_own_nearly_all_rows(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") < 30, "few").otherwise("most").alias("kind"))
    drawn = resample_to_smallest(rows, "kind", 3, ["id"], 100)
    assert dict(drawn.groupBy("kind").count().collect()) == {"few": 30, "most": 30}
    assert bag(drawn) == bag(resample_to_smallest(rows.repartition(9), "kind", 3, ["id"]))
    assert drawn.where("(kind = 'few') <> (id < 30)").count() == 0


def test_draws_in_several_pieces(spark, monkeypatch):
    from tastegrid.operators import sampling

    rows = spark.range(300).select("id", (F.col("id") % 2).alias("kind"))
    whole = bag(resample_to_smallest(rows, "kind", 1, ["id"]))
    monkeypatch.setattr(sampling, "PIECE", 7)
    assert bag(resample_to_smallest(rows, "kind", 1, ["id"])) == whole and sum(whole.values()) == 300


def test_draws_are_made_in_several_tasks(spark, monkeypatch):
    """Pieces are short before the draws are made of them, so nothing may put them together by size."""
    from tastegrid.operators import sampling

    rows = spark.range(3000).select("id", (F.col("id") % 3).alias("kind"))
    monkeypatch.setattr(sampling, "PIECE", 50)
    drawn = resample_to_smallest(rows, "kind", 1, ["id"])
    exchanges = [line for line in plan(drawn).splitlines() if "Exchange" in line and "_piece" in line]
    assert exchanges and all("REPARTITION_BY_NUM" in line for line in exchanges)
    assert drawn.groupBy("kind").count().where("count <> 1000").count() == 0


@pytest.mark.parametrize("rows", [1, 7, 3_600_000, (1 << 31) - 1, 1 << 31, 10**12])
def test_picks_are_remainders_of_64_bits(spark, rows):
    from tastegrid.functions.hashing import draw
    from tastegrid.operators.sampling import _pick

    ids = spark.range(200)
    low, high = draw("pick", 1, ["id"]), draw("pick-high", 1, ["id"])
    found = ids.select(_pick(F.lit(rows), 1, ["id"]).alias("got"), low.alias("low"), high.alias("high")).collect()
    assert [r["got"] for r in found] == [((r["high"] << 32) + r["low"]) % rows for r in found]
