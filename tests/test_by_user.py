"""Tables kept by user, and users in several tasks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tastegrid.config import EvalConfig, SkewConfig
from tastegrid.operators import ranking
from tastegrid.operators.interactions import rated_pairs
from tastegrid.operators.running import _in_ranges, totals_before
from tastegrid.operators.skew import copies, heavy_keys
from tastegrid.plans.evaluate import candidates_by_user, candidates_from_recs, evaluate_scores, user_facts
from tastegrid.sources.by_user import UserTables

RNG = random.Random(11)


def bag(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def rows(spark):
    """One user has most of the rows, one prediction most of these; items repeat."""
    data = [(1, i % 311, 7 if i % 3 else i % 40, i % 5 + 1) for i in range(3000)]
    data += [(u, RNG.randrange(50), RNG.randrange(9), RNG.randrange(1, 6)) for u in range(2, 20) for _ in range(30)]
    data += [(None, 4, 3, 5), (None, 5, 3, 1), (50, 8, 2, None)]
    return spark.createDataFrame(data, "user_id INT, item_id INT, prediction INT, rating INT").repartition(6).persist()


@pytest.mark.parametrize("per_task", [5, 40, 100, 1000])
@pytest.mark.parametrize("k, ties", [(None, "rank"), (10, "rank"), (700, "rank"), (200, "row_number"), (1, "rank")])
def test_places_of_heavy_users_are_the_same(rows, per_task, k, ties):
    cands = copies(rows, ["user_id", "item_id", "prediction"]).withColumn("relevant", F.col("item_id") % 3 == 0)
    heavy = heavy_keys(cands, ["user_id"], SkewConfig(rows_per_task=per_task))
    assert heavy or per_task > 300
    plain = ranking.place_candidates(cands, k, ties)
    spread = ranking.place_candidates(cands, k, ties, heavy)
    assert sorted(plain.columns) == sorted(spread.columns)
    assert dict(plain.dtypes) == dict(spread.dtypes)
    assert bag(spread.select(*plain.columns)) == bag(plain)


def test_a_heavy_user_takes_several_tasks(rows):
    cands = copies(rows, ["user_id", "item_id", "prediction"])
    hot = cands.where("user_id = 1")
    order = [F.desc("prediction"), F.col("item_id")]
    spread = _in_ranges(hot, ["user_id"], order, {"start": F.col("copies")}, None, 12)
    text = spread._jdf.queryExecution().executedPlan().toString()
    # The rows are dealt by user and range; only the totals of the ranges go by user alone.
    windows = [line for line in text.splitlines() if "Window [" in line]
    of_rows = [line for line in windows if "sum(copies" in line]
    assert of_rows and all("windowspecdefinition(user_id" in line and ", _range" in line for line in of_rows)
    assert all("_sum_start" in line for line in windows if line not in of_rows)
    assert spread.count() == hot.count()


def test_metrics_of_heavy_users_are_the_same(rows):
    for cfg in (EvalConfig(k=10), EvalConfig(k=300, ties="row_number"), EvalConfig(k=50, dedup=True)):
        plain = evaluate_scores(rows, cfg).first()
        spread = evaluate_scores(rows, cfg, SkewConfig(rows_per_task=25)).first()
        assert tuple(spread) == pytest.approx(tuple(plain), abs=1e-12)


def test_totals_with_equal_values_across_ranges(spark):
    """A run of equal values over many ranges keeps the total at which it began."""
    data = [(1, v, i) for i, v in enumerate([9] * 3 + [5] * 400 + [4] + [2] * 200 + [1] * 5)]
    df = spark.createDataFrame(data, "user_id INT, v INT, i INT")
    heavy = heavy_keys(df, ["user_id"], SkewConfig(rows_per_task=40))
    found = totals_before(df, ["user_id"], [F.desc("v"), F.col("i")], {"t": F.lit(2)}, F.col("v"), heavy)
    opened = {9: 0, 5: 6, 4: 806, 2: 808, 1: 1208}
    assert sorted((r["i"], r["t"], r["run_start"]) for r in found.collect()) == [
        (i, 2 * i, opened[v]) for _, v, i in data
    ]


@pytest.mark.parametrize("k, ties", [(None, "rank"), (12, "rank"), (12, "row_number")])
@pytest.mark.parametrize("limit", [3, 100_000])
def test_pairs_in_one_pass_equal_joined_lists(spark, rows, k, ties, limit):
    known = rows.where("user_id IS NOT NULL")
    pred = ranking.ordered_predictions(known, limit, k, ties)
    labels = ranking.relevant_items(known.where("rating >= 3"), limit)
    wanted = ranking.ranking_pairs(pred, labels)
    with UserTables(spark, 3) as tables:
        stored = tables.put("rows", known)
        assert bag(ranking.pairs_in_one_pass(stored, limit, k, ties)) == bag(wanted)
    assert bag(ranking.pairs_in_one_pass(known, limit, k, ties)) == bag(wanted)
    assert ranking.pairs_in_one_pass(known.limit(0), limit, k, ties).count() == 0


@pytest.mark.parametrize("mode", ["all_items", "unseen_items", "recs_in_test"])
@pytest.mark.parametrize("dedup", [False, True])
def test_candidates_by_user_equal_joins(spark, rows, mode, dedup):
    test = rows.where("item_id % 2 = 0 AND user_id IS NOT NULL")
    train = rows.where("item_id % 2 = 1 OR item_id % 8 = 0").where("user_id IS NOT NULL")
    lists = [(u, [(i, float(-i)) for i in range(40)]) for u in range(1, 25)]
    recs = spark.createDataFrame(
        lists, "user_id BIGINT, recommendations ARRAY<STRUCT<item_id: BIGINT, rating: DOUBLE>>"
    )
    cfg = EvalConfig(mode=mode, k=40, dedup=dedup)
    pairs = rated_pairs(test)
    wanted = candidates_from_recs(recs, train, pairs, cfg)
    with UserTables(spark, 5) as tables:
        got = candidates_by_user(recs, user_facts(tables, train, pairs, cfg), cfg)
        assert bag(got.select(*wanted.columns)) == bag(wanted)
    assert wanted.count() > 0


def test_tables_meet_without_exchange_and_go(spark, rows):
    with UserTables(spark, 4) as tables:
        a = tables.put("a", rows.select("user_id", "item_id").distinct())
        b = tables.put("b", rows.selectExpr("CAST(user_id AS BIGINT) AS user_id", "rating"))
        counts = b.groupBy("user_id").agg(F.count("rating").alias("n"))
        window = Window.partitionBy("user_id").orderBy("item_id")
        joined = a.withColumn("place", F.row_number().over(window)).join(counts.hint("merge"), "user_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == rows.where("user_id IS NOT NULL").select("user_id", "item_id").distinct().count()
        assert dict(a.dtypes) == {"user_id": "bigint", "item_id": "bigint"}
        names = list(tables.paths)
        assert all(spark.catalog.tableExists(n) for n in names)
    assert not any(spark.catalog.tableExists(n) for n in names) and tables.paths == {}


@pytest.mark.parametrize("mode", ["all_items", "unseen_items", "recs_in_test"])
def test_candidates_are_the_tested_pairs_of_a_list(spark, mode):
    """One row for a tested pair, one for the end of a list; other items only move these down."""
    lists = [(u, [(i, float(-i)) for i in range(100)]) for u in (1, 2, 3)]
    recs = spark.createDataFrame(
        lists, "user_id BIGINT, recommendations ARRAY<STRUCT<item_id: BIGINT, rating: DOUBLE>>"
    )
    schema = "user_id INT, item_id INT, rating INT"
    test = spark.createDataFrame([(1, 50, 5), (1, 50, 1), (1, 7, 1), (2, 200, 5), (1, 30, 4)], schema)
    train = spark.createDataFrame([(1, 3, 5), (1, 30, 5), (1, 3, 1), (2, 0, 1), *[(3, i, 1) for i in range(100)]], schema)
    found = candidates_from_recs(recs, train, rated_pairs(test), EvalConfig(mode=mode, k=100))
    rows = {(r["user_id"], r["item_id"], r["start"], r["copies"], r["relevant"]) for r in found.collect()}
    wanted = {
        "all_items": {(1, 7, 7, 1, False), (1, 30, 30, 1, True), (1, 50, 50, 1, True)}
        | {(u, None, 100, 1, False) for u in (1, 2, 3)},
        "unseen_items": {(1, 7, 6, 1, False), (1, 50, 48, 1, True), (1, None, 98, 1, False), (2, None, 99, 1, False)},
        "recs_in_test": {(1, 7, 0, 1, False), (1, 30, 1, 1, True), (1, 50, 2, 2, True)},
    }
    assert rows == wanted[mode]
