import math
import random

import pytest
from pyspark.ml.evaluation import RankingEvaluator
from pyspark.mllib.evaluation import RankingMetrics
from pyspark.sql import functions as F

from tastegrid.config import EvalConfig, SkewConfig
from tastegrid.operators import ranking
from tastegrid.operators.skew import copies
from tastegrid.plans.evaluate import evaluate_points, evaluate_scores

TOY = [
    (1, [1, 2, 3, 4, 5], [2, 5, 9]),
    (2, [7, 8], [7]),
    (3, [1, 2, 3], [10, 11]),
    (4, [4, 4, 6], [4, 4, 6]),
]


def bag(df):
    return sorted(map(tuple, df.collect()), key=str)


def placed_and_labels(spark, pairs):
    rows, label_rows = [], []
    for user, pred, label in pairs:
        rows += [(user, item, pos, 1, item in label) for pos, item in enumerate(pred)]
        label_rows.append((user, len(set(label))))
    placed = spark.createDataFrame(
        rows, "user_id INT, item_id INT, start BIGINT, copies BIGINT, relevant BOOLEAN"
    )
    return placed, spark.createDataFrame(label_rows, "user_id INT, labels BIGINT")


def test_toy_metrics(spark):
    placed, labels = placed_and_labels(spark, TOY)
    at3 = ranking.ranking_metrics(placed, labels, 3).first()
    at10 = ranking.ranking_metrics(placed, labels, 10).first()
    assert at3["map"] == pytest.approx(0.7)
    assert at3["precision_at_k"] == pytest.approx(5 / 12)
    assert at10["precision_at_k"] == pytest.approx(0.15)
    assert at3["ndcg_at_k"] == pytest.approx(0.650664, abs=1e-6)
    assert at10["ndcg_at_k"] == pytest.approx(0.696049, abs=1e-6)
    assert at3["users"] == 4


def test_metrics_equal_both_spark_classes(spark):
    rnd = random.Random(5)
    pairs = []
    for user in range(40):
        pred = rnd.sample(range(60), rnd.randint(1, 30))
        label = [rnd.randrange(60) for _ in range(rnd.randint(1, 12))]
        pairs.append((user, pred, label))
    placed, labels = placed_and_labels(spark, pairs)
    ours = ranking.ranking_metrics(placed, labels, 8).first()
    rdd = RankingMetrics(spark.sparkContext.parallelize([(p, l) for _, p, l in pairs]))
    assert ours["map"] == pytest.approx(rdd.meanAveragePrecision, abs=1e-12)
    assert ours["precision_at_k"] == pytest.approx(rdd.precisionAt(8), abs=1e-12)
    assert ours["ndcg_at_k"] == pytest.approx(rdd.ndcgAt(8), abs=1e-12)
    frame = spark.createDataFrame(
        [([float(x) for x in p], [float(x) for x in l]) for _, p, l in pairs],
        "prediction ARRAY<DOUBLE>, label ARRAY<DOUBLE>",
    )
    found = RankingEvaluator(metricName="ndcgAtK", k=8).evaluate(frame)
    assert ours["ndcg_at_k"] == pytest.approx(found, abs=1e-12)


@pytest.mark.parametrize("copies", [1, 2, 50, 4096, 4097, 20000])
def test_many_copies_equal_a_plain_loop(spark, copies):
    rows = [(1, 5, 0, 3, False), (1, 6, 3, 2, True), (1, 7, 5, copies, True)]
    placed = spark.createDataFrame(
        rows, "user_id INT, item_id INT, start BIGINT, copies BIGINT, relevant BOOLEAN"
    )
    labels = spark.createDataFrame([(1, 4)], "user_id INT, labels BIGINT")
    got = ranking.ranking_metrics(placed, labels, 10).first()
    expected, hits = 0.0, 0
    for place in range(3, 5 + copies):
        hits += 1
        expected += hits / (place + 1)
    assert got["map"] == pytest.approx(expected / 4, rel=1e-12)
    inside = range(3, min(10, 5 + copies))
    assert got["precision_at_k"] == pytest.approx(len(inside) / 10)
    gain = sum(1 / math.log(i + 2) for i in inside)
    assert got["ndcg_at_k"] == pytest.approx(gain / sum(1 / math.log(i + 2) for i in range(4)))


@pytest.fixture(scope="module")
def scored(spark):
    """Ties at many ranks, repeated rows, and one user with most of the rows."""
    small = spark.range(600).select(
        (F.col("id") % 20 + 2).alias("user_id"), (F.col("id") * 7 % 41).alias("item_id"), "id"
    )
    hot = spark.range(900).select(
        F.lit(1).cast("bigint").alias("user_id"), (F.col("id") * 11 % 83).alias("item_id"), (F.col("id") + 600).alias("id")
    )
    return small.unionByName(hot).select(
        "*",
        ((F.col("item_id") * 13 + F.col("user_id")) % 17).alias("prediction"),
        (F.col("id") % 5 + 1).alias("rating"),
    )


def test_top_k_ties(spark):
    df = spark.createDataFrame(
        [(1, 1, 9), (1, 2, 8), (1, 3, 8), (1, 4, 7)], "user_id INT, item_id INT, prediction INT"
    )
    assert bag(ranking.top_k_per_user(df, 2).select("item_id", "rank")) == [(1, 1), (2, 2), (3, 2)]
    exact = ranking.top_k_per_user(df, 2, "row_number")
    assert bag(exact.select("item_id", "rank")) == [(1, 1), (2, 2)]


def test_top_k_of_a_heavy_user_is_the_same(scored):
    for k in (1, 5, 40):
        plain = ranking.top_k_per_user(scored, k)
        heavy = ranking.top_k_per_user(scored, k, skew=SkewConfig(rows_per_task=100))
        assert plain.dtypes == heavy.dtypes
        assert bag(heavy.select(*plain.columns)) == bag(plain)


def lists_by_loop(rows, k, ties):
    users = {}
    for r in rows:
        users.setdefault(r["user_id"], []).append((-r["prediction"], r["item_id"]))
    result = {}
    for user, entries in users.items():
        entries.sort()
        if ties == "row_number":
            kept = entries[:k]
        else:
            kept = [e for e in entries if sum(o[0] < e[0] for o in entries) < k]
        result[user] = [item for _, item in kept]
    return result


@pytest.mark.parametrize("ties", ["rank", "row_number"])
def test_ordered_predictions_equal_a_plain_sort(scored, ties):
    expected = lists_by_loop(scored.collect(), 25, ties)
    whole = ranking.ordered_predictions(scored, 100_000, 25, ties)
    assert {r["user_id"]: r["item_ids"] for r in whole.collect()} == expected
    parts = ranking.ordered_predictions(scored, 7, 25, ties).collect()
    joined = {}
    for r in sorted(parts, key=lambda r: (r["user_id"], r["part"])):
        assert 1 <= len(r["item_ids"]) <= 7
        joined.setdefault(r["user_id"], []).extend(r["item_ids"])
    assert joined == expected


def test_ranking_pairs_drop_users_without_labels_and_pad_parts(spark, scored):
    pred = ranking.ordered_predictions(scored, 2, 3, "row_number")
    labels = ranking.relevant_items(scored.where("rating >= 3 AND user_id < 5"), 2)
    pairs = ranking.ranking_pairs(pred, labels).collect()
    # Users 2 and 3 have low ratings only, all others are left out of the labels.
    assert {r["user_id"] for r in pairs} == {1, 4}
    got = [i for r in sorted(pairs, key=lambda r: r["part"]) if r["user_id"] == 1 for i in r["relevant"]]
    rows = scored.where("rating >= 3 AND user_id = 1").collect()
    assert got == sorted(r["item_id"] for r in rows)
    assert any(r["predicted"] == [] for r in pairs)


@pytest.mark.parametrize("ties,dedup", [("rank", False), ("row_number", False), ("rank", True)])
def test_evaluate_scores_equals_lists_and_rdd_metrics(spark, scored, ties, dedup):
    got = evaluate_scores(scored, EvalConfig(k=12, ties=ties, dedup=dedup)).first()
    rows = scored.collect()
    base = scored.select("user_id", "item_id", "prediction").distinct().collect() if dedup else rows
    lists = lists_by_loop(base, 12, ties)
    labels = {}
    for r in rows:
        if r["rating"] >= 3:
            labels.setdefault(r["user_id"], []).append(r["item_id"])
    pairs = [(lists[u], l) for u, l in labels.items() if u in lists]
    metrics = RankingMetrics(spark.sparkContext.parallelize(pairs))
    assert got["users"] == len(pairs)
    assert got["map"] == pytest.approx(metrics.meanAveragePrecision, abs=1e-12)
    assert got["precision_at_k"] == pytest.approx(metrics.precisionAt(12), abs=1e-12)
    assert got["ndcg_at_k"] == pytest.approx(metrics.ndcgAt(12), abs=1e-12)


@pytest.mark.parametrize("dedup", [False, True])
def test_points_in_one_pass_equal_points_one_by_one(scored, dedup):
    cfg = EvalConfig(k=12, dedup=dedup)
    names = ["prediction", "second", "third"]
    # The second differs between rows of one pair, the third is the same for all rows of a user.
    rows = scored.withColumns({"second": (F.col("item_id") * 5 + F.col("rating")) % 11, "third": F.lit(1)})
    found = {r["point"]: r for r in evaluate_points(rows, names, cfg).collect()}
    assert sorted(found) == [0, 1, 2]
    for i, name in enumerate(names):
        alone = rows.withColumn("prediction", F.col(name)).select("user_id", "item_id", "prediction", "rating")
        wanted = evaluate_scores(alone, cfg, SkewConfig()).first()
        assert [found[i][c] for c in wanted.asDict()] == pytest.approx(list(wanted), abs=1e-12)
    assert evaluate_points(rows.limit(0), names, cfg).count() == 0


def test_recommendation_filters(spark):
    recs = spark.createDataFrame(
        [(1, [(10, 0.9), (11, 0.8), (12, 0.7)])],
        "user_id BIGINT, recommendations ARRAY<STRUCT<item_id: BIGINT, rating: DOUBLE>>",
    )
    rows = ranking.rec_rows(recs)
    assert ranking.rec_items(recs).first()["item_ids"] == [10, 11, 12]
    seen = spark.createDataFrame([(1, 11), (1, 11), (2, 10)], "user_id BIGINT, item_id BIGINT")
    assert bag(ranking.exclude_seen(rows, seen)) == [(1, 10, 0.9), (1, 12, 0.7)]
    assert bag(ranking.only_test(rows, seen)) == [(1, 11, 0.8, 2)]
    assert bag(ranking.only_test(rows, seen, dedup=True)) == [(1, 11, 0.8, 1)]


def test_best_point_takes_the_earliest_of_equals(spark):
    metrics = spark.createDataFrame(
        [(0, 0.2), (1, 0.5), (2, 0.5), (3, None)], "point INT, map DOUBLE"
    )
    assert tuple(ranking.best_point(metrics).first()) == (1, 0.5)


def test_places_are_the_lists_with_one_row_each(spark):
    scored = spark.createDataFrame(
        [(1, 5, 2.0), (1, 5, 2.0), (1, 4, 2.0), (1, 9, 3.0), (2, 1, 0.5)], "user_id INT, item_id INT, prediction DOUBLE"
    )
    cands = copies(scored, ["user_id", "item_id", "prediction"])
    found = ranking.ordered_places(ranking.place_candidates(cands)).collect()
    assert sorted(map(tuple, found)) == [(1, 0, 9), (1, 1, 4), (1, 2, 5), (1, 3, 5), (2, 0, 1)]
    many = spark.createDataFrame([(1, 7, 0, 25_003)], "user_id INT, item_id INT, start BIGINT, copies BIGINT")
    places = sorted(r["place"] for r in ranking.ordered_places(many).collect())
    assert places == list(range(25_003))


def test_lists_are_dealt_by_the_number_of_rows(spark, scored, monkeypatch):
    """Partitions of the lists hold a bounded number of rows, however few partitions a shuffle has."""
    from tastegrid.plans import evaluate as plans

    names = ["prediction", "second"]
    rows = scored.withColumn("second", F.col("item_id") % 5)
    wanted = sorted(map(tuple, evaluate_points(rows, names, EvalConfig(k=5)).collect()))
    monkeypatch.setattr(plans, "ROWS_SORTED", 4)
    placed = plans._points_placed(rows, names, EvalConfig(k=5))
    known = rows.where("user_id IS NOT NULL").count()
    text = placed._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in text.splitlines() if "REPARTITION_BY_NUM" in line]
    number = max(4, -(-2 * known // 4))
    assert number > 4 and any(f", {number})" in line for line in dealt), text
    found = sorted(map(tuple, evaluate_points(rows, names, EvalConfig(k=5)).collect()))
    assert [x for row in found for x in row] == pytest.approx([x for row in wanted for x in row], abs=1e-12)
