import os
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.recommendation import ALS
from pyspark.mllib.evaluation import RankingMetrics
from pyspark.sql import functions as F

from tastegrid.config import AlsConfig, EvalConfig, GridConfig, SkewConfig
from tastegrid.operators import als, als_blocks, ranking
from tastegrid.operators.interactions import rated_pairs
from tastegrid.operators import scoring
from tastegrid.operators.scoring import _reader, _scorer, top_items
from tastegrid.plans.evaluate import evaluate
from tastegrid.plans import grid as grid_plan
from tastegrid.plans.grid import grid_search
from tastegrid.plans.split import split_interactions
from tastegrid.queries import views
from tastegrid.sources.files import load_model, save_model
from tastegrid.sources.workspace import shared_folder

FOLDER = "/root/testdata/sf0.001"
FIT = AlsConfig(rank=4, max_iter=3)


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("split") / "labeled")
    train, val, test = split_interactions(views.interactions(spark, FOLDER), views.SPLIT, path)
    return train.persist(), val.persist(), test.persist()


@pytest.fixture(scope="module")
def model(parts):
    return als.fit_als(parts[0], FIT)


@pytest.mark.parametrize("k", [1, 7, 100])
@pytest.mark.parametrize("per_block", [16, 10_000])
@pytest.mark.parametrize("stored", [True, False])
def test_top_items_equals_a_full_sort(spark, k, per_block, stored):
    rng = np.random.default_rng(3)
    users = rng.integers(-3, 4, (70, 3)).astype(float)
    items = rng.integers(-3, 4, (50, 3)).astype(float)

    def frame(matrix, shift):
        rows = [(i + shift, [float(x) for x in row]) for i, row in enumerate(matrix)]
        return spark.createDataFrame(rows, "id INT, features ARRAY<FLOAT>").repartition(5)

    got = top_items(frame(users, 1000), frame(items, 0), k, users_per_block=per_block, stored=stored)
    scores = users @ items.T
    for row in got.collect():
        line = scores[row["user_id"] - 1000]
        order = sorted(range(50), key=lambda i: (-line[i], i))[:k]
        assert [r["item_id"] for r in row["recommendations"]] == order
        assert [r["rating"] for r in row["recommendations"]] == [line[i] for i in order]
    assert got.count() == 70


def test_top_items_of_nothing(spark):
    one = spark.createDataFrame([(1, [1.0])], "id INT, features ARRAY<FLOAT>")
    none = one.where(F.lit(False))
    assert top_items(none, one, 5).count() == 0
    assert top_items(one, none, 5).select(F.flatten(F.collect_list("recommendations"))).first()[0] == []


def test_items_are_not_shuffled(spark):
    """Users go through one shuffle; the items are no part of the plan."""
    frame = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(300)], "id INT, features ARRAY<FLOAT>")
    text = top_items(frame, frame, 5, users_per_block=10, stored=True)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "Union" not in text
    text = top_items(frame, frame, 5, users_per_block=10)._jdf.queryExecution().executedPlan().toString()
    assert "Union" in text


@pytest.mark.parametrize("whole", [True, False])
def test_a_visit_ends_where_no_item_can_enter(whole):
    """Steps are skipped, and what is found equals the full product, ties included."""
    rng = np.random.default_rng(5)
    users, items = rng.normal(size=(200, 4)), rng.normal(size=(4000, 4)) * rng.pareto(1.0, (4000, 1))
    if whole:
        # Whole numbers give many equal scores; repeated items tie at the k-th place.
        users, items = np.rint(users * 2), np.rint(items * 2)
        items[2000:] = items[:2000]
    lengths = np.linalg.norm(items, axis=1)
    order = np.argsort(-lengths, kind="stable")
    block, opened, k, size = scoring._Block([np.arange(200)], [users], 10), [], 10, 100

    def steps():
        for at in range(0, len(order), size):
            rows = order[at : at + size]
            opened.append(len(block.open(lengths[rows[0]])))
            yield rows, items[rows], lengths[rows[0]]

    taken = scoring._visit(block, steps())
    assert 0 < taken < 40 and opened == sorted(opened, reverse=True)
    scores = users @ items.T
    for u in range(200):
        best = sorted(range(len(items)), key=lambda i: (-scores[u, i], i))[:k]
        mine = sorted(zip(-block.scores[u], block.items[u]))
        if whole:
            assert [i for _, i in mine] == best
        assert [-s for s, _ in mine] == pytest.approx(scores[u, best], abs=1e-9)


def test_only_items_that_enter_are_ranked(monkeypatch):
    """Once the lists are full, a step ranks the few items that reach them, not all of its items."""
    rng = np.random.default_rng(9)
    users, items = rng.normal(size=(50, 4)), rng.normal(size=(6000, 4))
    block, widths, best = scoring._Block([np.arange(50)], [users], 20), [], scoring._best

    def counted(scores, ids, k):
        widths.append(scores.shape[1])
        return best(scores, ids, k)

    monkeypatch.setattr(scoring, "_best", counted)
    for at in range(0, 6000, 1000):
        block.add(np.arange(at, at + 1000), items[at : at + 1000])
    assert widths[0] == 1000 and max(widths[1:]) < 200
    scores = users @ items.T
    for u in range(50):
        wanted = sorted(range(6000), key=lambda i: (-scores[u, i], i))[:20]
        assert sorted(block.items[u].tolist()) == sorted(wanted)


def test_single_precision_loses_no_pair_and_lists_are_ranked_seldom(monkeypatch):
    """Scores that agree in single precision are told apart, and few steps rank the lists again."""
    rng = np.random.default_rng(12)
    users, items = rng.normal(size=(40, 6)), rng.normal(size=(50, 6)).repeat(160, axis=0)
    items *= 1 + rng.permutation(len(items))[:, None] * 1e-11
    order, calls, best = rng.permutation(len(items)), [], scoring._best
    monkeypatch.setattr(scoring, "_best", lambda *a: calls.append(1) or best(*a))
    block = scoring._Block([np.arange(40)], [users], 100)
    for at in range(0, len(items), 200):
        block.add(order[at : at + 200], items[order[at : at + 200]])
    # Vectors that single precision cannot hold are scored in doubles.
    block.add(np.array([8000, 8001]), np.array([np.full(6, 1e40), np.full(6, -1e40)]))
    every = np.vstack([items, np.full((1, 6), 1e40), np.full((1, 6), -1e40)])
    scores = users @ every.T
    for u in range(40):
        wanted = np.argsort(-scores[u], kind="stable")[:100]
        assert np.sort(-block.scores[u]) == pytest.approx(-scores[u][wanted], rel=1e-14)
        assert len(set(block.items[u].tolist()) & set(wanted.tolist())) >= 97
    assert len(calls) < 30


def test_short_files_are_not_opened(spark, monkeypatch):
    monkeypatch.setattr(scoring, "ITEM_FILE_BYTES", 8 * 100)
    rows = [(i, [float(1000 - i), 0.0]) for i in range(1000)] + [(5000, None)]
    items = spark.createDataFrame(rows, "id INT, features ARRAY<FLOAT>").repartition(4)
    files = scoring.store_items(items, 2, 1000)
    assert len(files.paths) > 10 and list(files.longest) == sorted(files.longest, reverse=True)
    block = scoring._Block([np.array([1, 2])], [np.array([[1.0, 0.0], [0.5, 0.0]])], 20)
    read = [len(ids) for ids, _, _ in scoring._steps(files, block) if block.add(ids, _matrix_of(rows, ids)) is None]
    assert 20 <= sum(read) < 200
    assert sorted(block.items[0].tolist()) == list(range(20))


def _matrix_of(rows, ids):
    known = dict(rows)
    return np.array([known[i] for i in ids])


def test_recommend_agrees_with_the_model(parts, model):
    users = parts[2].select("user_id").distinct()
    ours = {r["user_id"]: r["recommendations"] for r in als.recommend(model, users, 10).collect()}
    theirs = model.recommendForUserSubset(users, 10).collect()
    assert len(ours) == len(theirs) > 0
    for row in theirs:
        mine = ours[row["user_id"]]
        expected = [r["rating"] for r in row["recommendations"]]
        assert [r["rating"] for r in mine] == pytest.approx(expected, abs=1e-5)


def test_predictions_are_dot_products(parts, model):
    u = model.userFactors.select(F.col("id").alias("user_id"), F.col("features").alias("uf"))
    i = model.itemFactors.select(F.col("id").alias("item_id"), F.col("features").alias("if"))
    dot = F.aggregate(
        F.zip_with("uf", "if", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x
    )
    rows = als.predict(model, parts[2]).join(u, "user_id").join(i, "item_id")
    assert rows.where(F.abs(F.col("prediction") - dot) > 1e-5).count() == 0
    assert rows.count() == parts[2].count()


def test_cold_rows_get_no_prediction(spark, model):
    cold = spark.createDataFrame([(-5, 1, 3), (1, -5, 3)], "user_id INT, item_id INT, rating INT")
    assert als.predict(model, cold).count() == 0


def test_saved_model_predicts_the_same(parts, model, tmp_path):
    path = str(tmp_path / "model")
    save_model(model, path)
    keys = ["row_key", "prediction"]
    before = als.predict(model, parts[2]).select(keys).collect()
    after = als.predict(load_model(path), parts[2]).select(keys).collect()
    assert sorted(before) == sorted(after)


@pytest.mark.parametrize("mode", ["test_rows", "all_items", "unseen_items", "recs_in_test"])
def test_evaluate_equals_spark_metrics_over_lists(spark, parts, model, mode):
    train, _, test = parts
    k = 20
    got = evaluate(model, train, rated_pairs(test), EvalConfig(mode=mode, k=k)).first()
    scored = als.predict(model, test)
    evaluator = RegressionEvaluator(metricName="rmse", labelCol="rating", predictionCol="prediction")
    assert got["rmse"] == pytest.approx(evaluator.evaluate(scored), abs=1e-9)
    if mode == "test_rows":
        lists = ranking.ordered_predictions(scored, 100_000, k)
    else:
        rows = ranking.rec_rows(als.recommend(model, test, k))
        if mode == "unseen_items":
            rows = ranking.exclude_seen(rows, train)
        elif mode == "recs_in_test":
            rows = rows.join(test.select("user_id", "item_id"), ["user_id", "item_id"])
        lists = ranking.ordered_predictions(rows.withColumnRenamed("rating", "prediction"), 100_000)
    labels = ranking.relevant_items(test.where("rating >= 3"), 100_000)
    pairs = ranking.ranking_pairs(lists, labels).collect()
    rdd = spark.sparkContext.parallelize([(r["predicted"], r["relevant"]) for r in pairs])
    metrics = RankingMetrics(rdd)
    assert got["users"] == len(pairs) > 0
    assert got["map"] == pytest.approx(metrics.meanAveragePrecision, abs=1e-12)
    assert got["precision_at_k"] == pytest.approx(metrics.precisionAt(k), abs=1e-12)
    assert got["ndcg_at_k"] == pytest.approx(metrics.ndcgAt(k), abs=1e-12)


def test_evaluate_rejects_unknown_modes(parts, model):
    with pytest.raises(ValueError):
        evaluate(model, None, rated_pairs(parts[2]), EvalConfig(mode="other"))


def test_grid_search_keeps_the_best_model(parts):
    train, val, _ = parts
    ev = EvalConfig(mode="all_items", k=10)
    grid = GridConfig(ranks=(3, 4), reg_params=(0.1,), als=FIT)
    result = grid_search(train, val, grid, ev)
    rows = sorted(result.metrics.collect())
    assert [(r["point"], r["rank"], r["reg_param"]) for r in rows] == [(0, 3, 0.1), (1, 4, 0.1)]
    best = max(rows, key=lambda r: (r["map"], -r["point"]))
    assert result.best["point"] == best["point"]
    assert result.model.rank == best["rank"]
    assert tuple(ranking.best_point(result.metrics).first()) == tuple(best)
    together = grid_search(train, val, GridConfig((3, 4), (0.1,), 2, FIT), ev)
    for a, b in zip(rows, sorted(together.metrics.collect())):
        assert tuple(a) == pytest.approx(tuple(b), abs=1e-6)


def test_points_of_one_rank_share_their_blocks(parts, monkeypatch):
    """Ratings are blocked once a rank; the fits equal those that stand alone, and nothing stays."""
    train, val, _ = parts
    made, prepare, stored = [], als.prepare, train.sparkSession.sparkContext._jsc.getPersistentRDDs
    monkeypatch.setattr(als, "prepare", lambda rows, first, rank: made.append(rank) or prepare(rows, first, rank))
    kept, before = als.Ratings(train), set(stored().keySet().toArray())
    shared = [als.fit_als(kept, AlsConfig(rank=3, reg_param=reg, max_iter=2)) for reg in (0.1, 0.5)]
    assert made == [3]
    als.fit_als(kept, AlsConfig(rank=2, max_iter=2))
    kept.forget(but={2})
    assert [key[0] for key in kept._starts] == [2]
    kept.close()
    assert not set(stored().keySet().toArray()) - before
    alone = als.fit_als(train, AlsConfig(rank=3, reg_param=0.5, max_iter=2))
    a, b = (dict(m.itemFactors.rdd.map(tuple).collect()) for m in (shared[1], alone))
    assert a.keys() == b.keys() and all(a[key] == pytest.approx(b[key], abs=1e-6) for key in a)


def test_only_files_with_wanted_ids_are_opened(tmp_path, monkeypatch):
    """A block takes its rows out of the files whose ids it needs."""
    names = [
        als_blocks._write_factors("file://", str(tmp_path), np.arange(at, at + 10, dtype=np.int32), np.full((10, 2), at))
        for at in range(0, 100, 10)
    ]
    found = [tuple(row.values()) for batch in names for row in batch.to_pylist()]
    files, opened, read = als_blocks.FactorFiles("file://", *zip(*found)), [], als_blocks._factors
    monkeypatch.setattr(als_blocks, "_factors", lambda scheme, path: opened.append(path) or read(scheme, path))
    rows = files.rows(np.array([3, 4, 57], dtype=np.int32), 2)
    assert rows.tolist() == [[0, 0], [0, 0], [50, 50], [0, 0]] and len(opened) == 2
    with pytest.raises(ValueError, match="without factors"):
        files.rows(np.array([3, 100], dtype=np.int32), 2)


def test_grid_search_releases_what_lost(spark, parts):
    """Afterwards only the factors of the best model are stored."""
    train, val, _ = parts
    stored = spark.sparkContext._jsc.getPersistentRDDs
    before = set(stored().keySet().toArray())
    grid = GridConfig(ranks=(2, 3), reg_params=(0.1, 0.5), als=FIT)
    result = grid_search(train, val, grid, EvalConfig(mode="all_items", k=10))
    assert result.metrics.count() == 4
    # Its user and item factors, and the first item factors, which the fit itself leaves.
    assert len(set(stored().keySet().toArray()) - before) <= 3
    assert result.model.itemFactors.count() > 0
    als.release(result.model)
    assert not set(stored().keySet().toArray()) - before


def test_a_stopped_grid_goes_on(parts, tmp_path, monkeypatch):
    """Two points are done when the search stops; the next one fits only the others."""
    train, val, _ = parts
    ev = EvalConfig(mode="test_rows", k=10)
    config = GridConfig(ranks=(2, 3), reg_params=(0.1, 0.5), als=AlsConfig(max_iter=2))
    journal, fits = str(tmp_path / "journal"), []
    fit = grid_plan.fit_als

    def counted(rows, cfg):
        if len(fits) == 2:
            raise RuntimeError("stopped")
        fits.append((cfg.rank, cfg.reg_param))
        return fit(rows, cfg)

    monkeypatch.setattr(grid_plan, "fit_als", counted)
    with pytest.raises(RuntimeError, match="stopped"):
        grid_search(train, val, config, ev, journal)
    assert [r["point"] for r in sorted(grid_plan.finished_points(train.sparkSession, journal))] == [0, 1]
    fits.clear()
    result = grid_search(train, val, config, ev, journal)
    assert fits == [(3, 0.1), (3, 0.5)]
    monkeypatch.undo()
    whole = grid_search(train, val, config, ev)
    for a, b in zip(result.metrics.collect(), whole.metrics.collect()):
        assert tuple(a) == pytest.approx(tuple(b), abs=1e-6)
    assert result.best["point"] == whole.best["point"] and result.model.rank == whole.model.rank
    # With all points done nothing is fitted, and the best model is there.
    monkeypatch.setattr(grid_plan, "fit_als", None)
    again = grid_search(train, val, config, ev, journal)
    assert again.best["point"] == whole.best["point"] and again.model.itemFactors.count() > 0
    with pytest.raises(ValueError, match="another grid"):
        grid_search(train, val, GridConfig((7, 3), (0.1, 0.5)), ev, journal)


def test_default_grid_has_fifty_points_ranks_outside():
    points = GridConfig().points()
    assert len(points) == 50
    assert points[:2] == [(10, 0.001), (10, 0.002)]
    assert points[-1] == (160, 1.0)


def test_scoring_tasks_do_not_need_the_package(tmp_path):
    (tmp_path / "task").write_bytes(cloudpickle.dumps(_scorer(3, pa.float64())))
    files = scoring.ItemFiles("file://", (), ())
    (tmp_path / "reader").write_bytes(cloudpickle.dumps(_reader(3, pa.float64(), files)))
    code = "import pickle, sys; f = pickle.load(open('task', 'rb')); assert list(f(iter([]))) == []"
    code += "; f = pickle.load(open('reader', 'rb')); assert list(f(iter([]))) == []"
    code += "; assert 'tastegrid' not in sys.modules"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)


@pytest.mark.parametrize("rows_per_task", [50, 1_000_000])
def test_predictions_equal_the_model_also_for_hot_items(spark, model, rows_per_task):
    """One item owns half the rows, one user a fifth; some rows have no user, item or factors."""
    users = [r[0] for r in model.userFactors.select("id").orderBy("id").limit(40).collect()]
    items = [r[0] for r in model.itemFactors.select("id").orderBy("id").limit(40).collect()]
    rows = [
        (users[0] if n % 5 == 0 else users[n % 40], items[0] if n % 2 == 0 else items[n % 39], float(n % 5), n)
        for n in range(600)
    ]
    odd = [(None, items[0], 1.0, 600), (users[0], None, 1.0, 601), (-7, items[0], 1.0, 602), (users[0], -7, 1.0, 603), (None, None, None, 604)]
    table = spark.createDataFrame(rows + odd + rows[:5], "user_id BIGINT, item_id BIGINT, rating DOUBLE, n INT")
    skew = SkewConfig(rows_per_task=rows_per_task)
    found = als.predict(model, table, skew)
    assert found.columns == [*table.columns, "prediction"] and found.schema["prediction"].dataType.simpleString() == "float"
    assert als.predict(model, table.limit(0), skew).count() == 0

    def rmse(df):
        return RegressionEvaluator(labelCol="rating").evaluate(df)

    theirs = model.transform(table.dropna(subset=["user_id", "item_id"]))
    assert rmse(found) == pytest.approx(rmse(theirs), abs=1e-6)
    mine, other = (df.orderBy("n", "prediction").select("n", "prediction").collect() for df in (found, theirs))
    assert [r["n"] for r in mine] == [r["n"] for r in other] and len(mine) == 605
    assert [r["prediction"] for r in mine] == pytest.approx([r["prediction"] for r in other], abs=1e-5)


@pytest.mark.parametrize(("rank", "reg"), [(3, 0.1), (60, 0.001)])
def test_a_fit_equals_spark_ml(spark, parts, rank, reg, monkeypatch):
    """With fewer and with more factors than ratings, and blocks that hold few ratings each."""
    monkeypatch.setattr(als_blocks, "BLOCK_VALUES", 300 * rank)
    train = parts[0].select("user_id", "item_id", "rating").union(parts[0].select("user_id", "item_id", F.lit(1)).limit(50))
    ours = als.fit_als(train, AlsConfig(rank=rank, reg_param=reg, max_iter=4))
    theirs = ALS(
        userCol="user_id", itemCol="item_id", ratingCol="rating", rank=rank, regParam=reg, maxIter=4, seed=1, numUserBlocks=10, numItemBlocks=10
    ).fit(train)
    assert ours.rank == rank
    for mine, other in ((ours.userFactors, theirs.userFactors), (ours.itemFactors, theirs.itemFactors)):
        assert mine.dtypes == other.dtypes
        a, b = (dict(df.rdd.map(tuple).collect()) for df in (mine, other))
        assert a.keys() == b.keys() and len(a) > 100
        for key in a:
            assert a[key] == pytest.approx(b[key], abs=1e-3)


def test_half_iterations_shuffle_no_factors(spark, parts, monkeypatch):
    """Ratings are dealt once by each side; each half iteration is a map over stored blocks."""
    plans, store = [], als_blocks._store

    def seen(df, label):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return store(df, label)

    monkeypatch.setattr(als_blocks, "_store", seen)
    als.fit_als(parts[0], AlsConfig(rank=2, max_iter=3))
    assert len(plans) == 7
    for text in plans[1:]:
        outside = text.split("InMemoryRelation")[0]
        assert "Exchange" not in outside and "Repartition" not in outside and "Join" not in outside


@pytest.mark.parametrize("counts", [[1, 2, 3, 9, 9, 40], [5], [700, 1, 700]])
@pytest.mark.parametrize("rank", [4, 20])
def test_solve_equals_the_equations(counts, rank, monkeypatch):
    """Short, long and very long ids, which are solved in three ways."""
    monkeypatch.setattr(als_blocks, "STEP_VALUES", 2_000)
    rng, counts = np.random.default_rng(2), np.array(counts)
    near = np.vstack([rng.normal(size=(50, rank)), np.zeros((1, rank))]).astype(np.float32)
    at, values = rng.integers(0, 50, counts.sum()).astype(np.int32), rng.integers(1, 6, counts.sum()).astype(np.float32)
    found = als_blocks.solve(counts, at, values, near, 0.05)
    ends = np.cumsum(counts)
    for row, n, end in zip(found, counts, ends):
        x, r = near[at[end - n : end]].astype(float), values[end - n : end]
        assert row == pytest.approx(np.linalg.solve(x.T @ x + 0.05 * n * np.eye(rank), x.T @ r), abs=1e-4)


def test_a_fit_without_files_that_python_reads(parts, model, monkeypatch):
    """Then the solver of Spark ML does the whole fit."""
    monkeypatch.setattr(als_blocks, "factor_files", lambda spark, path: None)
    other = als.fit_als(parts[0], FIT)
    a, b = (dict(m.itemFactors.rdd.map(tuple).collect()) for m in (model, other))
    assert a.keys() == b.keys()
    for key in a:
        assert a[key] == pytest.approx(b[key], abs=1e-3)


@pytest.mark.parametrize("row", [(None, 1, 1.0), (1, None, 1.0), (1, 1 << 40, 1.0), (1, 2, None), (1, 2, float("nan"))])
def test_a_fit_refuses_what_is_no_rating(spark, row):
    rows = spark.createDataFrame([(1, 3, 2.0), (2, 3, 2.0), row], "user_id BIGINT, item_id BIGINT, rating DOUBLE")
    with pytest.raises(Exception, match="must"):
        als.fit_als(rows, AlsConfig(rank=2, max_iter=1))


def test_a_fit_leaves_only_the_factors_of_its_model(spark, parts):
    """Blocks, and the factors of earlier iterations, are gone; release takes the rest."""
    folder, stored = shared_folder(spark).removeprefix("file:"), spark.sparkContext._jsc.getPersistentRDDs
    files, kept = set(os.listdir(folder)), set(stored().keySet().toArray())
    model = als.fit_als(parts[0], AlsConfig(rank=2, max_iter=2))
    new = {n for n in os.listdir(folder) if "-rows-" in n or "-factors-" in n} - files
    assert sorted(n.split("-rows-")[0] for n in new) == ["item", "user"]
    als.release(model)
    assert not set(os.listdir(folder)) & new
    assert not set(stored().keySet().toArray()) - kept


def test_solving_tasks_do_not_need_the_package(tmp_path):
    job = als_blocks._solve_job(als_blocks.FactorFiles("file://", ()), 3, 0.1)
    (tmp_path / "task").write_bytes(cloudpickle.dumps(job))
    code = "import pickle, sys; f = pickle.load(open('task', 'rb')); assert list(f(iter([]))) == []"
    code += "; assert 'tastegrid' not in sys.modules"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
