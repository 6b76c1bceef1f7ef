"""All registered queries: against SQL, and the shape of their plans."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tastegrid.config import GridConfig
from tastegrid.operators.interactions import active_users_sql
from tastegrid.operators.ranking import top_k_per_user
from tastegrid.plans.grid import GridResult
from tastegrid.plans.split import ordinals, user_plan
from tastegrid.queries import registry, views
from tastegrid.queries.oracles import ORACLES
from tastegrid.queries.registry import QUERIES
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
MODELS = {
    "factor_projection",
    "als_item_factors",
    "als_predict",
    "als_recommend",
    "als_reload_predict",
    "eval_all_items",
    "eval_unseen_items",
    "eval_recs_in_test",
    "als_grid_metrics",
}


@pytest.fixture(scope="module")
def database():
    return connect(FOLDER)


def test_every_query_but_the_models_has_sql():
    assert set(QUERIES) - set(ORACLES) == MODELS
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())
    assert not set(oracle_sql()) - set(queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, database, name):
    assert difference(queries()[name](spark, FOLDER), database.sql(oracle_sql()[name])) is None


@pytest.mark.parametrize("name", sorted(MODELS))
def test_model_query_gives_rows(spark, name):
    assert queries()[name](spark, FOLDER).count() > 0


def test_the_grid_of_the_metrics_is_whole(spark, monkeypatch):
    """All fifty points of the default settings, at their rank and iterations."""
    grids = []

    def noted(train, test, grid, ev):
        grids.append((grid, ev))
        return GridResult(spark.range(1), None, None)

    monkeypatch.setattr(registry, "grid_search", noted)
    queries()["als_grid_metrics"](spark, FOLDER)
    (grid, ev), = grids
    assert grid == GridConfig() and len(grid.points()) == 50 and ev.k == 500


def test_entry_gives_the_known_metrics(spark):
    assert entry(spark).first()["users"] == 150
    row = queries()["eval_test_rows"](spark, "/root/testdata/sf0.01").first()
    assert (row["map"], row["precision_at_k"], row["ndcg_at_k"], row["users"]) == (
        0.210766,
        0.598999,
        0.603391,
        1499,
    )


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


CHEAP = [
    "active_users_df", "active_users_sql", "eval_test_rows", "grid_best_point", "ordered_recs",
    "plot_points", "ranking_pairs", "recs_only_test", "resample_to_min", "split_test",
    "top_category_mapped", "top_k_rank", "eval_unseen_items_fixed",
]


@pytest.mark.parametrize("name", CHEAP)
def test_no_cross_join_and_no_row_udf(spark, name):
    text = plan(queries()[name](spark, FOLDER))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert node not in text


def test_split_shuffles_the_rows_once(spark, tmp_path):
    views.interactions(spark, FOLDER).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    text = plan(ordinals(rows, user_plan(rows, views.SPLIT), views.SPLIT))
    # The rows, and the user plan where it is not broadcast.
    assert 1 <= text.count("Exchange hashpartitioning(user_id") <= 2
    assert text.count("FileScan") == 1


def test_top_k_is_cut_before_the_shuffle(spark):
    text = plan(top_k_per_user(views.scored(spark, FOLDER), 10))
    assert text.count("WindowGroupLimit") == 2


def test_sql_leaves_no_views(spark):
    spark.range(3).createOrReplaceTempView("interactions")
    active_users_sql(spark, views.interactions(spark, FOLDER), 10).count()
    assert [t.name for t in spark.catalog.listTables() if t.isTemporary] == ["interactions"]
    assert spark.table("interactions").count() == 3
    spark.catalog.dropTempView("interactions")


SCANS = {
    "active_users_df": 1,
    "split_test": 1,
    "split_val": 1,
    "top_category_mapped": 0,
    "resample_pct": 2,
    "ranking_pairs": 1,
    "ranking_pairs_in_parts": 0,
    "recs_only_test": 0,
    "eval_test_rows": 1,
    "metric_map": 1,
    "grid_best_point": 1,
}


@pytest.mark.parametrize("name", sorted(SCANS))
def test_scans_of_the_large_table(spark, name):
    """How often the returned plan reads the lines; stored steps before it read them once."""
    text = plan(queries()[name](spark, FOLDER))
    assert text.count("lineitem.parquet") <= SCANS[name]


def test_pairs_of_stored_rows_take_one_scan_and_one_shuffle(spark):
    text = plan(queries()["ranking_pairs_in_parts"](spark, FOLDER))
    assert text.count("FileScan") == 1 and "Bucketed: true" in text
    assert text.count("Exchange") == 1


@pytest.mark.parametrize("mode", ["all_items", "unseen_items", "recs_in_test"])
def test_evaluation_by_user_shuffles_only_the_lists(spark, mode):
    """One exchange deals the lists of users; the stored pairs are read where they lie."""
    text = plan(queries()[f"eval_{mode}_by_user"](spark, FOLDER))
    dealt = [line for line in text.splitlines() if "Exchange" in line]
    by_user = [line for line in dealt if "hashpartitioning(user_id" in line]
    assert len(by_user) == 1 and "REPARTITION_BY_NUM" in by_user[0]
    assert not any("item_id" in line for line in dealt)
    assert text.count("Bucketed: true") >= 2
    other = plan(queries()[f"eval_{mode}_fixed"](spark, FOLDER))
    assert sum("hashpartitioning" in line for line in other.splitlines()) > 1


def test_active_users_sql_is_a_semi_join(spark):
    assert "LeftSemi" in plan(active_users_sql(spark, views.interactions(spark, FOLDER), 10))
