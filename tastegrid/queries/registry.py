"""Every registered query: ``name -> callable(spark, folder)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastegrid.config import TOP_K, AlsConfig, EvalConfig, GridConfig, SkewConfig, ViewConfig
from tastegrid.functions.shapes import array_width
from tastegrid.operators import als, categories, factors, interactions, ranking, sampling
from tastegrid.operators.skew import copies, heavy_keys
from tastegrid.plans import jobs, split
from tastegrid.plans.evaluate import (
    candidates_by_user,
    candidates_from_recs,
    evaluate,
    evaluate_points,
    evaluate_scores,
    user_facts,
)
from tastegrid.plans.grid import grid_search
from tastegrid.queries import views
from tastegrid.sources import files
from tastegrid.sources.by_user import UserTables
from tastegrid.sources.workspace import cut, fresh_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SKEW = SkewConfig()
# Makes some users heavy, so that their rows take several tasks.
FEW_ROWS = SkewConfig(rows_per_task=20, max_keys=20)
ROUND = 6


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def as_text(df: DataFrame, *arrays: str) -> DataFrame:
    """Id arrays as comma-separated text, a form that every engine compares alike."""
    texts = {a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",") for a in arrays}
    return df.withColumns(texts)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, ROUND) for c in columns})


def as_double(df: DataFrame) -> DataFrame:
    """Float columns as doubles."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, T.FloatType)]
    return df.withColumns({c: F.col(c).cast("double") for c in floats})


# --- scans and files ---------------------------------------------------------------


@query
def scan_interactions(spark, folder):
    return views.interactions(spark, folder)


@query
def json_counts_roundtrip(spark, folder):
    path = fresh_path(spark, "counts-json")
    views.nested_counts(spark, folder).write.json(path)
    schema = files.counts_schema(views.SEGMENTS, T.LongType())
    return categories.expand_counts(files.read_counts_json(spark, path, schema))[0]


@query
def csv_id_map_roundtrip(spark, folder):
    path = fresh_path(spark, "id-map-csv")
    files.write_csv(views.item_map(spark, folder), path, header=True)
    return files.read_id_map(spark, path)


@query
def wide_factors_roundtrip(spark, folder):
    path = fresh_path(spark, "wide-csv")
    files.write_wide_csv(_wide(spark, folder), path)
    return as_double(files.read_wide_factors(spark, path))


# --- interactions --------------------------------------------------------------------


@query
def user_counts(spark, folder):
    return interactions.user_counts(views.interactions(spark, folder), 10)


@query
def active_users_sql(spark, folder):
    return interactions.active_users_sql(spark, views.interactions(spark, folder), 10)


@query
def active_users_df(spark, folder):
    return interactions.active_users(views.interactions(spark, folder), 10)


@query
def distinct_items(spark, folder):
    return interactions.distinct_items(views.interactions(spark, folder))


@query
def relevant_items(spark, folder):
    rows = interactions.relevant(views.interactions(spark, folder))
    return as_text(ranking.relevant_items(rows, views.LIST_LIMIT), "item_ids")


# --- split -----------------------------------------------------------------------------


def _active(spark, folder):
    return interactions.user_counts(views.interactions(spark, folder), 10)


@query
def sample_users(spark, folder):
    return split.sample_users(_active(spark, folder), 25, 1)


@query
def split_users(spark, folder):
    return split.split_users(_active(spark, folder), (0.6, 0.2, 0.2), 1)


@query
def split_train_users(spark, folder):
    rows = views.interactions(spark, folder)
    users = split.split_users(_active(spark, folder), (0.6, 0.2, 0.2), 1).where("part = 'train'")
    return interactions.restrict_users(rows, users, heavy_keys(rows, ["user_id"], SKEW))


@query
def global_ordinal(spark, folder):
    rows = views.interactions(spark, folder)
    return split.ordinals(rows, split.user_plan(rows, views.SPLIT), views.SPLIT)


@query
def split_halves(spark, folder):
    return split.halves(views.interactions(spark, folder), views.SPLIT)


@query
def merge_train(spark, folder):
    """Train rows put together by a union of the labeled pieces."""
    rows = views.interactions(spark, folder)
    placed = split.ordinals(rows, split.user_plan(rows, views.SPLIT), views.SPLIT)
    even = placed.where("ordinal % 2 = 0")
    pieces = [
        placed.where("part = 'train'"),
        even.where("part = 'val'"),
        even.where("part = 'test'"),
    ]
    return split.merge_train(*[p.select(rows.columns) for p in pieces])


@query
def warm_items(spark, folder):
    rows = views.interactions(spark, folder)
    labeled = split.store_labeled(rows, views.SPLIT, fresh_path(spark, "labeled"))
    return interactions.warm_items(
        labeled.where("part <> 'train'"),
        labeled.where("part = 'train'"),
        heavy_keys(rows, ["item_id"], SKEW),
    )


def _split(spark, folder, store=False):
    path = fresh_path(spark, "labeled") if store else None
    return split.split_interactions(views.interactions(spark, folder), views.SPLIT, path)


@query
def split_train(spark, folder):
    return _split(spark, folder)[0]


@query
def split_val(spark, folder):
    return _split(spark, folder, store=True)[1]


@query
def split_test(spark, folder):
    return _split(spark, folder, store=True)[2]


# --- categories and factors ------------------------------------------------------------


@query
def expand_counts(spark, folder):
    return categories.expand_counts(views.nested_counts(spark, folder))[0]


def _top(spark, folder):
    flat, names = categories.expand_counts(views.nested_counts(spark, folder))
    return categories.top_category(flat, names)


@query
def top_category(spark, folder):
    return _top(spark, folder)


@query
def top_category_from_map(spark, folder):
    """From JSON lines whose categories no schema names."""
    path = fresh_path(spark, "counts-json")
    views.nested_counts(spark, folder).write.json(path)
    return categories.top_category_of_map(files.read_counts_map(spark, path, "BIGINT"))


@query
def category_map(spark, folder):
    """The map after a round trip through a file without header."""
    path = fresh_path(spark, "category-map-csv")
    cmap = categories.category_map(_top(spark, folder))
    files.write_csv(cmap.select("category_id", "top_category"), path, header=False)
    return files.read_category_map(spark, path)


def _with_ids(spark, folder):
    top = cut(_top(spark, folder))
    return categories.attach_category_id(top, categories.category_map(top))


@query
def top_category_ids(spark, folder):
    return _with_ids(spark, folder)


@query
def top_category_mapped(spark, folder):
    return categories.remap_ids(_with_ids(spark, folder), views.item_map(spark, folder))


@query
def factors_category(spark, folder):
    joined = factors.factors_by_category(
        views.factors(spark, folder).drop("category_id"), _with_ids(spark, folder)
    )
    return as_double(factors.wide_factors(joined.select("item_id", "category_id", "features")))


@query
def factors_category_name(spark, folder):
    top = _top(spark, folder)
    cmap = cut(categories.category_map(top).withColumnRenamed("top_category", "category"))
    rows = views.factors(spark, folder).select(F.col("id").alias("item_id"), "category_id")
    return factors.with_category_name(rows, cmap)


@query
def factor_width(spark, folder):
    return array_width(views.factors(spark, folder), "features")


def _wide(spark, folder):
    return factors.wide_factors(views.factors(spark, folder).withColumnRenamed("id", "item_id"))


@query
def widen_factors(spark, folder):
    return as_double(_wide(spark, folder))


@query
def factor_moments(spark, folder):
    """Means and covariances of all factors, which the projection is made of."""
    wide = _wide(spark, folder)
    found = factors.factor_moments(wide, [c for c in wide.columns if c.startswith("x")])
    # Adding zero makes one zero of two.
    return rounded(found, "mean", "covariance").withColumns(
        {c: F.col(c) + F.lit(0.0) for c in ("mean", "covariance")}
    )


@query
def factor_projection(spark, folder):
    wide = _wide(spark, folder)
    return factors.project_2d(wide, [c for c in wide.columns if c.startswith("x")])


# --- resampling and view ---------------------------------------------------------------


@query
def min_class_count(spark, folder):
    return sampling.smallest_class(views.factors(spark, folder), "category_id")


@query
def resample_pct(spark, folder):
    return sampling.resample_percent(views.interactions(spark, folder), 30, 1, ["row_key"])


@query
def resample_to_min(spark, folder):
    return sampling.resample_to_smallest(
        views.interactions(spark, folder), "rating", 1, ["row_key"]
    )


@query
def plot_points(spark, folder):
    shown = sampling.plot_points(
        views.points(spark, folder), ["item_id"], ViewConfig(plot_percent=80)
    )
    return rounded(shown, "x", "y")


# --- ranking -----------------------------------------------------------------------------


@query
def top_k_rank(spark, folder):
    return ranking.top_k_per_user(views.scored(spark, folder), 10)


@query
def top_k_row_number(spark, folder):
    return ranking.top_k_per_user(
        views.scored(spark, folder), 10, "row_number", ("item_id", "row_key")
    )


def _predicted_lists(spark, folder):
    return ranking.ordered_predictions(views.scored(spark, folder), views.LIST_LIMIT, 10)


@query
def ordered_predictions(spark, folder):
    return as_text(_predicted_lists(spark, folder), "item_ids")


@query
def ordered_places(spark, folder):
    """The lists of all predictions, one row per place."""
    cands = copies(views.scored(spark, folder), ["user_id", "item_id", "prediction"])
    return ranking.ordered_places(ranking.place_candidates(cands))


@query
def ordered_places_in_ranges(spark, folder):
    """The same with the twenty users of most rows in several tasks."""
    cands = copies(views.scored(spark, folder), ["user_id", "item_id", "prediction"])
    heavy = heavy_keys(cands, ["user_id"], FEW_ROWS)
    return ranking.ordered_places(ranking.place_candidates(cands, heavy=heavy))


@query
def ranking_pairs_in_parts(spark, folder):
    """Whole lists cut after five ids, so that many go on in further rows, from rows kept by user."""
    rows = UserTables(spark).put("scored", views.scored(spark, folder))
    return as_text(ranking.pairs_in_one_pass(rows, 5), "predicted", "relevant")


@query
def ranking_pairs(spark, folder):
    """Both lists in one pass over the rows."""
    pairs = ranking.pairs_in_one_pass(views.scored(spark, folder), views.LIST_LIMIT, 10)
    return as_text(pairs, "predicted", "relevant")


@query
def rmse(spark, folder):
    return rounded(ranking.rmse(views.scored(spark, folder)), "rmse")


METRICS = ("map", "precision_at_k", "ndcg_at_k")


@query
def eval_test_rows(spark, folder):
    return rounded(evaluate_scores(views.scored(spark, folder), views.TOP_10), *METRICS)


@query
def eval_test_rows_in_ranges(spark, folder):
    """The same with the twenty users of most rows in several tasks."""
    return rounded(evaluate_scores(views.scored(spark, folder), views.TOP_10, FEW_ROWS), *METRICS)


@query
def metric_map(spark, folder):
    found = evaluate_scores(views.scored(spark, folder), EvalConfig(k=500))
    return rounded(found, "map").select("map", "users")


@query
def metric_precision_at_k(spark, folder):
    found = evaluate_scores(views.scored(spark, folder), EvalConfig(k=5, ties="row_number"))
    return rounded(found, "precision_at_k").select("precision_at_k", "users")


@query
def metric_ndcg_at_k(spark, folder):
    found = evaluate_scores(views.scored(spark, folder), EvalConfig(k=10, dedup=True))
    return rounded(found, "ndcg_at_k").select("ndcg_at_k", "users")


# Multipliers of three fixed scores that take the place of three models.
GRID_STEPS = (7919, 7907, 7901)


@query
def grid_best_point(spark, folder):
    """All points in one pass over the rows."""
    rows, names = views.interactions(spark, folder), [f"prediction{i}" for i in range(len(GRID_STEPS))]
    scored = rows.withColumns({n: views.fixed_score(step) for n, step in zip(names, GRID_STEPS)})
    found = rounded(evaluate_points(scored, names, views.TOP_10), "map")
    return ranking.best_point(found.select("point", "map"))


# --- recommendations from fixed factors --------------------------------------------------


def _ranked(recs):
    rows = recs.select("user_id", F.posexplode("recommendations"))
    return rows.select(
        "user_id",
        (F.col("pos") + 1).alias("rank"),
        F.col("col.item_id").alias("item_id"),
        F.round("col.rating", ROUND).alias("rating"),
    )


@query
def dot_product_top_k(spark, folder):
    return _ranked(views.fixed_recs(spark, folder))


@query
def dot_product_top_k_stored(spark, folder):
    """The same with the items read from stored files, the longest vectors first."""
    return _ranked(views.fixed_recs(spark, folder, stored=True))


@query
def rec_items_array(spark, folder):
    return as_text(ranking.rec_items(views.fixed_recs(spark, folder)), "item_ids")


@query
def rec_rows_exploded(spark, folder):
    return rounded(ranking.rec_rows(views.fixed_recs(spark, folder)), "rating")


@query
def recs_exclude_seen(spark, folder):
    train, _, _ = _split(spark, folder)
    recs = ranking.rec_rows(views.fixed_recs(spark, folder))
    return rounded(ranking.exclude_seen(recs, train), "rating")


@query
def recs_only_test(spark, folder):
    _, _, test = _split(spark, folder, store=True)
    recs = ranking.rec_rows(views.fixed_recs(spark, folder))
    return rounded(ranking.only_test(recs, test), "rating")


@query
def ordered_recs(spark, folder):
    train, _, _ = _split(spark, folder)
    recs = ranking.exclude_seen(ranking.rec_rows(views.fixed_recs(spark, folder)), train)
    scored = recs.withColumnRenamed("rating", "prediction")
    lists = ranking.ordered_predictions(scored, views.LIST_LIMIT)
    return as_text(lists, "item_ids")


def _eval_fixed(spark, folder, mode):
    train, _, test = _split(spark, folder, store=True)
    cfg = EvalConfig(mode=mode, k=views.RECS_K)
    pairs = interactions.rated_pairs(test)
    placed = candidates_from_recs(views.fixed_recs(spark, folder), train, pairs, cfg)
    found = ranking.ranking_metrics(placed, ranking.label_counts(pairs), cfg.k)
    return rounded(found, *METRICS)


@query
def eval_all_items_fixed(spark, folder):
    return _eval_fixed(spark, folder, "all_items")


@query
def eval_unseen_items_fixed(spark, folder):
    return _eval_fixed(spark, folder, "unseen_items")


@query
def eval_recs_in_test_fixed(spark, folder):
    return _eval_fixed(spark, folder, "recs_in_test")


def _eval_by_user(spark, folder, mode):
    """The same over tables that are kept by user."""
    train, _, test = _split(spark, folder, store=True)
    cfg = EvalConfig(mode=mode, k=views.RECS_K)
    facts = user_facts(UserTables(spark), train, interactions.rated_pairs(test), cfg)
    placed = candidates_by_user(views.fixed_recs(spark, folder), facts, cfg)
    found = ranking.ranking_metrics(placed, ranking.label_counts(facts.pairs), cfg.k)
    return rounded(found, *METRICS)


@query
def eval_all_items_by_user(spark, folder):
    return _eval_by_user(spark, folder, "all_items")


@query
def eval_unseen_items_by_user(spark, folder):
    return _eval_by_user(spark, folder, "unseen_items")


@query
def eval_recs_in_test_by_user(spark, folder):
    return _eval_by_user(spark, folder, "recs_in_test")


# --- models --------------------------------------------------------------------------------

FIT = AlsConfig(rank=10, reg_param=0.1)
# Both ends of both axes of the default grid, the points that the SQL of ``als_grid_points`` names.
ENDS = GridConfig(ranks=(10, 160), reg_params=(0.001, 1.0))


def _model(spark, folder):
    train, _, test = _split(spark, folder, store=True)
    return als.fit_als(train, FIT), train, test


@query
def als_item_factors(spark, folder):
    return als.item_factors(_model(spark, folder)[0])


@query
def als_predict(spark, folder):
    model, _, test = _model(spark, folder)
    return als.predict(model, test)


@query
def als_recommend(spark, folder):
    model, _, test = _model(spark, folder)
    return ranking.rec_rows(als.recommend(model, test, TOP_K))


@query
def als_reload_predict(spark, folder):
    model, _, test = _model(spark, folder)
    path = fresh_path(spark, "model")
    files.save_model(model, path)
    return als.predict(files.load_model(path), test)


def _eval_model(spark, folder, mode):
    model, train, test = _model(spark, folder)
    pairs = cut(interactions.rated_pairs(test))
    return evaluate(model, train, pairs, EvalConfig(mode=mode, k=TOP_K))


@query
def eval_all_items(spark, folder):
    return _eval_model(spark, folder, "all_items")


@query
def eval_unseen_items(spark, folder):
    return _eval_model(spark, folder, "unseen_items")


@query
def eval_recs_in_test(spark, folder):
    return _eval_model(spark, folder, "recs_in_test")


def _grid_metrics(spark, folder, grid):
    train, val, _ = _split(spark, folder, store=True)
    cfg = EvalConfig(mode="all_items", k=TOP_K)
    return grid_search(train, val, grid, cfg).metrics


@query
def als_grid_metrics(spark, folder):
    """Every point of the default grid, fitted and scored."""
    return _grid_metrics(spark, folder, GridConfig())


# What does not depend on the fitted numbers, and so has an exact counterpart.


@query
def als_factor_ids(spark, folder):
    """The items that got factors, and how many."""
    found = als.item_factors(_model(spark, folder)[0])
    return found.select(F.col("id").alias("item_id"), F.size("features").alias("width"))


def _as_tested(df, test):
    """Columns and types of the test rows; the model works on 32-bit ids."""
    return df.select(*[F.col(f.name).cast(f.dataType) for f in test.schema.fields])


@query
def als_predicted_rows(spark, folder):
    """The test rows that get a prediction: user and item are known."""
    model, _, test = _model(spark, folder)
    return _as_tested(als.predict(model, test), test)


@query
def als_reload_rows(spark, folder):
    """The same from the model after a round trip through a file."""
    model, _, test = _model(spark, folder)
    path = fresh_path(spark, "model")
    files.save_model(model, path)
    return _as_tested(als.predict(files.load_model(path), test), test)


@query
def als_recommend_counts(spark, folder):
    """Recommendations per user, and the different items among them."""
    model, _, test = _model(spark, folder)
    rows = ranking.rec_rows(als.recommend(model, test, TOP_K))
    return rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("item_id").alias("items")
    )


@query
def eval_all_items_users(spark, folder):
    """The users that count in the evaluation."""
    return _eval_model(spark, folder, "all_items").select("users")


@query
def als_grid_points(spark, folder):
    """The points of a grid in order; both axes are walked."""
    return _grid_metrics(spark, folder, ENDS).select("point", "rank", "reg_param", "users")


# --- jobs ------------------------------------------------------------------------------------


@query
def job_split(spark, folder):
    """The three tables that the split job writes, with the part as a column."""
    source, out = fresh_path(spark, "interactions"), fresh_path(spark, "split")
    views.interactions(spark, folder).write.parquet(source)
    paths = jobs.split(spark, source, out, views.SPLIT)
    parts = [spark.read.parquet(p).withColumn("part", F.lit(name)) for name, p in paths.items()]
    return split.merge_train(*parts)


def _category_files(spark, folder):
    counts, id_map = fresh_path(spark, "counts-json"), fresh_path(spark, "id-map-csv")
    out = fresh_path(spark, "top")
    views.nested_counts(spark, folder).write.json(counts)
    files.write_csv(views.item_map(spark, folder), id_map, header=True)
    jobs.top_categories(spark, counts, id_map, out, list(views.SEGMENTS))
    return out


@query
def job_top_categories(spark, folder):
    return spark.read.parquet(f"{_category_files(spark, folder)}/top_categories")


@query
def job_factors_by_category(spark, folder):
    """Wide factors of items with a category; the factors go by the ids of the id map."""
    source, out = fresh_path(spark, "factors"), fresh_path(spark, "wide")
    renamed = views.factors(spark, folder).select((F.col("id") + 100000).alias("id"), "features")
    renamed.write.parquet(source)
    top = f"{_category_files(spark, folder)}/top_categories"
    jobs.factors_by_category(spark, source, top, out)
    return as_double(files.read_wide_factors(spark, out))


@query
def job_factor_view(spark, folder):
    """The points that the view job draws from written factors, without their coordinates."""
    wide, names = fresh_path(spark, "wide"), fresh_path(spark, "category-map-csv")
    files.write_wide_csv(_wide(spark, folder), wide)
    cmap = categories.category_map(_top(spark, folder))
    files.write_csv(cmap.select("category_id", "top_category"), names, header=False)
    points = jobs.factor_view(spark, wide, names, ViewConfig(train_percent=50, plot_percent=80))
    return points.select("draw_id", "first_draw", "train_draw", "item_id", "category_id", "category")


def _fit_job(spark, folder, mode):
    """The split and train/eval jobs from files to files: the users that the report covers."""
    source, out = fresh_path(spark, "interactions"), fresh_path(spark, "split")
    views.interactions(spark, folder).write.parquet(source)
    paths = jobs.split(spark, source, out, views.SPLIT)
    grid, ev = GridConfig(ranks=(10,), reg_params=(0.1,)), EvalConfig(mode=mode, k=TOP_K)
    jobs.train_eval(spark, paths["train"], paths["val"], f"{out}/fit", grid, ev, paths["test"])
    items = spark.read.parquet(f"{out}/fit/item_factors")
    width = items.agg(F.count(F.lit(1)).alias("items"), F.max(F.size("features")).alias("width"))
    report = spark.read.parquet(f"{out}/fit/report").select("users", F.lit(0).alias("one"))
    return report.join(width.withColumn("one", F.lit(0)), "one").drop("one")


@query
def job_train_eval_test_rows(spark, folder):
    return _fit_job(spark, folder, "test_rows")


@query
def job_train_eval_all_items(spark, folder):
    return _fit_job(spark, folder, "all_items")
