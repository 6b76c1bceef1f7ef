import pytest

from tastegrid.config import AlsConfig, EvalConfig, GridConfig, SplitConfig, ViewConfig
from tastegrid.operators.sampling import sample_size
from tastegrid.plans import jobs
from tastegrid.queries import views
from tastegrid.sources import workspace
from tastegrid.sources.files import read_parquet, write_csv, write_parquet

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def out(spark, tmp_path_factory):
    return str(tmp_path_factory.mktemp("jobs"))


def test_split_train_profile_and_view(spark, out):
    rows = views.interactions(spark, FOLDER)
    write_parquet(rows, f"{out}/interactions")
    cfg = SplitConfig(row_key=("row_key",))
    paths = jobs.split(spark, f"{out}/interactions", f"{out}/split", cfg)
    sizes = {part: read_parquet(spark, path).count() for part, path in paths.items()}
    assert sizes["train"] > sizes["val"] > 0 and sizes["test"] > 0
    for path in paths.values():
        assert read_parquet(spark, path).columns == rows.columns
    with pytest.raises(Exception, match="(?i)exist"):
        jobs.split(spark, f"{out}/interactions", f"{out}/split", cfg)

    grid = GridConfig(ranks=(4,), reg_params=(0.1, 1.0), als=AlsConfig(max_iter=2))
    result = jobs.train_eval(
        spark,
        paths["train"],
        paths["val"],
        f"{out}/fit",
        grid,
        EvalConfig(mode="test_rows", k=20),
        report_on=paths["test"],
    )
    assert result.best["point"] in (0, 1)
    assert read_parquet(spark, f"{out}/fit/metrics").count() == 2
    assert read_parquet(spark, f"{out}/fit/report").first()["users"] > 0

    views.nested_counts(spark, FOLDER).write.json(f"{out}/counts")
    # The translation maps every id to itself, so that factors find their category.
    ids = views.item_counts(spark, FOLDER).selectExpr(
        "CAST(item_id AS INT) AS item_id_csv", "CAST(item_id AS INT) AS item_id"
    )
    write_csv(ids, f"{out}/id_map", header=True)
    rejected = jobs.top_categories(
        spark, f"{out}/counts", f"{out}/id_map", f"{out}/top", list(views.SEGMENTS)
    )
    assert rejected == 0
    top = read_parquet(spark, f"{out}/top/top_categories")
    assert top.columns == ["item_id", "category_id", "top_category"]
    assert top.count() == ids.count()

    jobs.factors_by_category(
        spark, f"{out}/fit/item_factors", f"{out}/top/top_categories", f"{out}/wide"
    )
    view = ViewConfig(train_percent=50, plot_percent=100, balance=False)
    points = jobs.factor_view(spark, f"{out}/wide", f"{out}/top/category_map", view)
    items = read_parquet(spark, f"{out}/fit/item_factors").count()
    assert points.count() == sample_size(items, 50)
    assert points.where("category IS NULL").count() == 0
    assert {"item_id", "category_id", "x", "y", "in_view"} <= set(points.columns)
    balanced = jobs.factor_view(spark, f"{out}/wide", f"{out}/top/category_map")
    assert len({r["count"] for r in balanced.groupBy("category_id").count().collect()}) == 1


def test_shared_folder_is_kept(spark):
    first = workspace.shared_folder(spark)
    assert workspace.shared_folder(spark) == first
    assert workspace.fresh_path(spark, "a") != workspace.fresh_path(spark, "a")
    assert workspace.fresh_path(spark, "a").startswith(first.rstrip("/"))
