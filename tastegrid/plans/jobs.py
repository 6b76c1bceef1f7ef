"""The jobs: from files to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.config import EvalConfig, GridConfig, SplitConfig, ViewConfig
from tastegrid.functions.shapes import array_width
from tastegrid.operators.categories import (
    attach_category_id,
    category_map,
    expand_counts,
    rejected_ids,
    remap_ids,
    top_category,
    top_category_of_map,
)
from tastegrid.operators.factors import factors_by_category as join_factors
from tastegrid.operators.factors import project_2d, wide_factors, with_category_name
from tastegrid.operators.interactions import rated_pairs
from tastegrid.operators.sampling import plot_points, resample_percent
from tastegrid.plans.evaluate import evaluate
from tastegrid.plans.grid import GridResult, grid_search
from tastegrid.plans.split import split_interactions
from tastegrid.sources.files import (
    counts_schema,
    read_category_map,
    read_counts_json,
    read_counts_map,
    read_id_map,
    read_parquet,
    read_wide_factors,
    save_model,
    write_csv,
    write_parquet,
    write_wide_csv,
)
from tastegrid.sources.workspace import cut


def split(
    spark: SparkSession, interactions: str, out: str, cfg: SplitConfig = SplitConfig()
) -> dict[str, str]:
    """Write the split under ``out`` and return the Parquet paths of the three tables.

    All rows are written once, by part. The train part is a finished table as it
    stands; val and test are written again without the items that train lacks.
    """
    rows = read_parquet(spark, interactions)
    _, val, test = split_interactions(rows, cfg, store=f"{out}/labeled")
    write_parquet(val, f"{out}/val")
    write_parquet(test, f"{out}/test")
    return {"train": f"{out}/labeled/part=train", "val": f"{out}/val", "test": f"{out}/test"}


def train_eval(
    spark: SparkSession,
    train: str,
    select_on: str,
    out: str,
    grid: GridConfig = GridConfig(),
    ev: EvalConfig = EvalConfig(),
    report_on: str | None = None,
) -> GridResult:
    """Search the grid, then store metrics, best model and its item factors.

    Models are compared on ``select_on``; the best one may also be scored on rows
    that took no part in the choice, ``report_on``. The search keeps a journal under ``out``, so a
    job that was stopped there goes on where it was.
    """
    rows = read_parquet(spark, train)
    result = grid_search(rows, read_parquet(spark, select_on), grid, ev, f"{out}/journal")
    write_parquet(result.metrics, f"{out}/metrics")
    if result.model is not None:
        save_model(result.model, f"{out}/model")
        write_parquet(result.model.itemFactors, f"{out}/item_factors")
        if report_on is not None:
            pairs = cut(rated_pairs(read_parquet(spark, report_on), ev.min_rating))
            write_parquet(evaluate(result.model, rows, pairs, ev), f"{out}/report")
    return result


def top_categories(
    spark: SparkSession,
    counts: str,
    id_map: str,
    out: str,
    names: list[str] | None = None,
    empty: str = "first",
) -> int:
    """Write ``top_categories`` (Parquet, sorted by item) and ``category_map`` (CSV).

    With ``names`` the counts are read by schema, without as a map; either way the lines are read
    once. Returns how many item ids were left out because they are no number.
    """
    if names:
        flat, found = expand_counts(read_counts_json(spark, counts, counts_schema(names)))
        top = cut(top_category(flat, found, empty))
    else:
        top = cut(top_category_of_map(read_counts_map(spark, counts), empty))
    cmap = category_map(top)
    write_csv(cmap.select("category_id", F.col("top_category")), f"{out}/category_map", header=False)
    ready = remap_ids(attach_category_id(top, cmap), read_id_map(spark, id_map))
    ordered = ready.repartitionByRange("item_id").sortWithinPartitions("item_id")
    write_parquet(ordered, f"{out}/top_categories")
    return rejected_ids(top).first()["rejected"]


def factors_by_category(
    spark: SparkSession, factors: str, categories: str, out: str
) -> None:
    """Write item factors with categories as wide CSV with header lines.

    The width is measured on the factors alone, before the join.
    """
    table = read_parquet(spark, factors)
    width = array_width(table, "features").first()["width"]
    joined = join_factors(table, read_parquet(spark, categories))
    write_wide_csv(wide_factors(joined, width or 0), out)


def factor_view(
    spark: SparkSession, wide: str, category_map_csv: str, cfg: ViewConfig = ViewConfig()
) -> DataFrame:
    """Sampled points of the projected factors, one row a point, with category names."""
    rows = read_wide_factors(spark, wide)
    columns = [c for c in rows.columns if c not in ("item_id", "category_id")]
    keys = ["item_id"]
    if cfg.train_percent:
        rows = resample_percent(rows, cfg.train_percent, cfg.seed, keys)
        rows = rows.withColumnRenamed("draw_id", "train_draw")
        keys = ["item_id", "train_draw"]
    points = cut(project_2d(rows, columns))
    return with_category_name(
        plot_points(points, keys, cfg), read_category_map(spark, category_map_csv)
    )
