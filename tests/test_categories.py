import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastegrid.operators.categories import (
    attach_category_id,
    category_map,
    expand_counts,
    rejected_ids,
    remap_ids,
    top_category,
    top_category_of_map,
)
from tastegrid.operators.factors import factor_moments, factors_by_category, project_2d, wide_factors, with_category_name
from tastegrid.sources.files import (
    counts_schema,
    read_category_map,
    read_counts_json,
    read_counts_map,
    read_id_map,
    read_wide_factors,
    write_csv,
    write_wide_csv,
)

LINES = [
    {"item_id": "1", "categories": {"poetry": 3, "history, biography": 3}},
    {"item_id": "2", "categories": {"poetry": 4}},
    {"item_id": "3", "categories": {}},
    {"item_id": "x9", "categories": {"young adult": 1}},
    {"item_id": None, "categories": {"young adult": 2}},
]


def write_lines(folder):
    path = folder / "counts.json"
    path.write_text("\n".join(json.dumps(line) for line in LINES))
    return str(path)


def test_top_category_from_json_with_and_without_schema(spark, tmp_path):
    path = write_lines(tmp_path)
    schema = counts_schema(["young adult", "poetry", "history, biography"])
    for df in (read_counts_json(spark, path), read_counts_json(spark, path, schema)):
        flat, names = expand_counts(df)
        assert names == ["history, biography", "poetry", "young adult"]
        top = top_category(flat, names)
        got = {r["item_id"]: r["top_category"] for r in top.collect()}
        assert got == {
            "1": "history, biography",
            "2": "poetry",
            "3": "history, biography",
            "x9": "young adult",
            None: "young adult",
        }
    assert flat.where("item_id IS NULL").count() == 1


def test_ids_map_and_translation(spark, tmp_path):
    flat, names = expand_counts(read_counts_json(spark, write_lines(tmp_path)))
    top = top_category(flat, names)
    cmap = category_map(top)
    assert {r["top_category"]: r["category_id"] for r in cmap.collect()} == {
        "history, biography": 0,
        "poetry": 1,
        "young adult": 2,
    }
    ids = attach_category_id(top, cmap)
    (tmp_path / "map.csv").write_text("item_id_csv,item_id\n100,1\n200,2\n900,9\n")
    id_map = read_id_map(spark, str(tmp_path / "map.csv"))
    expected = {(100, 0, "history, biography"), (200, 1, "poetry")}
    assert set(map(tuple, remap_ids(ids, id_map).collect())) == expected
    heavy = remap_ids(ids.unionByName(ids), id_map)
    assert sorted(map(tuple, heavy.collect())) == sorted(2 * list(expected))
    assert rejected_ids(ids).first()["rejected"] == 1
    path = str(tmp_path / "cmap")
    write_csv(cmap.select("category_id", "top_category"), path, header=False)
    again = read_category_map(spark, path)
    assert {tuple(r) for r in again.collect()} == {
        (0, "history, biography"),
        (1, "poetry"),
        (2, "young adult"),
    }


def test_factors_join_wide_csv_and_names(spark, tmp_path):
    factors = spark.createDataFrame(
        [(1, [0.1, -2.5e-8]), (2, [3.0, 4.0]), (3, [5.0, 6.0])], "id INT, features ARRAY<FLOAT>"
    )
    cats = spark.createDataFrame([(1, 0), (2, 7)], "item_id INT, category_id BIGINT")
    wide = wide_factors(factors_by_category(factors, cats))
    assert wide.columns == ["item_id", "category_id", "x0", "x1"]
    path = str(tmp_path / "wide")
    write_wide_csv(wide, path)
    again = read_wide_factors(spark, path)
    assert again.schema == wide.schema
    assert set(map(tuple, again.collect())) == set(map(tuple, wide.collect()))
    cmap = spark.createDataFrame([(0, "a")], "category_id BIGINT, category STRING")
    named = {r["item_id"]: r["category"] for r in with_category_name(wide, cmap).collect()}
    assert named == {1: "a", 2: None}
    assert wide_factors(factors_by_category(factors, cats.where(F.lit(False)))).collect() == []


def test_projection_keeps_the_largest_spread(spark):
    rows = spark.range(200).select(
        F.col("id").alias("item_id"),
        F.lit(0).alias("category_id"),
        (F.col("id") * 3.0).alias("x0"),
        (F.col("id") % 2 * 1.0).alias("x1"),
        F.lit(4.0).alias("x2"),
    )
    view = project_2d(rows, ["x0", "x1", "x2"])
    assert view.columns == ["item_id", "category_id", "x", "y"]
    ends = {r["item_id"]: r["x"] for r in view.where("item_id IN (0, 199)").collect()}
    assert abs(ends[199] - ends[0] - 597) < 0.1


def test_items_without_a_category_keep_their_rows(spark, tmp_path):
    """``empty="null"``: no category id, but the item stays."""
    flat, names = expand_counts(read_counts_json(spark, write_lines(tmp_path)))
    top = top_category(flat, names, "null")
    ids = attach_category_id(top, category_map(top))
    got = {r["item_id"]: (r["category_id"], r["top_category"]) for r in ids.collect()}
    assert len(got) == len(LINES) and got["3"] == (None, None) and got["2"][1] == "poetry"


def test_top_category_of_map_equals_columns(spark, tmp_path):
    path = write_lines(tmp_path)
    flat, names = expand_counts(read_counts_json(spark, path))
    for empty in ("first", "null"):
        wanted = top_category(flat, names, empty)
        found = top_category_of_map(read_counts_map(spark, path), empty)
        assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, wanted.collect()), key=str)
    with pytest.raises(ValueError):
        top_category_of_map(read_counts_map(spark, path), "other")


def test_ragged_counts_of_very_many_categories(spark, tmp_path):
    """Ten thousand categories, each on a few lines, none of them in a schema or a plan."""
    lines = []
    for i in range(3000):
        counts = {f"c{(i * 7 + j * 31) % 10_000:05d}": (i * j) % 5 for j in range(1, 12)}
        lines.append({"item_id": str(i), "categories": counts if i % 50 else None})
    path = tmp_path / "counts.json"
    path.write_text("\n".join(map(json.dumps, lines)))
    seen = sorted({c for line in lines for c in line["categories"] or {}})
    assert len(seen) > 9000

    def best(counts):
        full = counts or {}
        most = max(full.values(), default=0)
        return min(c for c in full if full[c] == most) if most > 0 else seen[0]

    frame = read_counts_map(spark, str(path))
    assert "c00007" not in frame._jdf.queryExecution().executedPlan().toString()
    found = {r["item_id"]: r["top_category"] for r in top_category_of_map(frame).collect()}
    assert found == {line["item_id"]: best(line["categories"]) for line in lines}
    assert top_category_of_map(frame.limit(0)).count() == 0


def test_moments_and_projection_leave_out_rows_without_a_coordinate(spark):
    draw = np.random.default_rng(2)
    points = draw.normal(size=(80, 4)) * [3.0, 1.0, 0.2, 0.1] + [100.0, 0.0, 5.0, 0.0]
    rows = [(i, *map(float, p)) for i, p in enumerate(points)] + [(900, 1.0, None, 2.0, 3.0), (901, None, None, None, None)]
    df = spark.createDataFrame(rows, "item_id INT, x0 DOUBLE, x1 DOUBLE, x2 DOUBLE, x3 DOUBLE")
    columns = ["x0", "x1", "x2", "x3"]
    found = factor_moments(df, columns).collect()
    covariance = np.cov(points.T)
    assert len(found) == 10 and {r["n"] for r in found} == {80}
    for r in found:
        assert r["covariance"] == pytest.approx(covariance[r["i"], r["j"]], abs=1e-9)
        assert r["mean"] == pytest.approx(points[:, r["i"]].mean(), abs=1e-9)
    shown = {r["item_id"]: (r["x"], r["y"]) for r in project_2d(df, columns).collect()}
    assert shown[900] == shown[901] == (None, None)
    axes = np.linalg.svd(points - points.mean(axis=0))[2][:2]
    axes = [a * np.sign(a[np.abs(a).argmax()]) for a in axes]
    for i, p in enumerate(points):
        assert shown[i] == pytest.approx(tuple(float(p @ a) for a in axes), abs=1e-6)
    assert project_2d(df.limit(0), columns).columns == ["item_id", "x", "y"]
    assert factor_moments(df.limit(0), columns).count() == 0
