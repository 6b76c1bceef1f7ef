import hashlib

from pyspark.sql import functions as F

from tastegrid.functions.hashing import DRAW_SPACE, draw, threshold
from tastegrid.functions.shapes import array_width, fill_zero, largest_column, widen_array


def test_draw_is_the_head_of_a_plain_md5(spark):
    row = spark.createDataFrame([(7, "a")], "id INT, name STRING").select(
        draw("split", 3, ["id", "name"]).alias("u")
    )
    assert row.first()["u"] == int(hashlib.md5(b"split:3:7:a").hexdigest()[:8], 16)


def test_draws_of_two_purposes_are_independent(spark):
    users = spark.range(20000)
    low = threshold(0.1)
    first = users.where(draw("sample", 1, ["id"]) < low)
    both = first.where(draw("split", 1, ["id"]) < low).count()
    assert 120 < both < 280
    assert 1800 < first.count() < 2200
    assert threshold(1) == DRAW_SPACE


def test_largest_column_first_of_several_wins(spark):
    names = ["a, b", "c d", "e"]
    df = spark.createDataFrame(
        [(1, 0, 3, 3), (2, 5, 5, 1), (3, 0, 0, 0), (4, 1, 2, 9)], "id INT, `a, b` INT, `c d` INT, e INT"
    )
    got = dict(df.select("id", largest_column(names)).collect())
    assert got == {1: "c d", 2: "a, b", 3: "a, b", 4: "e"}
    assert dict(df.select("id", largest_column(names, "null")).collect())[3] is None


def test_fill_zero_leaves_other_columns_alone(spark):
    df = spark.createDataFrame([(None, None), (1, 2)], "item_id INT, n INT")
    assert [tuple(r) for r in fill_zero(df, ["n"]).collect()] == [(None, 0), (1, 2)]


def test_widen_and_width(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0])], "id INT, v ARRAY<DOUBLE>")
    assert array_width(df, "v").first()["width"] == 2
    wide = widen_array(df, "v", 2, ["id"])
    assert wide.columns == ["id", "x0", "x1"]
    assert sorted(tuple(r) for r in wide.collect()) == [(1, 1.0, 2.0), (2, 3.0, None)]
    empty = df.where(F.lit(False))
    assert array_width(empty, "v").first()["width"] is None
    assert widen_array(empty, "v", None, ["id"]).collect() == []
