import random

import pytest
from pyspark.sql import functions as F

from tastegrid.llm import topk


def brute_force(rows, every, k):
    live = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None for x in v)]
    found = []
    for n, (q, a) in enumerate(live):
        if q % every == 0:
            scored = [(-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(live) if m != n]
            found += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(found)


def vectors(seed, n, width=9):
    draw = random.Random(seed)
    rows = [(i, [draw.randrange(-9, 10) for _ in range(width)]) for i in range(n)]
    hot = [3] * width
    rows += [(1000 + i, hot) for i in range(60)] + [(2000, None), (2001, [1, None, 2]), (None, hot), (2020, [1, 2]), (2040, []), (2060, [0] * width)]
    return rows + [(7, hot), (7, hot), (40, hot), (40, [1] * width)]


@pytest.mark.parametrize(("n", "block"), [(300, 16_384), (300, 7), (0, 16_384)])
def test_equals_brute_force(spark, monkeypatch, n, block):
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", block)
    rows = vectors(n, n)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id BIGINT, vector ARRAY<BIGINT>, row INT, q INT")
    found = topk.top_k(df, F.col("vec_id") % 20 == 0, 20).collect()
    assert sorted(map(tuple, found)) == brute_force(rows, 20, 20)


def test_few_candidates_no_rows_and_non_finite(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0])], "vec_id BIGINT, vector ARRAY<DOUBLE>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 4)]
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert topk.top_k(df, F.lit(False)).count() == 0


def test_cutoff_spares_candidates(spark):
    """The second phase asks for a small part of all pairs, and misses none of the best."""
    draw = random.Random(5)
    rows = [(i, [draw.randrange(-50, 50) for _ in range(64)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id BIGINT, vector ARRAY<BIGINT>")
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, 5).collect())) == brute_force(rows, 20, 5)
