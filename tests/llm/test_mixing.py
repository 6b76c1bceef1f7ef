import math

import pytest
from pyspark.sql import functions as F

from tastegrid.llm.mixing import Mixture, _count, mixed, mixture, rates, thresholds
from tests.llm.tables import LONG, documents

ROWS = [(i, "x" * (10 + i % 7), f"s{i % 5 if i % 3 else 0}") for i in range(3000)]
ODD = [(5000, None, "s1"), (5001, "", "s2"), (5002, LONG, None), (None, "no id", "s1"), (5003, "same", "s3"), (5003, "same", "s3")]


def test_thresholds_are_the_distribution_function():
    for mean in (0.0, 0.3, 2.5, 16.0):
        term, total = math.exp(-mean), 0.0
        for k, value in enumerate(thresholds(mean)):
            total += term
            assert value == pytest.approx(total, abs=1e-12)
            term *= mean / (k + 1)
        assert value == pytest.approx(1, abs=1e-12)


def test_shares_reach_their_targets_and_positions_are_a_permutation(spark):
    docs = documents(spark, ROWS + ODD, clashing=True)
    mix = Mixture({"s1": 0.5, "s2": 0.2}, rest=0.3, seed=4)
    rows = mixture(docs, mix).collect()
    assert sorted(r["position"] for r in rows) == list(range(len(rows)))
    size = {(i, s): len(t or "") for i, t, s in ROWS + ODD}
    # The one very long text decides the total of its own source, so it is left out here.
    total = {}
    for r in rows:
        if r["doc_id"] != 5002:
            name = r["source"] if r["source"] in mix.weights else "rest"
            total[name] = total.get(name, 0) + size[(r["doc_id"], r["source"])]
    assert total["s1"] / total["s2"] == pytest.approx(2.5, rel=0.05)
    copies = {}
    for r in rows:
        copies.setdefault(r["doc_id"], []).append(r["copy"])
    assert all(set(range(len(set(c)))) == set(c) for c in copies.values())


def test_counts_have_mean_and_variance_of_poisson(spark):
    for mean in (0.4, 3.0, 40.5):
        row = spark.range(20_000).withColumnRenamed("id", "doc_id").select(_count(mean, 7).alias("n"))
        got = row.agg(F.avg("n"), F.var_samp("n")).first()
        assert got[0] == pytest.approx(mean, rel=0.05) and got[1] == pytest.approx(mean, rel=0.08)


def test_same_rows_under_any_partitioning(spark):
    docs = documents(spark, ROWS + ODD)
    mix = Mixture({"s1": 0.5}, rest=0.5)
    one, two = (sorted(map(tuple, mixture(docs.repartition(n), mix).collect()), key=str) for n in (2, 7))
    assert one == two


def test_stage_repeats_whole_rows(spark):
    docs = documents(spark, ROWS + ODD, clashing=True)
    mix = Mixture({"s1": 0.5}, rest=0.5)
    left = mixed(docs, mix)
    assert left.schema == docs.schema
    count = {}
    for r in mixture(docs, mix).collect():
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
    got = {r["doc_id"]: r["n"] for r in left.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == count


def test_no_rows_sources_without_text_and_bad_weights(spark):
    empty = documents(spark, [])
    assert mixture(empty, Mixture({"a": 1.0}, 1.0)).count() == 0 and mixed(empty, Mixture({}, 1.0)).count() == 0
    by_name, rest = rates(documents(spark, [(1, None, "a"), (2, "text", "b")]), Mixture({"a": 1.0}, 1.0))
    assert by_name == {"a": 0.0} and rest == 0.5
    with pytest.raises(ValueError):
        Mixture({"a": -1.0}, 1.0)
