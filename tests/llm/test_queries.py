"""The registered queries against SQL, and the pipeline stage by stage."""

import pytest

import corpus_pipeline
from tastegrid.llm.oracles import ORACLES
from tastegrid.llm.queries import QUERIES
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, database, name):
    assert difference(QUERIES[name](spark, FOLDER), database.sql(ORACLES[name])) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_give_every_row(spark, name):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert QUERIES[name](spark, FOLDER).select("doc_id").distinct().count() == rows


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        kept.append(sorted(r[0] for r in docs.select("doc_id").collect()))
    judged, exact, near, mix = kept
    assert set(near) < set(exact) < set(judged) and set(mix) <= set(near)
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted({(r["doc_id"]) for r in rows}) == sorted(set(mix))
    assert sum(r["piece"] == 0 for r in rows) == len(mix)


def test_stages_on_no_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0
