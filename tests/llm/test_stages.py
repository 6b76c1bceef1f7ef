"""What the dedup stages of the pipeline keep of whole tables, against brute force."""

import re

import pytest

import corpus_pipeline
from tests.llm.tables import documents
from tests.llm.test_near_dup import corpus, kept_by_rows

FOLDER = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=str)


@pytest.fixture(scope="module", params=["table", "made"])
def docs(spark, request):
    if request.param == "table":
        return spark.read.parquet(f"{FOLDER}/documents.parquet")
    return documents(spark, [r for r in corpus(6) if r[0] not in (905, 906)])


def test_exact_stage_keeps_one_row_of_each_text(spark, docs):
    groups = {}
    for doc_id, text in rows_of(docs):
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", text or ""), []).append((doc_id, text))
    wanted = sorted((min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()), key=str)
    assert rows_of(STAGES["exact_dedup"](spark, docs, FOLDER)) == wanted


def test_near_stage_keeps_one_row_of_each_group(spark, docs):
    rows = rows_of(docs)
    kept = rows_of(STAGES["near_dedup"](spark, docs, FOLDER))
    assert kept == kept_by_rows(rows, 5, 4, 5)
    assert 0 < len(kept) < len(rows)
