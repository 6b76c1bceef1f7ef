from collections import Counter

import pytest

from tastegrid.llm.mixing import Mixture, mixed, mixture
from tastegrid.llm.queries import MIXTURE
from tests.llm.tables import documents

# A third has no doc_id; some rows repeat an id with other texts, some are full copies.
ROWS = [
    (None if i % 3 == 0 else i if i % 3 == 1 else i % 30, f"text {i}", f"src{i // 3 % 8}") for i in range(6000)
] + [(None, "full copy", "src1")] * 1000


def shares(rows, source):
    return Counter(r[source] for r in rows)


def test_rows_without_id_of_their_own_are_drawn_one_by_one(spark):
    docs = documents(spark, ROWS, clashing=True)
    rows = mixture(docs, Mixture({"src1": 0.3, "src2": 0.2}, rest=0.5, seed=1)).collect()
    lengths = Counter()
    for r in mixed(docs, Mixture({"src1": 0.3, "src2": 0.2}, rest=0.5, seed=1)).collect():
        lengths[r["source"] if r["source"] in ("src1", "src2") else "rest"] += len(r["text"])
    total = sum(len(r[1]) for r in ROWS)
    for name, weight in (("src1", 0.3), ("src2", 0.2), ("rest", 0.5)):
        assert lengths[name] / total == pytest.approx(weight, abs=0.03)
    assert sorted(r["position"] for r in rows) == list(range(len(rows)))
    assert sum(r["doc_id"] is None for r in rows) > len(rows) / 4


def test_null_ids_survive_the_production_mixture(spark):
    docs = documents(spark, ROWS)
    taken = mixed(docs, MIXTURE).collect()
    for source in ("src1", "src5"):
        before = sum(r[0] is None and r[2] == source for r in ROWS) / sum(r[2] == source for r in ROWS)
        after = [r["doc_id"] is None for r in taken if r["source"] == source]
        assert sum(after) / len(after) == pytest.approx(before, abs=0.1)
    # Full copies are neither all taken equally often nor all dropped.
    copies = Counter(r["copy"] for r in mixture(docs, MIXTURE).where("doc_id IS NULL AND source = 'src1'").collect())
    assert copies[0] > copies[1] > 0


def test_same_rows_under_any_partitioning(spark):
    docs = documents(spark, ROWS)
    one, two = (sorted(map(tuple, mixture(docs.repartition(n), MIXTURE).collect()), key=str) for n in (2, 7))
    assert one == two
