import hashlib
import re
from collections import defaultdict

import pytest

from tastegrid.llm.exact_dedup import drop_copies, exact_groups
from tests.llm.tables import LONG, documents

ROWS = [
    (5, "a  b\tc"), (3, "a b c"), (9, "a b c"), (4, None), (7, ""), (8, " "), (2, "\n\t "),
    (1, LONG), (6, LONG + "!"), (10, LONG), (None, "a b c"), (None, "alone"), (11, "twice"), (11, "twice"),
    (12, "same id"), (12, "other text"), (13, "é" * 5000), (14, "é" * 5000),
]


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", text or "")].append(doc_id)
    found = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        first = True
        for i in sorted(ids, key=lambda x: (x is None, x)):
            kept = i == keep and first
            first = first and not kept
            found.append((i, keep, len(ids), kept, sha))
    return sorted(found, key=str)


@pytest.mark.parametrize(("block", "bits"), [(4096, 64), (16, 64), (512, 3)])
def test_groups_equal_brute_force(spark, block, bits):
    rows = exact_groups(documents(spark, ROWS, clashing=True), block, bits).collect()
    assert sorted((tuple(r) for r in rows), key=str) == expected(ROWS)


def test_no_rows(spark):
    assert exact_groups(documents(spark, [])).count() == 0
    assert drop_copies(documents(spark, [])).count() == 0


def test_stage_keeps_one_row_of_each_group_with_all_columns(spark):
    docs = documents(spark, ROWS, clashing=True)
    left = drop_copies(docs)
    assert left.columns == docs.columns
    keep = sorted((str(r[0]) for r in expected(ROWS) if r[3]))
    assert sorted(str(r["doc_id"]) for r in left.collect()) == keep
