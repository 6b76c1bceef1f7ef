import re

import pytest

from tastegrid.llm.licenses import TEMPLATES, scan
from tests.llm.tables import LONG, documents


def grams(text):
    w = [x for x in re.sub("[\x00-\x2f:-@\\[-`{-\x7f]+", " ", text).lower().split(" ") if x]
    return set(zip(w, w[1:])) if len(w) > 1 else {(x,) for x in w}


def brute_force(rows, least):
    found = []
    for doc_id, text in rows:
        lines = (text or "").split("\n") if text is not None else []
        units = ([(-1, text)] if len(lines) > 1 else []) + list(enumerate(lines))
        for line, unit in units:
            best = None
            for name, template in sorted(TEMPLATES.items()):
                a, b = grams(unit), grams(template)
                dice = 2 * len(a & b) / (len(a) + len(b)) if a else 0
                if a and dice >= least and (best is None or dice > best[1]):
                    best = (name, dice)
            if best:
                found.append((doc_id, line, *best))
    return sorted(found, key=str)


ROWS = [
    (1, "Licensed under the Apache License, Version 2.0."),
    (2, "text\nRELEASED under the mit license\n\nmore"),
    (3, TEMPLATES["MIT-text"].replace(". ", ".\n").replace(", ", ",\n")),
    (4, None), (5, ""), (6, "\n\n"), (7, LONG + "\nAll rights reserved."), (None, "Released under the MIT License!"),
    (8, "Licensed under the Apache License, Version 3.0 (almost)."), (8, "All rights reserved."), (8, "All rights reserved."),
    (9, "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0."),
]


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_scan_equals_brute_force(spark, least):
    rows = scan(documents(spark, ROWS, clashing=True), least=least).collect()
    assert sorted((tuple(r) for r in rows), key=str) == brute_force(ROWS, least)


def test_scan_is_native_and_without_shuffle(spark):
    plan = scan(documents(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_no_rows_and_bad_templates(spark):
    assert scan(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        scan(documents(spark, ROWS), {"empty": "..."})
