import random
import re

import pytest

from tastegrid.llm.licenses import TEMPLATES, full_texts, notices, scan, windows
from tests.llm.tables import LONG, documents

ALL = {**TEMPLATES, **full_texts()}


def words(text):
    return [x for x in re.sub("[\x00-\x2f:-@\\[-`{-\x7f]+", " ", text).lower().split(" ") if x]


def pairs(w):
    return list(zip(w, w[1:]))


def dice(a, b):
    return 2 * len(set(a) & set(b)) / (len(set(a)) + len(set(b))) if a and b else 0.0


def brute_force(rows, templates, least):
    """Every window that a pair found once in its template places, over all templates, without pruning."""
    found = []
    for doc_id, text in rows:
        w = words(text or "")
        good = set()
        for name, template in templates.items():
            t = words(template)
            tp, p = pairs(t), pairs(w)
            once = {pair: i for i, pair in enumerate(tp) if tp.count(pair) == 1}
            places = {max(min(i - once[pair], max(len(w) - len(t), 0)), 0) for i, pair in enumerate(p) if pair in once}
            for begin in places:
                end = min(begin + len(t), len(w))
                d = dice(tp, pairs(w[begin:end]))
                if d >= least:
                    good.add((-d, -len(t), name, begin, end))
        taken = []
        for x in sorted(good):
            if all(x[4] <= y[3] or y[4] <= x[3] for y in taken):
                taken.append(x)
        lines = (text or "").split("\n")
        owners = [i for i, line in enumerate(lines) for _ in words(line)]
        for low, _, name, begin, end in taken:
            own = pairs(words(TEMPLATES[name])) if name in TEMPLATES else None
            first, last = owners[begin], owners[end - 1]
            if own and (dice(own, pairs(w)) >= least or (first == last and dice(own, pairs(words(lines[first]))) >= least)):
                continue
            found.append((doc_id, first, name, -low))
    return sorted(found, key=str)


def _rows():
    """Texts with notices whole, wrapped, with words changed, left out or put in, between other words."""
    draw, rows = random.Random(7), []
    short = [t for t in ALL.values() if len(words(t)) < 250]
    for doc_id in range(60):
        w = LONG[: draw.randrange(0, 400)].split() + draw.choice(short).split()
        for _ in range(draw.randrange(0, 12)):
            at = draw.randrange(len(w))
            w[at : at + draw.randrange(2)] = draw.choice([[], ["license"], ["odd", "words"]])
            if not w:
                w = ["license"]
        w += draw.choice(short).split()[: draw.randrange(1, 60)] + LONG[: draw.randrange(0, 200)].split()
        rows.append((doc_id, "".join(x + draw.choice([" ", " ", " ", " ", "\n", "\n\n# "]) for x in w)))
    return rows + [(None, rows[3][1]), (3, rows[3][1]), (3, rows[4][1]), (98, None), (99, ""), (97, "mit"), (96, "\n.\n")]


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_windows_equal_brute_force(spark, least):
    rows = _rows()
    short = {k: v for k, v in ALL.items() if len(words(v)) < 250}
    found = sorted((tuple(r) for r in windows(documents(spark, rows), short, least).collect()), key=str)
    assert found == brute_force(rows, short, least)
    assert len(found) > 50


def test_notices_are_scan_and_windows(spark):
    docs = documents(spark, _rows(), clashing=True)
    both = sorted(map(tuple, scan(docs).collect() + windows(docs).collect()), key=str)
    assert sorted(map(tuple, notices(docs).collect()), key=str) == both


def test_texts_are_normalised_once_and_odd_tables(spark):
    docs = documents(spark, _rows())
    plan = notices(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and plan.count("Scan") == 1
    for search in (windows, notices):
        assert search(documents(spark, [])).count() == 0
        assert search(documents(spark, [(1, None), (2, ""), (None, "word")])).count() == 0
        with pytest.raises(ValueError):
            search(docs, least=0.0)
