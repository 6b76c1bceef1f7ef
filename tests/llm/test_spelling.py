"""Spelling variants against plain loops."""

import random
import re
from collections import Counter
from zlib import crc32

import pytest

from tastegrid.llm import spelling
from tests.llm.tables import LONG, documents

RNG = random.Random(3)
CFG = spelling.SpellingConfig(min_count=1, drop_one_in=None)


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def all_near(words):
    """Near words by letting every word lose each of its letters, or have it masked."""
    shapes = {}
    for w in words:
        for i in range(len(w)):
            shapes.setdefault((i, w[:i] + "\0" + w[i + 1 :]), set()).add(w)
            shapes.setdefault(w[:i] + w[i + 1 :], set()).add((w,))
    found = {w: set() for w in words}
    for shape, members in shapes.items():
        if isinstance(shape, tuple):
            for w in members:
                found[w] |= members - {w}
        elif shape in found:
            for (w,) in members:
                found[w].add(shape)
                found[shape].add(w)
    return found


def counted(rows, cfg):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if cfg.drop_one_in and h % cfg.drop_one_in == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= cfg.min_chars:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= cfg.min_count}


def expected(rows, cfg):
    counts = counted(rows, cfg)
    neighbours = all_near(counts)
    form = {}
    for w, others in neighbours.items():
        best = min(others, key=lambda o: (-counts[o], o.encode()), default=None)
        if best is not None and counts[best] >= cfg.times * counts[w]:
            form[w] = best
    made = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        made.add((w, form.get(w), root, n, len(neighbours[w]), counts.get(form.get(w))))
    return made


def some_words(number, letters="aeinrst", lengths=(5, 9)):
    return ["".join(RNG.choices(letters, k=RNG.randint(*lengths))) for _ in range(number)]


def pairs_of(spark, words, cfg):
    table = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word STRING, n BIGINT")
    rows = spelling.near_pairs(table, cfg).collect()
    number = {w: i for i, w in enumerate(words)}
    assert all(number[r["word"]] == r["n"] and number[r["near"]] == r["near_n"] for r in rows)
    pairs = [frozenset((r["word"], r["near"])) for r in rows]
    assert len(set(pairs)) == len(pairs)
    return set(pairs)


ANAGRAMS = sorted({"".join(RNG.sample("abcdefghij", 10)) for _ in range(400)})


@pytest.mark.parametrize(
    "words, box_letters",
    [
        (sorted(set(some_words(3000))), 2_000),
        (sorted(set(some_words(1500, "abc", (5, 7)))), 500),
        # One vector of letter counts for all, and its neighbours.
        (ANAGRAMS + sorted({w[:4] + "z" + w[5:] for w in ANAGRAMS} | {w[:4] + w[5:] for w in ANAGRAMS}), 300),
        (["привет", "привед", "превед", "привте", "你好世界吗", "你好世界", "你好世间吗", "aaaaa", "aaaaaa"], 10),
        (["a" * 1000, "a" * 1001, "a" * 999 + "b", "a" * 1002], 100),
        (["alone"], 100),
        ([], 100),
    ],
)
def test_pairs_equal_masks(spark, words, box_letters):
    cfg = spelling.SpellingConfig(box_letters=box_letters, sample=500)
    wanted = {frozenset((w, o)) for w, others in all_near(words).items() for o in others}
    assert pairs_of(spark, words, cfg) == wanted


def test_masks_are_edits():
    words = sorted(set(some_words(120, "abc", (3, 4))))
    found = all_near(words)
    assert all((b in found[a]) == near(a, b) for a in words for b in words if a != b)


ROWS = [
    (1, "the letter letter Letter lettre LETTER ÉTÉ été Été"),
    (2, None),
    (3, ""),
    (4, "x123 letter-letter let'ter letters"),
    (4, "letters lettets"),
    (4, "letters lettets"),
    (None, "letters lettert lettertt"),
    (5, "×÷×÷× ×÷×÷÷ àáâãäå àáâãä"),
    (6, LONG),
    *[(100 + i, " ".join(some_words(30))) for i in range(60)],
    *[(200 + i, "the common phrase returns returns often") for i in range(300)],
]


@pytest.mark.parametrize("cfg", [CFG, spelling.SpellingConfig(), spelling.SpellingConfig(min_count=1, drop_one_in=5)])
def test_forms_equal_plain_loops(spark, cfg):
    made = spelling.variant_forms(documents(spark, ROWS, clashing=True), cfg)
    assert made.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = made.collect()
    assert {tuple(r) for r in rows} == expected(ROWS, cfg)
    assert len(rows) == len({r["word"] for r in rows})
    assert cfg.min_count > 1 or any(r["form"] is not None for r in rows)


def test_roots_of_long_walks(spark):
    """Numbers that double eleven times, each word one letter from the next."""
    words = ["m" * (5 + i) for i in range(12)]
    rows = [(i, " ".join([w] * 2**i)) for i, w in enumerate(words)]
    found = {r["word"]: r["root"] for r in spelling.variant_forms(documents(spark, rows), CFG).collect()}
    assert found == {w: words[-1] for w in words}


def test_no_rows(spark):
    assert spelling.variant_forms(documents(spark, [])).collect() == []
    assert spelling.variant_forms(documents(spark, [(1, None), (2, " 12 ")])).collect() == []
