import random

import numpy as np
import pyarrow as pa
import pytest

from tastegrid.llm import near_dup
from tastegrid.llm.components import components
from tastegrid.llm.shelf import Shelf
from tests.llm.tables import LONG, documents


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in __import__("re").split("[\x20\x09-\x0d]+", lowered) if w]


def shingles(text, n):
    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_force(rows, n, top, base):
    """Union-find over all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][0] == rows[j][0]
            linked = sets[i] and sets[j] and len(sets[i] & sets[j]) * base >= len(sets[i] | sets[j]) * top
            if None not in (rows[i][0], rows[j][0]) and (linked or (same and sets[i] and sets[j])):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    found = []
    for i, (doc_id, _) in enumerate(rows):
        comp = None if doc_id is None else least[root(i)]
        found.append((doc_id, len(sets[i]), comp, comp == doc_id))
    return sorted(found, key=str)


def corpus(seed):
    """A base with many copies that differ in places of their own, chains, and the odd cases."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [draw.choice(vocabulary) for _ in range(120)]
    rows = []
    for edits in [1, 2, 2, 3, 3, 3, 4, 5] * 12:
        text = list(base)
        for _ in range(edits):
            text[draw.randrange(len(text))] = draw.choice(vocabulary)
        rows.append(" ".join(text))
    chain = [draw.choice(vocabulary) for _ in range(60)]
    for _ in range(12):
        rows.append(" ".join(chain))
        chain[draw.randrange(60)] = draw.choice(vocabulary)
    passage = " ".join(draw.choice(vocabulary) for _ in range(40))
    rows += [passage + " " + " ".join(draw.choice(vocabulary) for _ in range(20)) for _ in range(30)]
    rows += ["Short Text", "short  text", "SHORT text", "one", "two words", "a b c d e f g h", "a b c d e f g h i"]
    ids = list(range(len(rows)))
    draw.shuffle(ids)
    odd = [(900, None), (901, ""), (902, " \n"), (903, LONG), (904, LONG + " more"), (None, "one"),
           (905, "one"), (905, "one"), (906, "first of two texts"), (906, "second text here now")]
    return list(zip(ids, rows)) + odd


@pytest.mark.parametrize(("seed", "n", "top", "base"), [(1, 3, 17, 20), (2, 5, 4, 5)])
def test_groups_equal_brute_force(spark, seed, n, top, base):
    rows = corpus(seed)
    found = near_dup.near_groups(documents(spark, rows, clashing=True), n, (top, base)).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute_force(rows, n, top, base)


def test_no_rows(spark):
    assert near_dup.near_groups(documents(spark, [])).count() == 0


def test_stage_keeps_rows_and_columns(spark):
    docs = documents(spark, [(2, "a b c d e f g"), (1, "A b c d e f g"), (3, "other words"), (None, None)], True)
    left = near_dup.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "3", "None"]


def kept_by_rows(rows, n, top, base):
    """What stays if rows are judged by their texts alone: (doc_id, text), the first of each group."""
    by_place = brute_force([(i, t) for i, (_, t) in enumerate(rows)], n, top, base)
    groups = {}
    for place, size, comp, _ in by_place:
        groups.setdefault(comp if size else ("alone", place), []).append(place)
    best = [min(g, key=lambda i: (rows[i][0] is None, rows[i][0] or 0)) for g in groups.values()]
    return sorted((rows[i] for i in best), key=str)


A, B = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))


@pytest.mark.parametrize(
    "rows",
    [
        # A text that shares its id with a copy of another one stays.
        [(3, A + " more"), (7, A), (7, B)],
        [(None, A), (None, A + " x"), (None, B), (5, B + " y"), (None, None), (None, ""), (1, None)],
        [(4, A), (4, A), (4, A + " z"), (9, "short"), (9, "short")],
        [],
    ],
)
def test_stage_judges_rows_by_their_texts(spark, rows):
    left = near_dup.drop_near_copies(documents(spark, rows, clashing=True))
    found = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str)
    wanted = kept_by_rows(rows, 5, 4, 5)
    # Of rows that tie in id, which one stays is not told; their group is.
    assert [i for i, _ in found] == [i for i, _ in wanted] and len(found) == len(wanted)
    assert {t for _, t in found} >= {B} if (7, B) in rows else True


def test_stage_equals_brute_force(spark):
    rows = corpus(4)
    left = near_dup.drop_near_copies(documents(spark, rows))
    found = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str)
    assert found == kept_by_rows(rows, 5, 4, 5)


def apart(number):
    """Copies of one text with many changes each, so that hardly any two are linked."""
    draw = random.Random(number)
    vocabulary = [f"w{i}" for i in range(20_000)]
    base = [draw.choice(vocabulary) for _ in range(200)]
    texts = []
    for _ in range(number):
        text = list(base)
        for _ in range(draw.randint(4, 14)):
            text[draw.randrange(200)] = draw.choice(vocabulary)
        texts.append(" ".join(text))
    return list(enumerate(texts))


@pytest.mark.parametrize("number", [500, 2000])
def test_a_group_without_links_lists_no_pairs(spark, number, monkeypatch):
    """The classes of a group that are not linked to each other meet in few pairs, and no link is lost."""
    rows = apart(number)
    sizes = {}
    confirm = near_dup._Search.confirm

    def counted(self, pairs, label):
        stored = self.shelf.put(f"{label}-pairs", pairs)
        sizes[label] = stored.count()
        return confirm(self, stored, label)

    monkeypatch.setattr(near_dup._Search, "confirm", counted)
    found = near_dup.near_groups(documents(spark, rows), 3, (17, 20)).collect()
    # Links by an inverted index over shingles, which is brute force for texts of one group.
    sets = [shingles(t, 3) for _, t in rows]
    index = {}
    for i, s in enumerate(sets):
        for g in s:
            index.setdefault(g, len(index))
    width = len(index)
    bits = np.zeros((number, width), dtype=np.float32)
    for i, s in enumerate(sets):
        bits[i, [index[g] for g in s]] = 1
    common = bits @ bits.T
    n = bits.sum(axis=1)
    linked = 100 * common >= 85 * (n[:, None] + n[None, :] - common)
    parent = list(range(number))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in np.argwhere(np.triu(linked, 1)).tolist():
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: root(i) for i in range(number)}
    assert sizes["pivot"] < 4 * number and sizes["rest"] < 20 * number


def test_registers_hold_zeros_and_mantissa_of_the_least_hash():
    hashes = np.sort(np.random.RandomState(0).randint(0, 2**63, 5000).astype(np.uint64) * np.uint64(2))
    found = near_dup.registers(hashes, near_dup._probe_order())
    for bucket in range(near_dup.REGISTERS):
        least = min(int(h) & ((1 << 57) - 1) for h in hashes if int(h) >> 57 == bucket)
        zeros = 57 - least.bit_length()
        mantissa = (least >> (least.bit_length() - 11)) & 1023
        assert found[bucket] == zeros << 10 | mantissa


def test_estimates_are_near_the_truth(spark):
    draw = random.Random(3)
    texts = []
    for share in (0.5, 0.7, 0.9):
        both = [f"b{draw.random()}" for _ in range(int(4000 * share))]
        texts += [" ".join(both + [f"{side}{draw.random()}" for _ in range(int(4000 * (1 - share) / 2))]) for side in "xy"]
    sets = list(near_dup.shingle_sets(pa.array(texts), 1))
    probes = near_dup._probe_order()
    rows = []
    for one, two in zip(sets[::2], sets[1::2]):
        truth = len(np.intersect1d(one, two)) / len(np.union1d(one, two))
        regs = [near_dup.registers(s, probes).view("<i8").tolist() for s in (one, two)]
        rows.append((*regs, len(one), len(two), truth))
    df = spark.createDataFrame(rows, "a ARRAY<BIGINT>, b ARRAY<BIGINT>, n BIGINT, m BIGINT, truth DOUBLE")
    for row in df.select(near_dup.estimate(df.a, df.b, df.n, df.m).alias("e"), "truth").collect():
        assert abs(row["e"] - row["truth"]) < 0.15


def test_components_of_paths_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(200, 201), (201, 202), (202, 200)]
    found = components(spark.createDataFrame(links, "a BIGINT, b BIGINT"), Shelf(spark))
    assert {(r["node"], r["component"]) for r in found.collect()} == (
        {(i, 100) for i in range(100, 141)} | {(i, 7) for i in range(7, 60)} | {(i, 200) for i in range(200, 203)}
    )
