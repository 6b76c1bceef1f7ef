import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tastegrid.llm.packing import PackConfig, best_fit, local_search, pack, plan_bins
from tastegrid.llm.tokens import WordEncoder, slices
from tests.llm.tables import LONG, documents

FILES = [public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")]
SIGNS = list(" \n\t\x0b\x1c\x85\xa0\u2003\u3000aAbZsStT.,'!<|>09éÉİΣßñ\u0301\u0308日\U0001F600\u200bǅ") + ["<|endoftext|>", "'ll", "  ", " a", "b."]


@pytest.fixture(scope="module", params=FILES)
def pair(request):
    return WordEncoder(request.param), Tokenizer.from_file(request.param)


def test_words_give_the_ids_of_the_text(pair):
    encoder, plain = pair

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.lists(st.sampled_from(SIGNS), max_size=25).map("".join), min_size=1, max_size=40))
    def check(texts):
        ids, ends = encoder.encode(pa.array(texts, pa.string()))
        expected = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == expected

    check()
    texts = pa.array([None, "", LONG, "a"], pa.string())
    ids, ends = encoder.encode(texts)
    assert ends[1] == ends[0] == ends[2] == 0
    assert ids[ends[2] : ends[3]].tolist() == plain.encode(LONG, add_special_tokens=False).ids


def test_slices_cover_all_rows():
    texts = pa.array(["a" * n for n in (5, 0, 90, 3, 3, 3)] + [None])
    for most in (1, 6, 50, 1000):
        found = slices(texts, most)
        assert found[0][0] == 0 and found[-1][1] == 7 and all(a[1] == b[0] for a, b in zip(found, found[1:]))
    assert slices(pa.array([], pa.string())) == []


def pieces_of(plan):
    held = Counter()
    for pattern, n in plan.items():
        assert n > 0 and pattern
        for length in pattern:
            held[length] += n
    return held


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_piece_and_search_only_helps(seed):
    draw = random.Random(seed)
    low, high = [(1, 100), (30, 60), (20, 50), (25, 100)][seed]
    counts = Counter(draw.randint(low, high) for _ in range(2000))
    first = best_fit(counts, 100)
    last = local_search(first, 100, 20_000)
    for plan in (first, last):
        assert pieces_of(plan) == counts and all(sum(p) <= 100 for p in plan)
    squares = [sum(sum(p) ** 2 * n for p, n in plan.items()) for plan in (first, last)]
    assert squares[1] >= squares[0] and sum(last.values()) <= sum(first.values())


def test_search_empties_bins_by_exchange():
    # Two of 6, 4 and one of 5, 3: exchanges leave full bins and one bin less.
    plan = local_search({(6, 3): 2, (4, 4): 1, (2,): 1}, 10, 100)
    assert sum(plan.values()) == 3 and pieces_of(plan) == Counter({6: 2, 3: 2, 4: 2, 2: 1})
    with pytest.raises(ValueError):
        plan_bins({11: 1}, 10, 10)


ROWS = [(i, " ".join(f"w{j * 7 % 50}" for j in range(i * 3 % 211))) for i in range(150)]
ODD = [(900, None), (901, ""), (902, LONG), (None, "no id"), (903, "same"), (903, "same"), (903, "other")]


@pytest.mark.parametrize("capacity", [64, 2048])
def test_layout_and_ids(spark, capacity):
    rows = ROWS + ODD
    found = pack(documents(spark, rows, clashing=True), PackConfig(FILES[0], capacity), with_ids=True).collect()
    plain, expected = Tokenizer.from_file(FILES[0]), []
    for doc_id, text in rows:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        expected += [(doc_id, at // capacity, at, zlib.crc32(ids[at : at + capacity].tobytes()), ids[at : at + capacity].tobytes())
                     for at in range(0, len(ids), capacity)]
    got = [(r["doc_id"], r["piece"], r["start"], r["ids_crc32"], bytes(r["ids"])) for r in found]
    assert sorted(got, key=str) == sorted(expected, key=str)
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        held.sort()
        assert held[0][0] == 0 and sum(held[-1]) <= capacity
        assert all(a + n == b for (a, n), (b, _) in zip(held, held[1:]))
    assert sorted(bins) == list(range(len(bins)))
    total = sum(r["length"] for r in found)
    assert len(bins) <= -(-total // capacity) * 1.02 + 1


def test_no_rows(spark):
    assert pack(documents(spark, []), PackConfig(FILES[0])).count() == 0
