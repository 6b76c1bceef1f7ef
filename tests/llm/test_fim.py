"""Fill-in-the-middle against plain Python over code points."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tastegrid.llm import fim
from tests.llm.tables import LONG, documents

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ROWS = [
    (1, "one two  three\n"),
    (2, ""),
    (3, None),
    (4, "  \t "),
    (5, "été über 漢字 😀😀 naïve x"),
    (6, "holds <M> itself"),
    (7, "<P"),
    (7, "other text of the same id, with < and <S and > in it"),
    (7, "<P"),
    (None, "no id é"),
    (8, LONG + " ü " * 500),
    *[(100 + i, f"word{i} é{i}  <S x{i} y 𝄞" + " " * (i % 3)) for i in range(200)],
]


def expected(doc_id, text, units):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    tokens = TOKEN.findall(text) if units == "words" else list(text)
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    sizes = (len(prefix), len(middle))
    if h4 % 100 < 80:
        return doc_id, n, "spm", *sizes, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", *sizes, f"<P>{prefix}<S>{suffix}<M>{middle}"


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


@pytest.mark.parametrize("units", fim.UNITS)
def test_equals_code_points(spark, units):
    made = fim.transform(documents(spark, ROWS, clashing=True), fim.FimConfig(units=units))
    rows = [tuple(r) for r in made.collect()]
    wanted = [expected(*r, units) for r in ROWS]
    assert sorted(rows, key=key) == sorted(wanted, key=key)
    assert {r[2] for r in rows} == {"plain", "psm", "spm"}


def test_texts_are_rebuilt(spark):
    made = fim.transform(documents(spark, ROWS)).withColumn("text", fim.restored())
    assert sorted(r["text"] for r in made.collect()) == sorted(t or "" for _, t in ROWS)


def test_no_rows_and_rates(spark):
    assert fim.digests(fim.transform(documents(spark, []))).count() == 0
    docs = documents(spark, [r for r in ROWS if r[0] != 6])
    all_psm = fim.transform(docs, fim.FimConfig(rate=100, spm_rate=0))
    assert {r["form"] for r in all_psm.where("output <> ''").collect()} == {"psm"}
    with pytest.raises(ValueError):
        fim.FimConfig(units="bytes")


def test_any_partitioning(spark):
    docs = documents(spark, ROWS)
    one = fim.digests(fim.transform(docs.coalesce(1))).collect()
    many = fim.digests(fim.transform(docs.repartition(7))).collect()
    assert sorted(map(tuple, one), key=key) == sorted(map(tuple, many), key=key)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="a \n<é漢😀", max_size=12), max_size=6))
def test_index_equals_plain_counting(texts):
    data = "".join(texts).encode()
    index = fim.WideIndex(np.frombuffer(data, dtype=np.uint8))
    text = data.decode()
    starts = np.array([len(text[:i].encode()) for i in range(len(text) + 1)])
    assert index.bytes(np.arange(len(text) + 1)).tolist() == starts.tolist()
    assert index.chars(starts).tolist() == list(range(len(text) + 1))
    ends = np.cumsum([len(t.encode()) for t in texts], dtype=np.int64)
    begins = np.concatenate([[0], ends])[:-1].astype(np.int64)
    cutter = fim._Cutter(np.frombuffer(data, dtype=np.uint8), begins, ends, "words")
    for i, t in enumerate(texts):
        tokens = TOKEN.findall(t)
        assert cutter.number[i] == len(tokens)
        for k in range(len(tokens) + 1):
            units = np.minimum(np.full(len(texts), k), cutter.number)
            assert cutter.cut(units)[i] - begins[i] == len("".join(tokens[:k]).encode())
