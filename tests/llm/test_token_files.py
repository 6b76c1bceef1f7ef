import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tastegrid.llm import coder, tokens
from tastegrid.llm.coder import BLOCK_IDS, Pieces, decode_blocks, encode_blocks, read_segment, write_segment
from tastegrid.llm.token_files import crc32_of_both, read, round_trip, write
from tests.llm.tables import LONG, documents

FILE = public_tokenizers.path("byte_bpe_50k.json")


def one_document(ids):
    return Pieces(*(np.array([x]) for x in (1, 1, len(ids), 0, len(ids))))


@pytest.mark.parametrize("size", [0, 1, 5, BLOCK_IDS - 1, BLOCK_IDS, BLOCK_IDS + 1, 3 * BLOCK_IDS])
@pytest.mark.parametrize("kind", ["same", "skewed", "even", "ends"])
def test_segments_come_back(size, kind):
    draw = np.random.RandomState(size)
    ids = {"same": np.full(size, 65535), "skewed": draw.zipf(1.3, size) % 50_000, "even": draw.randint(0, 65536, size),
           "ends": draw.choice([0, 65535], size)}[kind]
    pieces, back = read_segment(write_segment(one_document(ids), ids))
    assert back.tolist() == ids.tolist() and pieces.size.tolist() == [size]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 65535), max_size=300))
def test_any_ids_come_back(ids):
    ids = np.array(ids, dtype=np.int64)
    assert decode_blocks(encode_blocks(ids), [len(ids)] if len(ids) else []).tolist() == ids.tolist()


def test_repeating_ids_get_small_and_wrong_ids_are_errors():
    ids = np.tile(np.arange(50), 400)
    assert len(write_segment(one_document(ids), ids)) < len(ids) / 4
    for bad in ([-1], [1 << 32]):
        with pytest.raises(ValueError):
            encode_blocks(np.array(bad))


@settings(max_examples=20, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, (1 << 32) - 1)), max_size=300))
def test_wide_ids_come_back(ids):
    ids = np.array(ids, dtype=np.int64)
    assert decode_blocks(encode_blocks(ids), [len(ids)] if len(ids) else []).tolist() == ids.tolist()


def test_narrow_and_wide_blocks_side_by_side():
    draw = np.random.RandomState(3)
    ids = np.concatenate([draw.randint(0, 900, BLOCK_IDS), draw.randint(0, 1 << 31, BLOCK_IDS), draw.randint(0, 70_000, 900)])
    assert read_segment(write_segment(one_document(ids), ids))[1].tolist() == ids.tolist()


def order_0_bits(ids):
    """Adaptive counts of ids, reset with each block; a new id is an escape and 16 plain bits."""
    bits, counts = 0.0, {}
    for i, x in enumerate(ids.tolist()):
        if i % BLOCK_IDS == 0:
            counts, seen = {}, 0
        total = seen + max(len(counts), 1)
        bits += np.log2(total / counts[x]) if x in counts else np.log2(total / max(len(counts), 1)) + 16
        counts[x] = counts.get(x, 0) + 1
        seen += 1
    return bits


def test_mixed_orders_need_fewer_bits_than_order_0():
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()
    found = Tokenizer.from_file(FILE).encode_batch([t or "" for t in texts], add_special_tokens=False)
    ids = np.concatenate([np.array(e.ids, dtype=np.int64) for e in found])
    assert 32 * sum(map(len, encode_blocks(ids))) < 0.99 * order_0_bits(ids) < 10 * len(ids)


def test_a_repeated_context_predicts():
    """A pair that is always followed by the same id costs less than order 0 can know."""
    draw = np.random.RandomState(5)
    after = draw.permutation(200)
    ids = np.empty(BLOCK_IDS, dtype=np.int64)
    ids[0::2] = draw.randint(0, 200, BLOCK_IDS // 2)
    ids[1::2] = 200 + after[ids[0::2]]
    assert 32 * len(encode_blocks(ids)[0]) < 0.8 * order_0_bits(ids)


def test_blocks_are_independent_and_damage_is_found():
    draw = np.random.RandomState(1)
    ids = draw.randint(0, 500, 2 * BLOCK_IDS)
    apart = [encode_blocks(ids[:BLOCK_IDS])[0], encode_blocks(ids[BLOCK_IDS:])[0]]
    assert [b.tolist() for b in encode_blocks(ids)] == [b.tolist() for b in apart]
    data = bytearray(write_segment(one_document(ids), ids))
    data[-40] ^= 1
    with pytest.raises(ValueError):
        read_segment(bytes(data))


def test_checksums_of_parts_make_the_whole():
    draw = random.Random(2)
    for _ in range(20):
        a, b = draw.randbytes(draw.randrange(60)), draw.randbytes(draw.randrange(3000))
        assert crc32_of_both(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


ROWS = [(7, "beta gamma"), (3, None), (5, ""), (-2, "alpha <|endoftext|> !"), (9, LONG[:30_000]), (4, "same"), (4, "same"), (None, "no id")]


@pytest.mark.parametrize("segment", [1 << 23, 5000])
def test_round_trip_equals_plain_encoding(spark, tmp_path, segment):
    plain = Tokenizer.from_file(FILE)
    expected, at = [], 0
    for doc_id, text in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        expected.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    found = round_trip(documents(spark, ROWS, clashing=True), str(tmp_path / "ids"), FILE, segment)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)


def test_no_rows(spark, tmp_path):
    write(documents(spark, []), str(tmp_path / "none"), FILE)
    assert read(spark, str(tmp_path / "none")).count() == 0


def test_order_and_rows_do_not_depend_on_partitioning(spark):
    rows = [(None, f"no id {i}") for i in range(40)] + [(5, f"same id {i}") for i in range(40)] + [(i, "t") for i in range(9)]
    shuffled = rows[::-1]

    def found(df, label):
        made = round_trip(df, f"{spark.conf.get('spark.checkpoint.dir')}/{label}-{random.random()}", FILE, 64)
        return sorted((tuple(r) for r in made.collect()), key=str)

    one = found(documents(spark, rows).coalesce(1), "one")
    many = found(documents(spark, shuffled).repartition(7), "many")
    assert one == many and len(one) == len(rows)


def test_rows_without_id_take_several_ranges(spark, tmp_path):
    rows = [(None, f"no id {i} {i * i}") for i in range(400)]
    small = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(small, "false")
    try:
        write(documents(spark, rows).repartition(4), str(tmp_path / "set"), FILE)
    finally:
        spark.conf.unset(small)
    assert spark.read.parquet(str(tmp_path / "set")).select("part").distinct().count() > 1


def test_words_stay_in_the_worker_within_a_bound(monkeypatch):
    import sys

    import pyarrow as pa

    from tastegrid.llm import tokens

    monkeypatch.setitem(sys.modules, tokens._HOME, __import__("types").ModuleType(tokens._HOME))
    texts = pa.array(["some words here", "some more words here, again.", LONG[:5000]])
    first = tokens.WordEncoder(FILE)
    ids, ends = first.encode(texts)
    again = tokens.WordEncoder(FILE)
    assert again.known is first.known and len(again.known) > 10
    asked = []
    monkeypatch.setattr(tokens.WordEncoder, "_plain", lambda self, pieces: asked.append(pieces) or [b""] * len(pieces))
    again._ids_of(["words", "some"])
    assert asked == [[]]
    monkeypatch.undo()
    monkeypatch.setitem(sys.modules, tokens._HOME, __import__("types").ModuleType(tokens._HOME))
    monkeypatch.setattr(tokens, "KEPT_BYTES", 500)
    small = tokens.WordEncoder(FILE)
    same, places = small.encode(texts)
    assert same.tolist() == ids.tolist() and places.tolist() == ends.tolist()
    assert len(small.known) <= 4


def test_the_format_stays():
    draw = np.random.RandomState(11)
    ids = np.concatenate([draw.zipf(1.3, 5000) % 50_000, draw.randint(0, 1 << 31, 300)])
    assert zlib.crc32(b"".join(w.tobytes() for w in encode_blocks(ids))) == 2215621936


def test_blocks_of_any_sizes_side_by_side_equal_each_alone():
    draw = np.random.RandomState(6)
    sizes = [700, BLOCK_IDS, 1, 64, BLOCK_IDS, 65, 700]
    parts = [draw.randint(0, (1 << 32) if i == 3 else 900, n) for i, n in enumerate(sizes)]
    side_by_side = encode_blocks(np.concatenate(parts), sizes)
    assert [w.tolist() for w in side_by_side] == [encode_blocks(p)[0].tolist() for p in parts]
    assert decode_blocks(side_by_side, sizes).tolist() == np.concatenate(parts).tolist()


def test_segments_of_a_task_are_coded_in_one_call(monkeypatch):
    draw = np.random.RandomState(7)
    parts = [(one_document(ids), ids) for ids in (draw.randint(0, 500, n) for n in (900, 0, 2 * BLOCK_IDS + 5))]
    alone = [write_segment(*p) for p in parts]
    calls, plain = [], coder.decode_blocks
    monkeypatch.setattr(coder, "decode_blocks", lambda *a: calls.append(1) or plain(*a))
    assert coder.write_segments(parts) == alone
    assert [ids.tolist() for _, ids in coder.read_segments(alone)] == [ids.tolist() for _, ids in parts]
    assert len(calls) == 1
    assert coder.write_segments([]) == [] and coder.read_segments([]) == []


def test_new_words_are_encoded_many_at_a_time(monkeypatch):
    import sys
    import types

    import pyarrow as pa

    monkeypatch.setitem(sys.modules, tokens._HOME, types.ModuleType(tokens._HOME))
    odd = ["<|endoftext|>", "a<|endoftext|>b", "x\n", "\ty", "in\nside", "\u00a0nb\u00a0", "it's", "'s", "\u0120x", "9,9.", "\u4e2d\u6587", "\x1f", "", "e\u0301"]
    words = [f"w{i}q{'z' * (i % 7)}" for i in range(500)] + odd
    encoder, asked = tokens.WordEncoder(FILE), []
    plain = encoder._plain
    monkeypatch.setattr(encoder, "_plain", lambda pieces: asked.extend(pieces) or plain(pieces))
    assert encoder._ids_of(words) == plain([" " + w for w in words])
    assert len(asked) < 30
    text = " ".join(words + words[::-1])
    for kind in (pa.string(), pa.large_string()):
        found, _ = encoder.encode(pa.array([text], kind))
        assert found.tolist() == Tokenizer.from_file(FILE).encode(text, add_special_tokens=False).ids
