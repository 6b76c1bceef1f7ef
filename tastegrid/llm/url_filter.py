"""URL filter by a cascade of Bloom filters.

A rule is a host and the beginning of a path. The keys of a URL are all rules that would fit
it; the universe is every key of the corpus. The first level of a cascade encodes the listed
keys, the next the keys of the universe that the first lets through wrongly, the next the
listed keys that this one takes for unlisted, and so on until none is left. Walking down the
levels then tells for every key of the universe exactly whether it is listed, without a join.

The first level is as tight as the share of listed keys asks for; all levels together take a
few bits for each rule and a logarithm of the universe, checked against ``max_bytes``.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.shelf import Shelf

# The functions below travel to the workers inside the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_LEVELS = 100


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, where the path begins with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    def __post_init__(self) -> None:
        if self.verdict not in (ALLOW, BLOCK):
            raise ValueError(f"unknown verdict {self.verdict!r}")
        if not self.path.startswith("/") or set(self.host) & set("/?#") or set(self.path) & set("?#"):
            raise ValueError(f"no rule: {self.host!r} {self.path!r}")

    @property
    def key(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """From the first ``://`` up to a slash, question mark, hash sign or the end; A-Z lowered."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to a question mark, hash sign or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The rules that would fit, longer hosts first, then longer paths; with two hashes each.

    Hosts with more labels than any rule has, and path lengths that no rule has, are left out:
    no rule can be among them.
    """
    labels = F.split(host, "\\.", -1)
    most = F.least(F.size(labels), F.lit(max(r.host.count(".") + 1 for r in rules)))
    hosts = F.transform(
        F.sequence(most, F.lit(1)), lambda n: F.array_join(F.slice(labels, -n, n), ".")
    )
    sizes = sorted({len(r.path) for r in rules}, reverse=True)
    fitting = F.filter(F.array(*map(F.lit, sizes)), lambda n: n <= F.length(path))
    paths = F.transform(fitting, lambda n: F.substring(path, F.lit(1), n))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))
    return F.transform(keys, hashed)


def hashed(key: Column) -> Column:
    return F.struct(
        key.alias("key"),
        F.xxhash64(key).alias("a"),
        F.xxhash64(F.lit("second"), key).alias("b"),
    )


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


@dataclass(frozen=True)
class Level:
    """One Bloom filter; its bits lie in 64-bit words."""

    number: int
    bits: int
    probes: int
    words: np.ndarray

    @staticmethod
    def shape(keys: int, rate: float) -> tuple[int, int]:
        """Bits and probes for a number of keys and a rate of false positives."""
        bits = max(64, math.ceil(-max(keys, 1) * math.log(rate) / math.log(2) ** 2))
        return 64 * math.ceil(bits / 64), max(1, round(-math.log2(rate)))

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return probe_places(self.number, self.bits, self.probes, a, b)

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        place = self.places(a, b)
        hit = (self.words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)
        return hit.astype(bool).all(axis=1)


def probe_places(number: int, bits: int, probes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bits of each key on one level; levels are independent of each other."""
    salt = np.uint64((number + 1) * 0x9E3779B97F4A7C15 % 2**64)
    one = _mixed(a.astype(np.uint64) ^ salt)
    two = _mixed(b.astype(np.uint64) + salt) | np.uint64(1)
    steps = np.arange(probes, dtype=np.uint64)
    return ((one[:, None] + steps * two[:, None]) % np.uint64(bits)).astype(np.int64)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each key is listed; exact for keys of the universe."""
        listed = np.zeros(len(a), dtype=bool)
        inside = np.arange(len(a))
        for level in self.levels:
            inside = inside[level.has(a[inside], b[inside])]
            listed[inside] = level.number % 2 == 0
        return listed


def _bits_job(number: int, bits: int, probes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_numpy() for c in "ab")
            place = np.unique(probe_places(number, bits, probes, a, b))
            mask = (np.uint64(1) << (place & 63).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place >> 6), pa.array(mask)], names=["word", "mask"])

    return run


def _pass_job(level: Level) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_numpy() for c in "ab")
            yield batch.filter(pa.array(level.has(a, b)))

    return run


def encode(keys: DataFrame, number: int, count: int, rate: float, max_bytes: int) -> Level:
    """A level that holds ``keys(key, a, b)``. Its words, not the keys, come to the driver."""
    bits, probes = Level.shape(count, rate)
    if bits // 8 > max_bytes:
        raise ValueError(f"a level of {bits // 8} bytes is larger than max_bytes={max_bytes}")
    marked = keys.select("a", "b").mapInArrow(_bits_job(number, bits, probes), "word BIGINT, mask BIGINT")
    words = np.zeros(bits // 64, dtype=np.int64)
    for row in marked.groupBy("word").agg(F.bit_or("mask").alias("mask")).collect():
        words[row["word"]] = row["mask"]
    return Level(number, bits, probes, words.view(np.uint64))


def build(universe: DataFrame, listed: DataFrame, shelf: Shelf, label: str, max_bytes: int) -> Cascade:
    """The cascade of ``listed`` over ``universe``, both tables of different ``key, a, b``.

    Listed keys outside the universe do no harm and are left out.
    """
    schema = "key STRING, a BIGINT, b BIGINT"
    inside = shelf.put(f"{label}-listed", listed.join(universe.select("key"), "key", "left_semi").select("key", "a", "b"))
    outside = universe.join(listed.select("key"), "key", "left_anti").select("key", "a", "b")
    r = inside.count()
    if not r:
        return Cascade(())
    s = max(universe.count() - r, 1)
    rate = min(0.5, max(r * math.sqrt(0.5) / s, 2.0**-60))
    levels: list[Level] = []
    holds, other, count = inside, outside, r
    while count:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("two keys cannot be told apart by their hashes")
        number = len(levels)
        level = encode(holds, number, count, rate if number == 0 else 0.5, max_bytes)
        levels.append(level)
        wrong = shelf.put(f"{label}-{number}", other.mapInArrow(_pass_job(level), schema))
        holds, other, count = wrong, holds, wrong.count()
    return Cascade(tuple(levels))


def _judge_job(cascades: dict[str, Cascade], default: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("keys")
            flat, ends = lists.flatten(), np.asarray(lists.offsets)
            ends = ends - ends[0]
            key, a, b = (flat.field(i) for i in range(3))
            a, b = a.to_numpy(), b.to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            size = np.asarray(pc.utf8_length(key), dtype=np.int64)
            verdict = np.full(len(a), None, dtype=object)
            for name, cascade in cascades.items():
                verdict[cascade.has(a, b)] = name
            hit = np.flatnonzero(verdict.astype(bool))
            # The longest key of each page; of equal ones the first, which has the longer host.
            hit = hit[np.lexsort((hit, -size[hit], owner[hit]))]
            pages, first = np.unique(owner[hit], return_index=True)
            chosen = np.full(batch.num_rows, -1)
            chosen[pages] = hit[first]
            found = chosen >= 0
            rule = key.take(pa.array(chosen, mask=~found))
            judged = [verdict[c] if ok else default for c, ok in zip(chosen, found)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "host", "path")), rule, pa.array(judged, pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return run


def judge(
    pages: DataFrame, rules: Sequence[Rule], default: str = ALLOW, max_bytes: int = 64 << 20
) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``.

    The longest rule that fits decides; of equally long ones that with the longer host. ``rule``
    is null where none fits, and the verdict is then ``default``. A null URL or one without
    ``://`` has empty host and path, which no rule fits. Rows that repeat are judged alike;
    page_id may be null. Only ``page_id`` and ``url`` are read. No rows give no rows.
    """
    if not rules or len({r.key for r in rules}) < len(rules):
        raise ValueError("rules must be there, and different")
    spark, shelf = pages.sparkSession, Shelf(pages.sparkSession)
    places = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    keyed = places.withColumn("keys", keys_of(F.col("host"), F.col("path"), rules))
    universe = shelf.put("universe", keyed.select(F.inline("keys")).distinct())
    table = spark.createDataFrame([(r.key, r.verdict) for r in rules], "key STRING, verdict STRING")
    table = table.select(hashed(F.col("key")).alias("k"), "verdict").select("k.*", "verdict")
    cascades = {
        name: build(universe, table.where(F.col("verdict") == name), shelf, name, max_bytes)
        for name in (ALLOW, BLOCK)
    }
    schema = "page_id BIGINT, host STRING, path STRING, rule STRING, verdict STRING"
    return keyed.mapInArrow(_judge_job(cascades, default), schema)
