"""Near-duplicate groups by HyperMinHash.

The hashed shingles of a text fall into 128 buckets. A bucket keeps, of its least hash, the
number of leading zeros and ten mantissa bits. Bands of four registers are the blocking
keys. Pairs that share a band are estimated with the expected number of register collisions
taken off, and those that may reach the threshold are confirmed on the full shingle sets.

Documents with equal sets are one class from the start. Classes that share bands are put into
stars, so that each two of one band share a star, while a class is in few stars and mostly in one.
In a star every class is compared with one pivot, the class that shares most bands with others; a
group of near copies is joined by that in one step, without its pairs. Where classes of a star
are left in different components, they are described by their differences from the shingles that most
of the star hold, and compared where these differences leave a link possible, so that no pair that
shares a band is left out.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.llm.components import components
from tastegrid.llm.shelf import Shelf
from tastegrid.llm.tokens import give_back, slices

# The functions below travel to the workers inside the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKET_BITS = 7
REGISTERS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
BAND = 4
# Pairs of one pivot that meet in one task.
PAIRS_PER_SALT = 64
# Characters whose words a task holds at a time.
TEXT_CHARS = 3_000_000
# Standard errors by which an estimate may fall short of the threshold.
ERRORS = 6.5

SKETCHES = "own_id BIGINT, doc_id BIGINT, n BIGINT, set_key BINARY, sketch ARRAY<BIGINT>"
SETS = "doc_id BIGINT, n BIGINT, set_key BINARY, shingles ARRAY<BIGINT>"


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _probe_order() -> np.ndarray:
    """For each bucket, the order in which it looks for a bucket that is not empty."""
    grid = np.arange(REGISTERS * REGISTERS, dtype=np.uint64)
    order = np.argsort(_mix(grid + np.uint64(1)).reshape(REGISTERS, -1), axis=1)
    return np.concatenate([np.arange(REGISTERS)[:, None], order], axis=1)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a batch, and where each text begins and ends in them.

    A-Z are lowered; words are runs of anything but ASCII white space.
    """
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, ends = words.flatten(), np.asarray(words.offsets)
    ends = ends - ends[0]
    real = np.asarray(pc.greater(pc.binary_length(flat), 0))
    place = np.concatenate([[0], np.cumsum(real)])
    coded = flat.filter(pa.array(real)).dictionary_encode()
    known = np.array(coded.dictionary.to_pylist(), dtype=object)
    hashes = pd.util.hash_array(known, categorize=False) if len(known) else np.empty(0, np.uint64)
    return hashes[np.asarray(coded.indices)], place[ends]


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A text of fewer words has one shingle, the whole sequence; one without words none.
    """
    hashes, ends = word_hashes(texts)

    def rolled(width: int) -> np.ndarray:
        last = len(hashes) - width + 1
        acc = np.full(max(last, 0), width, dtype=np.uint64)
        for j in range(width):
            acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + last])
        return acc

    by_width: dict[int, np.ndarray] = {}
    for start, end in zip(ends[:-1], ends[1:]):
        width = min(words, end - start)
        if width == 0:
            yield np.empty(0, np.uint64)
            continue
        if width not in by_width:
            by_width[width] = rolled(int(width))
        yield np.unique(by_width[width][start : end - width + 1])


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set of hashes."""
    parts = [_mix(shingles ^ np.uint64(salt)).sum(dtype=np.uint64) for salt in (0x5851F42D, 0x14057B7E)]
    return np.array(parts, dtype=">u8").tobytes()


def registers(shingles: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of the least hash in each bucket.

    ``shingles`` is sorted, so the first hash of a bucket is its least. An empty bucket takes
    the register of the first bucket in its own fixed probe order that is not empty.
    """
    buckets = (shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(buckets, prepend=-1))
    # 53 bits below the bucket bits: exact as a double, whose exponent tells the zeros.
    rest = ((shingles[first] << np.uint64(BUCKET_BITS)) >> np.uint64(11)).astype(np.float64)
    fraction, exponent = np.frexp(rest)
    zeros = np.where(rest > 0, 53 - exponent, 53)
    mantissa = np.where(rest > 0, (fraction - 0.5) * (2 << MANTISSA_BITS), 0).astype(np.int64)
    values = np.zeros(REGISTERS, dtype=np.int64)
    filled = np.zeros(REGISTERS, dtype=bool)
    values[buckets[first]] = (zeros.astype(np.int64) << MANTISSA_BITS) | mantissa
    filled[buckets[first]] = True
    if not filled.all():
        values = values[probes[np.arange(REGISTERS), filled[probes].argmax(axis=1)]]
    return values.astype("<u2")


def _sketcher(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = _probe_order()
        for batch in batches:
            texts = batch.column("text")
            sizes, keys, sketches = [], [], []
            for low, high in slices(texts, TEXT_CHARS):
                for shingles in shingle_sets(texts.slice(low, high - low), words):
                    sizes.append(len(shingles))
                    keys.append(set_key(shingles))
                    sketches.append(registers(shingles, probes).view("<i8") if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("own_id"),
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(sketches, pa.list_(pa.int64())),
                ],
                names=["own_id", "doc_id", "n", "set_key", "sketch"],
            )
            give_back()

    return run


def _setter(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column("text"), TEXT_CHARS):
                part = batch.slice(low, high - low)
                sets = list(shingle_sets(part.column("text"), words))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_key(s) for s in sets], pa.binary()),
                        pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n", "set_key", "shingles"],
                )
            give_back()

    return run


def equal_registers(one: Column, two: Column) -> Column:
    """How many of the registers, four to a number, are equal."""

    def lanes(x: Column) -> Column:
        zero = [F.shiftright(x, 16 * k).bitwiseAND(F.lit(0xFFFF)) == 0 for k in range(4)]
        return sum((z.cast("int") for z in zero[1:]), zero[0].cast("int"))

    same = F.zip_with(one, two, lambda x, y: lanes(x.bitwiseXOR(y)))
    return F.aggregate(same, F.lit(0), lambda total, x: total + x)


def collision_share(n: Column, m: Column) -> Column:
    """Expected share of registers that are equal by chance, for sets of n and m shingles.

    A register has z leading zeros if the least of n / 128 uniform numbers lies between
    2^-(z+1) and 2^-z; the mantissa then agrees in one of 2^10 cases.
    """

    def level(size: Column, z: Column) -> Column:
        mean = size / F.lit(float(REGISTERS))
        return F.exp(-mean * F.pow(F.lit(2.0), -z - 1)) - F.exp(-mean * F.pow(F.lit(2.0), -z))

    levels = F.sequence(F.lit(0), F.lit(48))
    both = F.aggregate(levels, F.lit(0.0), lambda total, z: total + level(n, z) * level(m, z))
    return both / F.lit(float(1 << MANTISSA_BITS))


def estimate(one: Column, two: Column, n: Column, m: Column) -> Column:
    """Collision-corrected Jaccard estimate of two sketches."""
    chance = collision_share(n, m)
    return (equal_registers(one, two) / F.lit(float(REGISTERS)) - chance) / (F.lit(1.0) - chance)


def _may_link(one: Column, two: Column, n: Column, m: Column, share: float) -> Column:
    small = F.least(n, m) / F.lit(float(REGISTERS))
    filled = F.lit(float(REGISTERS)) * (F.lit(1.0) - F.exp(-small))
    margin = F.lit(ERRORS * 0.5) / F.sqrt(F.greatest(filled, F.lit(1.0)))
    return estimate(one, two, n, m) >= F.lit(share) - margin


class _Search:
    """One run: the classes, their bands, and the links confirmed so far."""

    def __init__(self, docs: DataFrame, words: int, at_least: tuple[int, int]) -> None:
        self.docs, self.words, self.at_least = docs, words, at_least
        self.shelf = Shelf(docs.sparkSession)
        put = self.shelf.put
        found = docs.select("own_id", F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        sketches = put("sketches", found.mapInArrow(_sketcher(words), SKETCHES))
        self.members = sketches.select("own_id", "doc_id", "n", "set_key")
        self.classes = put(
            "classes",
            sketches.where("n > 0 AND doc_id IS NOT NULL")
            .groupBy("set_key", "n")
            .agg(F.min("doc_id").alias("rep"), F.any_value("sketch").alias("sketch"))
            .withColumn("cls", F.monotonically_increasing_id()),
        )
        entries = self.classes.select(
            "cls", "n", F.posexplode("sketch").alias("band", "registers")
        ).select("cls", "n", F.xxhash64("band", "registers").alias("bucket"))
        counts = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("width"))
        counts = put("counts", counts.where("width > 1"))
        self.active = put("active", entries.join(counts, "bucket"))
        self.shelf.drop("counts")

    def stars(self) -> DataFrame:
        """``star, x, y``: the classes of each star with its pivot, which is one of them.

        The widest bucket of a class is its home. A bucket belongs to the star of the home that most
        of its classes have; so all classes of a bucket are in one star, and a group whose members
        share most of their buckets is one star, not one for each bucket.
        """
        wide = F.struct("width", "bucket")
        homes = self.active.groupBy("cls").agg(F.max(wide).alias("home"), F.sum("width").alias("score"))
        named = self.shelf.put(
            "named", self.active.select("bucket", "cls").join(homes, "cls")
        )
        votes = named.groupBy("bucket", "home").agg(F.count(F.lit(1)).alias("votes"))
        chosen = votes.groupBy("bucket").agg(F.max(F.struct("votes", "home")).alias("best"))
        chosen = chosen.select("bucket", F.col("best.home.bucket").alias("star"))
        members = named.join(chosen, "bucket").groupBy("star", "cls").agg(F.max("score").alias("score"))
        members = self.shelf.put("star-members", members)
        best = members.groupBy("star").agg(F.max(F.struct("score", (-F.col("cls")).alias("low"))).alias("best"))
        pivot = best.select("star", (-F.col("best.low")).alias("y"))
        return members.join(pivot, "star").select("star", F.col("cls").alias("x"), "y")

    def store_sets(self) -> None:
        """The full sets of all classes that share a band with another class."""
        wanted = self.classes.join(
            self.active.select("cls").distinct(), "cls", "left_semi"
        ).select("cls", F.col("rep").alias("doc_id"), F.col("set_key").alias("key"))
        texts = self.docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        near = texts.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
        sets = near.mapInArrow(_setter(self.words), SETS)
        # The key matters where two rows with one doc_id have different texts.
        named = sets.join(
            wanted, (sets["doc_id"] == wanted["doc_id"]) & (sets["set_key"] == wanted["key"])
        )
        self.sets = self.shelf.put("sets", named.select("cls", "shingles").dropDuplicates(["cls"]))

    def _sizes(self, n: str, m: str) -> Column:
        """Sets so different in size cannot reach the threshold."""
        top, base = self.at_least
        return F.least(n, m) * base >= F.greatest(n, m) * top

    def confirm(self, pairs: DataFrame, label: str) -> DataFrame:
        """The links ``a, b`` among candidate pairs ``x, y``; a y may have very many x."""
        top, base = self.at_least
        small = self.classes.select("cls", "n", "sketch")
        one, two = (small.select(*[F.col(c).alias(c[0] + side) for c in small.columns]) for side in "xy")
        likely = (
            pairs.join(two.withColumnRenamed("cy", "y"), "y")
            .join(one.withColumnRenamed("cx", "x"), "x")
            .where(self._sizes("nx", "ny"))
            .where(_may_link(F.col("sx"), F.col("sy"), F.col("nx"), F.col("ny"), top / base))
        )
        likely = self.shelf.put(f"{label}-likely", likely.select("x", "y", "nx", "ny"))
        common = F.size(F.array_intersect("left", "right")).cast("bigint")
        both = self._meet(likely, label).withColumn("common", common)
        union = F.col("nx") + F.col("ny") - F.col("common")
        links = both.where(F.col("common") * base >= union * top)
        links = self.shelf.put(f"{label}-links", links.select(F.col("x").alias("a"), F.col("y").alias("b")))
        self.shelf.drop(f"{label}-likely", f"{label}-salts")
        return links

    def _meet(self, pairs: DataFrame, label: str) -> DataFrame:
        """Pairs ``x, y`` with both sets as ``left, right``; the pairs of one y are spread."""
        salts = self.shelf.put(
            f"{label}-salts",
            pairs.groupBy("y").agg(F.ceil(F.count(F.lit(1)) / PAIRS_PER_SALT).alias("salts")),
        )
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt")
        right = self.sets.withColumnsRenamed({"cls": "y", "shingles": "right"}).join(salts, "y")
        salt = F.pmod(F.xxhash64("x"), F.col("salts"))
        left = pairs.join(salts, "y").withColumn("salt", salt).drop("salts")
        left = left.join(self.sets.withColumnsRenamed({"cls": "x", "shingles": "left"}), "x")
        return left.join(right.select("y", "right", every), ["y", "salt"]).drop("salt")

    def _placed(self, df: DataFrame, comps: DataFrame) -> DataFrame:
        """``df`` with the component of its class x."""
        of = comps.select(F.col("node").alias("x"), F.col("component").alias("cx"))
        return df.join(of, "x", "left").withColumn("cx", F.coalesce("cx", "x"))

    def differences(self, stars: DataFrame, comps: DataFrame) -> DataFrame:
        """``star, x, n, d`` of the stars that hold several components.

        ``d`` are the shingles by which x differs from the core of its star, the shingles that more
        than half of its classes hold.
        """
        placed = self.shelf.put("placed-stars", self._placed(stars.select("star", "x"), comps))
        shape = placed.groupBy("star").agg(
            (F.min("cx") != F.max("cx")).alias("open"), F.count(F.lit(1)).alias("classes")
        )
        open_ = self.shelf.put("open-stars", shape.where("open").select("star", "classes"))
        members = self.shelf.put("open-members", placed.join(open_, "star").select("star", "x", "cx"))
        sets = members.join(self.sets.withColumnRenamed("cls", "x"), "x")
        held = sets.select("star", F.explode("shingles").alias("e")).groupBy("star", "e").agg(F.count(F.lit(1)).alias("held"))
        core = held.join(open_, "star").where(F.col("held") * 2 > F.col("classes"))
        core = core.groupBy("star").agg(F.collect_list("e").alias("core"))
        core = open_.join(core, "star", "left").withColumn("core", F.coalesce("core", F.array().cast("array<bigint>")))
        # A star may have very many classes, so they are dealt over salts.
        salts = core.withColumn("salts", F.ceil(F.col("classes") / PAIRS_PER_SALT))
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt")
        core = salts.select("star", "core", every)
        salted = sets.join(salts.select("star", "salts"), "star")
        salted = salted.withColumn("salt", F.pmod(F.xxhash64("x"), F.col("salts")))
        met = salted.join(core, ["star", "salt"])
        apart = F.concat(F.array_except("shingles", "core"), F.array_except("core", "shingles"))
        return self.shelf.put(
            "differ", met.select("star", "x", "cx", F.size("shingles").cast("bigint").alias("n"), apart.alias("d"))
        )

    def _term(self) -> Column:
        """How far a class is from the core, in whole numbers; see ``leftovers``."""
        top, base = self.at_least
        return (base + top) * F.size("d").cast("bigint") - (base - top) * F.col("n")

    def near_core(self, differ: DataFrame) -> DataFrame:
        """Links ``a, b`` that follow from the distances to the core alone: none is counted out."""
        terms = differ.select("star", "x", self._term().alias("term"))
        least = terms.groupBy("star").agg(F.min(F.struct("term", "x")).alias("least"))
        met = terms.join(least, "star").where(F.col("term") + F.col("least.term") <= 0)
        return met.where(F.col("x") != F.col("least.x")).select(F.col("least.x").alias("a"), F.col("x").alias("b"))

    def leftovers(self, differ: DataFrame, comps: DataFrame) -> DataFrame:
        """Pairs ``x, y`` of one star that lie in different components and may be linked.

        Let D be the shingles by which a class differs from the core of the star, and c the number
        that the D of two classes X and Z have in common. They differ in |D_X| + |D_Z| - 2c shingles; a
        threshold p / q allows them (q - p) (|X| + |Z|) / (q + p). With the term T = (q + p) |D| - (q - p) |X|
        that asks for 2 (q + p) c >= T_X + T_Z. Where the terms add up to 0 or less, so do those of either
        with the least term of the star, and both are linked to that class by ``near_core``. So the pairs
        left need c >= 1, and in one order of the shingles, the rarest first, D_X and D_Z meet in their
        first |D| - c + 1. A shingle at place r of D_X can be that one for a Z with a term of
        2 (q + p) (|D_X| - r + 1) - T_X at most, its limit here, and the other way round.

        Near copies of one text differ from the core in places of their own: far from it they need
        more in common than their few common differences, near it they are linked already. Only classes
        in between, that share a rare difference, meet here.
        """
        top, base = self.at_least
        placed = self._placed(differ.drop("cx"), comps)
        rows = placed.select("star", "x", "cx", "n", F.size("d").alias("size"), self._term().alias("term"), F.explode("d").alias("e"))
        rows = self.shelf.put("differ-rows", rows)
        known = rows.groupBy("star", "e").agg(
            F.count(F.lit(1)).alias("df"), F.min("cx").alias("low"), F.max("cx").alias("high")
        )
        known = self.shelf.put("known", known.where("df > 1").select("star", "e", "df", (F.col("low") != F.col("high")).alias("mixed")))
        shared = rows.join(known, ["star", "e"])
        by_class = Window.partitionBy("star", "x")
        alone = F.col("size") - F.count(F.lit(1)).over(by_class)
        place = alone + F.row_number().over(by_class.orderBy("df", "e"))
        limit = 2 * (base + top) * (F.col("size") - place + 1) - F.col("term")
        rare = shared.withColumn("limit", limit).where("mixed").drop("size", "df", "mixed")
        for _ in range(2):
            # What no class at this shingle can reach, or be reached by, meets nobody here.
            here = Window.partitionBy("star", "e")
            rare = rare.withColumns({"low": F.min("term").over(here), "high": F.max("limit").over(here)})
            rare = rare.where("limit >= low AND term <= high").drop("low", "high")
        rare = self.shelf.put("rare", rare)
        other = rare.select("star", "e", *[F.col(c).alias(f"{c}_") for c in ("x", "cx", "n", "term", "limit")])
        near = (
            (rare["star"] == other["star"])
            & (rare["e"] == other["e"])
            & (F.col("x") < F.col("x_"))
            & (F.col("cx") != F.col("cx_"))
            & (F.col("term_") <= F.col("limit"))
            & (F.col("term") <= F.col("limit_"))
            & self._sizes("n", "n_")
        )
        return rare.join(other, near).select("x", F.col("x_").alias("y")).distinct()

    def same_ids(self) -> DataFrame:
        """Links between the classes of rows that share a doc_id."""
        of = self.members.join(self.classes.select("set_key", "n", "cls"), ["set_key", "n"]).where("doc_id IS NOT NULL")
        least = of.groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("top"))
        least = least.where("a < top")
        return of.join(least, "doc_id").where("cls != a").select("a", F.col("cls").alias("b"))


def _joined(comps: DataFrame, links: DataFrame, shelf: Shelf, label: str) -> DataFrame:
    """Components after more links."""
    if links.isEmpty():
        return comps
    known = comps.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return shelf.put(f"{label}-comps", components(known.unionByName(links), shelf, label))


def _search(docs: DataFrame, words: int, at_least: tuple[int, int]) -> tuple[_Search, DataFrame]:
    """The classes of a table, and the components of linked ones as ``node, component``.

    ``doc_id`` names nodes; ``own_id`` goes along with the members.
    """
    run = _Search(docs, words, at_least)
    run.store_sets()
    stars = run.shelf.put("stars", run.stars())
    pairs = stars.where("x != y").select("x", "y").distinct()
    links = run.confirm(pairs, "pivot").unionByName(run.same_ids())
    comps = run.shelf.put("first-comps", components(links, run.shelf, "first"))
    differ = run.differences(stars, comps)
    comps = _joined(comps, run.shelf.put("core-links", run.near_core(differ)), run.shelf, "core")
    comps = _joined(comps, run.confirm(run.leftovers(differ, comps), "rest"), run.shelf, "last")
    used = ("sets", "active", "named", "star-members", "stars", "placed-stars", "open-stars", "open-members")
    run.shelf.drop(*used, "differ", "differ-rows", "known", "rare", "core-links")
    return run, comps


def near_groups(
    docs: DataFrame, words: int = 5, at_least: tuple[int, int] = (4, 5)
) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked if the Jaccard similarity of their sets of word shingles is at least
    ``at_least`` (a fraction); ``component_id`` is the smallest doc_id that links reach, and a
    row is kept if that is its own. Texts without words, null or empty, link with nothing.
    Rows that repeat a doc_id are one node, whatever their texts. A row without doc_id cannot
    name a group: it links nothing, its component is null, and it is kept. Only ``doc_id`` and
    ``text`` are read. No rows give no rows.

    Sets are held as 64-bit hashes. A pair at the threshold shares none of the 32 bands with
    probability (1 - s^4)^32: 6e-11 at 0.85, 5e-8 at 0.8.
    """
    named = docs.select(F.lit(None).cast("bigint").alias("own_id"), "doc_id", "text")
    run, comps = _search(named, words, at_least)
    placed = run.classes.select("set_key", "n", "cls", "rep").join(
        comps.withColumnRenamed("node", "cls"), "cls", "left"
    )
    placed = run.shelf.put(
        "placed-classes",
        placed.select("set_key", "n", "rep", F.coalesce("component", "cls").alias("component")),
    )
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = run.shelf.put(
        "class-components", placed.join(least, "component").select("set_key", "n", "component_id")
    )
    named = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return run.members.join(ids, ["set_key", "n"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        named.alias("component_id"),
        named.eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, words: int = 5, at_least: tuple[int, int] = (4, 5)) -> DataFrame:
    """The rows that stay, with all their columns in their order: one of each group of near copies.

    Rows are judged by their texts alone, whatever their ids: of each component of linked sets the
    row with the smallest doc_id stays, one without doc_id only where no row has one. Rows that
    repeat are near copies of each other. Rows without words, null or empty, all stay. Columns may
    have any names; no rows give no rows.
    """
    shelf = Shelf(docs.sparkSession)
    # Whole rows as one column: no name of theirs can clash with one used here.
    rows = docs.select(F.struct("*").alias("row")).withColumn("doc_id", F.monotonically_increasing_id())
    rows = shelf.put("near-rows", rows)
    own = F.col("row.doc_id").cast("bigint").alias("own_id")
    run, comps = _search(rows.select(own, "doc_id", F.col("row.text").alias("text")), words, at_least)
    classes = run.classes.select("set_key", "n", "cls").join(comps.withColumnRenamed("node", "cls"), "cls", "left")
    classes = classes.select("set_key", "n", F.coalesce("component", "cls").alias("component"))
    known = run.members.where("n > 0").join(classes, ["set_key", "n"])
    order = F.struct(F.col("own_id").isNull().alias("unnamed"), "own_id", "doc_id")
    first = known.groupBy("component").agg(F.min(order).alias("first"))
    kept = first.select(F.col("first.doc_id").alias("doc_id"))
    kept = run.members.where("n = 0").select("doc_id").unionByName(kept)
    return rows.join(kept, "doc_id", "left_semi").select("row.*")
