"""Mixing sources to target weights by Poisson replication.

The mean repetition rate of a source is its target share of the budget over its size. Each
row draws a uniform number from a hash of seed and doc_id, the Poisson distribution with
that mean is inverted at it, and the row is exploded by the count. All copies then go
through one global shuffle in the order of a hash. Where doc_id does not tell a row from
others, its content and a running number of full copies take the place of doc_id.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.functions.hashing import digest
from tastegrid.llm.numbering import numbered
from tastegrid.llm.shelf import Shelf

# A Poisson draw with a larger mean is the sum of draws with at most this mean.
PIECE_MEAN = 16.0
DRAW_DIGITS = 13
# Copies of one row that one step makes; more go through a second step.
COPIES_AT_ONCE = 1024


@dataclass(frozen=True)
class Mixture:
    """Target weights of named sources, and of all other sources together.

    The others, rows without source among them, keep their shares among each other.
    ``budget`` is the size of the mixture in characters; the default is that of the input.
    """

    weights: Mapping[str, float]
    rest: float
    seed: int = 1
    budget: float | None = None

    def __post_init__(self) -> None:
        shares = [*self.weights.values(), self.rest]
        if min(shares) < 0 or not sum(shares) > 0:
            raise ValueError("weights must not be negative, and one must be positive")


def rates(docs: DataFrame, mix: Mixture) -> tuple[dict[str, float], float]:
    """Mean repetition rate of each named source, and that of all others.

    A source without text cannot be repeated to a weight; its rate is 0.
    """
    named = F.when(F.col("source").isin(list(mix.weights)), F.col("source")) if mix.weights else F.lit(None).cast("string")
    sizes = docs.groupBy(named.alias("name")).agg(F.sum(F.length("text").cast("bigint")).alias("size"))
    found = {r["name"]: r["size"] or 0 for r in sizes.collect()}
    budget = mix.budget if mix.budget is not None else sum(found.values())
    total = sum(mix.weights.values()) + mix.rest

    def rate(weight: float, size: int) -> float:
        return weight / total * budget / size if size else 0.0

    return (
        {name: rate(w, found.get(name, 0)) for name, w in mix.weights.items()},
        rate(mix.rest, found.get(None, 0)),
    )


def thresholds(mean: float) -> list[float]:
    """The distribution function at 0, 1, 2, ... as far as a double can tell it from 1."""
    term, total, values, k = math.exp(-mean), 0.0, [], 0
    while True:
        total += term
        if values and total <= values[-1] and k > mean:
            return values
        values.append(total)
        k += 1
        term = term * mean / k


def uniform(purpose: str, seed: int, *keys: str | Column) -> Column:
    """A number in [0, 1) with 52 bits, from the hash of the keys."""
    bits = F.conv(F.substring(digest(purpose, seed, list(keys)), 1, DRAW_DIGITS), 16, 10)
    return bits.cast("bigint") / F.lit(float(16**DRAW_DIGITS))


def _inverse(draw: Column, mean: float) -> Column:
    steps = F.array(*[F.lit(t) for t in thresholds(mean)])
    return F.size(F.filter(steps, lambda t: t <= draw)).cast("bigint")


def _count(mean: float, seed: int, key: str = "doc_id") -> Column:
    pieces = math.floor(mean / PIECE_MEAN)
    last = _inverse(uniform("mix", seed, key), mean - pieces * PIECE_MEAN)
    if not pieces:
        return last
    more = F.transform(
        F.sequence(F.lit(1), F.lit(pieces)),
        lambda i: _inverse(uniform("mix", seed, key, i), PIECE_MEAN),
    )
    return last + F.aggregate(more, F.lit(0).cast("bigint"), lambda total, n: total + n)


def repetitions(docs: DataFrame, mix: Mixture, key: str = "doc_id") -> Column:
    """How often each row of ``docs`` is taken; rows with one ``key`` share a draw."""
    by_name, rest = rates(docs, mix)
    count = _count(rest, mix.seed, key)
    for name, mean in by_name.items():
        count = F.when(F.col("source").eqNullSafe(F.lit(name)), _count(mean, mix.seed, key)).otherwise(count)
    return count


def _told_apart(docs: DataFrame, shelf: Shelf) -> DataFrame:
    """``docs`` with ``_row``, a key of its own for each row.

    It is the doc_id if no other row has it. Rows that repeat a doc_id or have none get a
    digest of doc_id, source and text and a running number of the rows equal in them. The
    number is the rows in earlier partitions and the place in the own one, so many copies of
    one row do not meet in a task; the numbers of equal rows are the same ones in any order.
    """
    with_id = docs.where("doc_id IS NOT NULL")
    ids = with_id.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id")
    ids = shelf.put("repeated-ids", ids)
    no_id, repeated = docs.where("doc_id IS NULL"), not ids.isEmpty()
    plain = with_id.join(ids, "doc_id", "left_anti") if repeated else with_id
    plain = plain.withColumn("_row", F.col("doc_id").cast("string"))
    if not repeated and no_id.isEmpty():
        return plain
    odd = no_id.unionByName(with_id.join(ids, "doc_id", "left_semi")) if repeated else no_id
    odd = odd.withColumn("_same", F.md5(F.to_json(F.struct("doc_id", "source", "text"))))
    odd = shelf.put("rows-told-apart", odd.withColumn("_part", F.spark_partition_id()))
    counts = odd.groupBy("_same", "_part").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("_same").orderBy("_part")
    before = counts.select("_same", "_part", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_same", "_part").orderBy("_same"))
    odd = odd.withColumn("_place", place).join(before, ["_same", "_part"])
    key = F.concat_ws(":", F.lit("row"), F.col("_same"), (F.col("_before") + F.col("_place")).cast("string"))
    return plain.unionByName(odd.select(*docs.columns, key.alias("_row")))


def _exploded(docs: DataFrame, mix: Mixture, copy: str) -> DataFrame:
    apart = _told_apart(docs, Shelf(docs.sparkSession))
    counted = apart.withColumn("_times", repetitions(docs, mix, "_row")).where("_times > 0")
    last = F.floor((F.col("_times") - 1) / COPIES_AT_ONCE)
    groups = counted.withColumn("_group", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    size = F.least(F.col("_times") - F.col("_group") * COPIES_AT_ONCE, F.lit(COPIES_AT_ONCE).cast("bigint"))
    step = groups.withColumn("_step", F.explode(F.sequence(F.lit(0).cast("bigint"), size - 1)))
    return step.withColumn(copy, F.col("_group") * COPIES_AT_ONCE + F.col("_step")).drop("_times", "_group", "_step")


def mixture(docs: DataFrame, mix: Mixture) -> DataFrame:
    """The mixture as ids: ``doc_id, source, copy, position``, one row per copy.

    ``copy`` counts the copies of a row from 0; ``position`` is the place in the global
    shuffle, a permutation of 0 .. rows - 1. Texts are read for their lengths,
    and to tell rows apart that repeat a doc_id or have none; null and
    empty texts have length 0 and are repeated like others of their source. Each row has a draw of
    its own, also rows that repeat a doc_id, have none or are full copies. No rows give no rows.
    """
    shelf = Shelf(docs.sparkSession)
    ids = docs.select(F.col("doc_id"), F.col("source"), "text")
    taken = _exploded(ids, mix, "copy").select("doc_id", "source", "_row", "copy")
    keyed = taken.withColumn("_key", digest("shuffle", mix.seed, ["_row", "copy"])).drop("_row")
    order = ["_key", "doc_id", "copy"]
    return numbered(keyed, order, shelf, "mixture", "position").drop("_key")


def mixed(docs: DataFrame, mix: Mixture) -> DataFrame:
    """The rows of the mixture themselves, with the columns of ``docs``, in shuffled order."""
    # Whole rows as one column: no name of theirs can clash with one used here.
    rows = docs.select("doc_id", "source", "text", F.struct("*").alias("row"))
    taken = _exploded(rows, mix, "copy").select("doc_id", "_row", "copy", "row")
    keyed = taken.withColumn("_key", digest("shuffle", mix.seed, ["_row", "copy"]))
    return keyed.repartitionByRange("_key", "doc_id").sortWithinPartitions("_key", "doc_id").select("row.*")
