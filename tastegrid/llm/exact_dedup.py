"""Exact dedup by deterministic block naming.

Normalised texts are cut into blocks of a fixed number of bytes. Different blocks are
sorted and get integer names; then adjacent names of a document are paired, different
pairs are sorted and named again, until each document has one name. Two documents have
the same level and name exactly if their normalised texts are identical: names are given
to contents, a hash only finds the name of a block again, and hash values that stand for
two contents are looked up by content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.shelf import Shelf
from tastegrid.operators.skew import expand_copies

BLOCK_BYTES = 4096
NO_PARTNER = -1
ROW = ("doc_id", "text_sha256")


def normalised(text: Column) -> Column:
    """Null counts as empty; every run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _blocks(text: Column, size: int) -> Column:
    """Consecutive blocks of ``size`` bytes; an empty text has one empty block."""
    raw = F.encode(text, "UTF-8")
    last = F.greatest(F.ceil(F.octet_length(text) / size) - 1, F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * size + 1, size))


def _named(distinct: DataFrame, order: list[str]) -> DataFrame:
    """Integer names in sort order; each partition of the distinct contents has its range."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def _same_row(left: DataFrame, right: DataFrame) -> Column:
    one, two = ROW
    return left[one].eqNullSafe(right[one]) & (left[two] == right[two])


def identities(
    docs: DataFrame, shelf: Shelf, block_bytes: int = BLOCK_BYTES, hash_bits: int = 64
) -> DataFrame:
    """``doc_id, text_sha256, level, name``: one row per different (doc_id, text).

    ``hash_bits`` below 64 only exists to test equal hashes of different blocks.
    """
    text = normalised(F.col("text"))
    cut = (
        docs.select("doc_id", text.alias("_text"))
        .select(
            "doc_id",
            F.sha2("_text", 256).alias("text_sha256"),
            F.posexplode(_blocks(F.col("_text"), block_bytes)).alias("pos", "block"),
        )
        .withColumn("key", F.shiftrightunsigned(F.xxhash64("block"), 64 - hash_bits))
    )
    contents = cut.groupBy("key", "block").agg(F.count(F.lit(1)).alias("n"))
    names = shelf.put("block-names", _named(contents, ["key", "block"]).select("key", "name"))
    shared = names.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    places = cut.drop("block")
    if shared.isEmpty():
        found = places.join(names, "key")
    else:
        # Negative names for the blocks that share a hash value, joined by their content.
        hard = cut.join(shared, "key", "left_semi")
        exact = _named(hard.select("key", "block").distinct(), ["key", "block"])
        found = (
            places.join(shared, "key", "left_anti").join(names, "key").select(*places.columns, "name")
        ).unionByName(
            hard.join(exact.withColumn("name", -1 - F.col("name")), ["key", "block"]).select(
                *places.columns, "name"
            )
        )
    state = shelf.put(
        "names-0", found.groupBy(*ROW, "pos").agg(F.min("name").alias("name"))
    )
    shelf.drop("block-names")
    longest = state.agg(F.max("pos")).first()[0]
    levels = 0 if longest is None else longest.bit_length()
    done = []
    for level in range(levels + 1):
        alone = state.groupBy(*ROW).agg(F.max("pos").alias("last"), F.min("name").alias("name"))
        alone = alone.where("last = 0").select(*ROW, F.lit(level).alias("level"), "name")
        done.append(shelf.put(f"whole-{level}", alone))
        if level == levels:
            break
        state = _pair(state, done[-1], level, shelf)
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole


def _pair(state: DataFrame, whole: DataFrame, level: int, shelf: Shelf) -> DataFrame:
    """The names of one level to those of the next, for documents not yet whole."""
    rest = state.join(whole, _same_row(state, whole), "left_anti")
    first = F.col("pos") % 2 == 0
    pairs = (
        rest.groupBy(*ROW, F.floor(F.col("pos") / 2).cast("int").alias("half"))
        .agg(
            F.min(F.when(first, F.col("name"))).alias("a"),
            F.coalesce(F.min(F.when(~first, F.col("name"))), F.lit(None).cast("bigint")).alias("b"),
        )
        .withColumn("odd", F.col("b").isNull())
        .withColumn("b", F.coalesce("b", F.lit(NO_PARTNER).cast("bigint")))
        .withColumnRenamed("half", "pos")
    )
    pairs = shelf.put(f"pairs-{level}", pairs)
    names = shelf.put(
        f"pair-names-{level}", _named(pairs.select("a", "b", "odd").distinct(), ["a", "b", "odd"])
    )
    after = pairs.join(names, ["a", "b", "odd"]).select(*ROW, "pos", "name")
    after = shelf.put(f"names-{level + 1}", after)
    shelf.drop(f"names-{level}", f"pairs-{level}", f"pair-names-{level}")
    return after


def exact_groups(
    docs: DataFrame, block_bytes: int = BLOCK_BYTES, hash_bits: int = 64
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the smallest ``doc_id`` stays. A null text is the empty
    text, which is equal to other empty texts only (white space alone is one space). Rows
    that repeat both doc_id and text count in ``group_size``, and one of them is kept. Rows
    without doc_id join their group but stay only where no row of it has one; ``keep_id`` is
    then null. Only ``doc_id`` and ``text`` are read. No rows give no rows.
    """
    shelf = Shelf(docs.sparkSession)
    whole = identities(docs, shelf, block_bytes, hash_bits)
    rows = docs.select("doc_id", F.sha2(normalised(F.col("text")), 256).alias("text_sha256"))
    rows = rows.groupBy(*ROW).agg(F.count(F.lit(1)).alias("copies"))
    members = whole.join(rows, _same_row(whole, rows)).select(
        whole["doc_id"], whole["text_sha256"], "level", "name", "copies"
    )
    members = shelf.put("members", members)
    groups = members.groupBy("level", "name").agg(
        F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")
    )
    groups = shelf.put("groups", groups)
    one = members.join(groups, ["level", "name"])
    first = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    kept = one.withColumn("kept", first).select(*columns)
    again = expand_copies(
        one.withColumn("copies", F.col("copies") - 1).withColumn("kept", F.lit(False)).select(
            *columns, "copies"
        ),
        "copies",
    )
    return kept.unionByName(again)


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns in their order."""
    staying = exact_groups(docs).where("kept").select(*ROW)
    # Whole rows as one column: no name of theirs can clash with one used here.
    marked = docs.select(
        "doc_id", F.sha2(normalised(F.col("text")), 256).alias("text_sha256"), F.struct("*").alias("row")
    )
    twice = marked.groupBy(*ROW).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    left = marked.join(staying, _same_row(marked, staying), "left_semi")
    if not twice.isEmpty():
        left = left.dropDuplicates(list(ROW))
    return left.select("row.*")
