"""Deterministic split of interactions into train, validation and test rows.

Users are counted once, and every decision about a user (active, sampled, which
part, where the user's rows start in the shuffled order) is made in that small table.
The interactions then pass through a single shuffle, by user, that both attaches the
decision and numbers the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tastegrid.config import SplitConfig
from tastegrid.functions.hashing import digest, draw, threshold
from tastegrid.operators.interactions import distinct_items, user_counts, warm_items
from tastegrid.operators.ordinals import (
    BUCKET,
    DIGEST,
    hash_bucket,
    key_offsets,
    rows_before,
)
from tastegrid.operators.skew import (
    SALTS,
    HeavyKeys,
    copies,
    expand_copies,
    heavy_from_counts,
    heavy_keys,
)
from tastegrid.sources.files import read_parquet, write_parquet
from tastegrid.sources.workspace import cut

TRAIN, VAL, TEST = "train", "val", "test"
COPIES = "_copies"


def sample_users(users: DataFrame, percent: float, seed: int) -> DataFrame:
    """A seeded share of the users; 100 keeps everyone."""
    if percent == 100:
        return users
    return users.where(draw("sample", seed, ["user_id"]) < threshold(percent / 100))


def split_users(users: DataFrame, weights: tuple[float, ...], seed: int) -> DataFrame:
    """Add ``part``: train, val or test for each user."""
    whole = sum(weights)
    u = draw("split", seed, ["user_id"])
    return users.withColumn(
        "part",
        F.when(u < threshold(weights[0] / whole), TRAIN)
        .when(u < threshold((weights[0] + weights[1]) / whole), VAL)
        .otherwise(TEST),
    )


def user_plan(df: DataFrame, cfg: SplitConfig) -> DataFrame:
    """Active, sampled users with their number of rows ``n`` and their ``part``.

    Stored once: it is far smaller than the rows, and several later steps read it.
    """
    active = user_counts(df.select("user_id").dropna(), cfg.min_interactions)
    chosen = sample_users(active, cfg.percent, cfg.sample_seed)
    return cut(split_users(chosen, cfg.weights, cfg.split_seed))


@dataclass(frozen=True)
class _Layout:
    """Rows with their bucket, and the table that tells where each bucket starts."""

    rows: DataFrame
    starts: DataFrame
    weight: Column
    keys: list[str]


def _layout(df: DataFrame, users: DataFrame, cfg: SplitConfig) -> _Layout:
    if cfg.row_key is None:
        keys, rows, weight = df.columns, copies(df, df.columns, COPIES), F.col(COPIES)
    else:
        keys, rows, weight = list(cfg.row_key), df, F.lit(1).cast("bigint")
    offsets = key_offsets(users, "part", "user_id", cfg.skew.rows_per_task)
    heavy = heavy_from_counts(users, ["user_id"], cfg.skew)
    if not heavy:
        rows = rows.withColumn(BUCKET, F.lit(0).cast("bigint"))
        starts = offsets.withColumn(BUCKET, F.lit(0).cast("bigint"))
    else:
        rows = _bucketed(rows, heavy, digest("shuffle", cfg.shuffle_seed, keys))
        starts = _bucket_starts(rows, offsets, heavy, weight)
    return _Layout(rows, starts.select("user_id", BUCKET, "part", "before"), weight, keys)


def _bucketed(rows: DataFrame, heavy: HeavyKeys, hashed: Column) -> DataFrame:
    """Rows of heavy users fall into hash ranges, those of all others into bucket 0."""
    bits = F.ceil(F.log2(F.col(SALTS))).cast("int")
    bucket = F.when(F.col(SALTS).isNull(), 0).otherwise(hash_bucket(hashed, bits))
    hot = heavy.broadcast(rows)
    return (
        rows.join(hot, "user_id", "left").withColumn(BUCKET, bucket.cast("bigint")).drop(SALTS)
    )


def _bucket_starts(
    rows: DataFrame, offsets: DataFrame, heavy: HeavyKeys, weight: Column
) -> DataFrame:
    """One row per light user and one per bucket of a heavy user."""
    hot_rows, _ = heavy.divide(rows)
    hot_users, light = heavy.divide(offsets)
    inside = rows_before(
        hot_rows.groupBy("user_id", BUCKET).agg(F.sum(weight).alias("n")), ["user_id"], [BUCKET]
    ).select("user_id", BUCKET, F.col("before").alias("_inside"))
    hot = hot_users.join(inside, "user_id").withColumn("before", F.col("before") + F.col("_inside"))
    columns = ["user_id", BUCKET, "part", "before"]
    return (
        light.withColumn(BUCKET, F.lit(0).cast("bigint"))
        .select(*columns)
        .unionByName(hot.select(*columns))
    )


def ordinals(df: DataFrame, users: DataFrame, cfg: SplitConfig) -> DataFrame:
    """Rows of the planned users with ``part`` and ``ordinal``.

    The ordinal is the place among all rows of the same part, sorted by user and then
    by a seeded hash. Identical rows stay folded in ``_copies`` when no row key is
    given; they take the places from ``ordinal`` on.
    """
    layout = _layout(df, users, cfg)
    # Rows with equal keys go by their other columns: then only full copies can tie, and
    # it makes no difference which of those goes first.
    others = [F.col(f"`{c}`") for c in df.columns if c not in layout.keys]
    earlier = (
        Window.partitionBy("user_id", BUCKET)
        .orderBy(DIGEST, *layout.keys, *others)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    place = F.coalesce(F.sum(layout.weight).over(earlier), F.lit(0))
    kept = [F.col(f"`{c}`") for c in layout.rows.columns if c != BUCKET]
    return (
        layout.rows.join(layout.starts, ["user_id", BUCKET])
        .withColumn(DIGEST, digest("shuffle", cfg.shuffle_seed, layout.keys))
        .withColumn("ordinal", F.col("before") + place)
        .select(*kept, "part", "ordinal")
    )


def assign_parts(df: DataFrame, cfg: SplitConfig, users: DataFrame | None = None) -> DataFrame:
    """All rows of the chosen users, each labeled train, val or test.

    Validation and test users give the rows with an even ordinal to train, so the
    halves of one user differ by at most one row. Items unseen in train are still in.
    """
    placed = ordinals(df, user_plan(df, cfg) if users is None else users, cfg)
    rows = [F.col(f"`{c}`") for c in df.columns]
    even = (F.col("part") != TRAIN) & (F.col("ordinal") % 2 == 0)
    if cfg.row_key is not None:
        return placed.select(*rows, F.when(even, TRAIN).otherwise(F.col("part")).alias("part"))
    n = F.col(COPIES)
    evens = F.floor((n + F.when(F.col("ordinal") % 2 == 0, 1).otherwise(0)) / 2).cast("bigint")
    to_train = F.when(F.col("part") == TRAIN, n).otherwise(evens)
    shares = F.array(
        F.struct(F.lit(TRAIN).alias("part"), to_train.alias(COPIES)),
        F.struct(F.col("part"), (n - to_train).alias(COPIES)),
    )
    labeled = placed.select(*rows, F.inline(shares))
    return expand_copies(labeled.where(n > 0), COPIES)


def halves(df: DataFrame, cfg: SplitConfig) -> DataFrame:
    """Every row with its ``half`` (0 or 1) after the shuffle within users."""
    everyone = cut(user_counts(df.select("user_id").dropna()).withColumn("part", F.lit(VAL)))
    labeled = assign_parts(df, cfg, everyone)
    half = F.when(F.col("part") == TRAIN, 0).otherwise(1)
    return labeled.withColumn("half", half).drop("part")


def merge_train(train: DataFrame, *more: DataFrame) -> DataFrame:
    """Training rows from several frames, matched by column name, duplicates kept."""
    merged = train
    for df in more:
        merged = merged.unionByName(df)
    return merged


def keep_warm(
    labeled: DataFrame, heavy_items: HeavyKeys, train_items: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, val and test frames; val and test keep only items that train has."""
    train = labeled.where(F.col("part") == TRAIN).drop("part")
    known = train if train_items is None else train_items
    val, test = (
        warm_items(labeled.where(F.col("part") == part).drop("part"), known, heavy_items)
        for part in (VAL, TEST)
    )
    return train, val, test


def store_labeled(df: DataFrame, cfg: SplitConfig, path: str) -> DataFrame:
    """The labeled rows as a Parquet table with one folder per part.

    A step that reads one part or one column afterwards touches only that, and the
    split itself runs once.
    """
    write_parquet(assign_parts(df, cfg), path, ["part"])
    stored = read_parquet(df.sparkSession, path)
    return stored.select(*[F.col(f"`{c}`") for c in df.columns], "part")


def split_interactions(
    df: DataFrame, cfg: SplitConfig = SplitConfig(), store: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, val and test with the schema of the input.

    The frames are lazy. With a ``store`` path the labeled rows are written there first
    and all three frames read from it, the way to go when more than one is used. The
    items of train are then collected once, from one column of the stored table.
    """
    if store is None:
        return keep_warm(assign_parts(df, cfg), heavy_keys(df, ["item_id"], cfg.skew))
    labeled = store_labeled(df, cfg, store)
    heavy_items = heavy_keys(labeled.where(F.col("part") != TRAIN), ["item_id"], cfg.skew)
    train_items = cut(distinct_items(labeled.where(F.col("part") == TRAIN)))
    return keep_warm(labeled, heavy_items, train_items)
