"""Fitting ALS models and reading predictions, factors and recommendations."""

from __future__ import annotations

import threading
from collections.abc import Collection

from pyspark import StorageLevel
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.config import ALS_MIN_BLOCKS, AlsConfig, SkewConfig
from tastegrid.operators.als_blocks import ROWS, Start, factorise, prepare
from tastegrid.operators.scoring import top_items
from tastegrid.operators.skew import heavy_keys, salted_join
from tastegrid.sources.workspace import remove, shared_folder


def ratings(df: DataFrame) -> DataFrame:
    """The three columns a fit reads."""
    return df.select("user_id", "item_id", F.col("rating").cast("float").alias("rating"))


def _whole(name: str) -> Column:
    """An id as a 32-bit number; an error where it is none."""
    found = F.col(name).try_cast("int")
    wrong = found.isNull() | (found.cast("double") != F.col(name).cast("double"))
    shown = F.coalesce(F.col(name).cast("string"), F.lit("null"))
    message = F.concat(F.lit(f"{name} must be a 32-bit whole number and not null, but is "), shown)
    return F.when(wrong, F.raise_error(message)).otherwise(found).alias(name)


class Ratings:
    """Ratings that one fit or several read: checked and stored once.

    The blocks and the first factors of a rank do not depend on the other settings, so all fits of the
    rank share them; ``forget`` gives them back, and ``close`` gives back everything.
    """

    def __init__(self, train: DataFrame) -> None:
        self.plain = ratings(train)
        none = F.col("rating").isNull() | F.isnan("rating")
        rating = F.when(none, F.raise_error(F.lit("a rating must not be null or NaN"))).otherwise(F.col("rating"))
        checked = self.plain.select(_whole("user_id"), _whole("item_id"), rating.alias("rating"))
        self.rows = checked.persist(StorageLevel.MEMORY_AND_DISK)
        self._lock = threading.Lock()
        self._starts: dict[tuple[int, int, int], Start | None] = {}

    def start(self, als: ALS) -> Start | None:
        """What fits of this rank begin with; None if Python cannot use the shared folder."""
        key = (als.getRank(), als.getNumUserBlocks(), als.getSeed())
        with self._lock:
            if key not in self._starts:
                # The first factors follow from the ids of the users alone.
                one = self.rows.groupBy("user_id").agg(F.min("item_id").alias("item_id"), F.min("rating").alias("rating"))
                first = als.copy({als.maxIter: 0}).fit(one)
                self._starts[key] = prepare(self.rows, first.userFactors, als.getRank())
                release(first)
            return self._starts[key]

    def forget(self, but: Collection[int] = ()) -> None:
        """Give back what belongs to other ranks; no fit of them may be running."""
        for key in [k for k in self._starts if k[0] not in but]:
            start = self._starts.pop(key)
            if start is not None:
                start.close()

    def close(self) -> None:
        self.forget()
        self.rows.unpersist()


def fit_als(train: DataFrame | Ratings, cfg: AlsConfig = AlsConfig()) -> ALSModel:
    """Explicit-feedback ALS; rows with unseen users or items get no prediction.

    Spark ML gives the factors of the users to begin with, which follow from the seed and the number
    of blocks, and takes the fitted ones as its model. The iterations are those of ``als_blocks``, with
    the equations of Spark ML; its own solver goes on where Python cannot use the shared folder.
    The number of blocks follows the cluster and is at least 10 for users and for items.
    """
    if not isinstance(train, Ratings):
        kept = Ratings(train)
        try:
            return fit_als(kept, cfg)
        finally:
            kept.close()
    spark = train.plain.sparkSession
    shared_folder(spark)
    blocks = cfg.blocks or max(ALS_MIN_BLOCKS, spark.sparkContext.defaultParallelism)
    als = ALS(
        userCol="user_id",
        itemCol="item_id",
        ratingCol="rating",
        rank=cfg.rank,
        regParam=cfg.reg_param,
        maxIter=cfg.max_iter,
        numUserBlocks=blocks,
        numItemBlocks=blocks,
        seed=cfg.seed,
        coldStartStrategy="drop",
        checkpointInterval=cfg.checkpoint_interval,
        intermediateStorageLevel=cfg.storage_level,
        finalStorageLevel=cfg.storage_level,
    )
    if cfg.max_iter == 0:
        return als.fit(train.plain)
    start = train.start(als)
    if start is None:
        return als.fit(train.rows)
    stored = factorise(start, cfg.reg_param, cfg.max_iter)
    factors = [spark.read.schema(ROWS).parquet(path)._jdf for path in stored]
    made = als._copyValues(ALSModel(spark._jvm.org.apache.spark.ml.recommendation.ALSModel(als.uid, cfg.rank, *factors)))
    made._transfer_params_to_java()
    made.stored_factors = stored
    return made


def predict(model: ALSModel, df: DataFrame, skew: SkewConfig = SkewConfig()) -> DataFrame:
    """Rows with known user and item, with ``prediction``, the product of their factors.

    Rows of a heavy user or item are spread over several tasks, which get a copy of its factors
    each; all others are joined as usual. The product is summed in doubles, in one expression. Rows
    without user or item, or with one that the model does not know, give none.
    """
    found = df
    for key, factors, name in (("user_id", model.userFactors, "_u"), ("item_id", model.itemFactors, "_i")):
        known = factors.select(F.col("id").alias(key), F.col("features").alias(name))
        found = salted_join(found, known, "inner", heavy_keys(df, [key], skew))
    products = F.zip_with("_u", "_i", lambda u, i: u.cast("double") * i)
    value = F.aggregate(products, F.lit(0.0), lambda total, x: total + x).cast("float")
    return found.withColumn("prediction", value).drop("_u", "_i").where(~F.isnan("prediction"))


def release(model: ALSModel) -> None:
    """Give back the storage of the factors; the model cannot be used afterwards.

    Those of ``fit_als`` are files. Where the solver of Spark ML made them, they are stored below the
    frames of the model, so the stored data is looked for in their lineage, by the names that the
    fit gives it. The inputs of the fit stay.
    """
    paths = getattr(model, "stored_factors", ())
    for path in paths:
        remove(model.userFactors.sparkSession, path)
    if paths:
        return
    seen: set[int] = set()
    open_ = [f._jdf.queryExecution().toRdd() for f in (model.userFactors, model.itemFactors)]
    while open_:
        data = open_.pop()
        if data.id() in seen:
            continue
        seen.add(data.id())
        level = data.getStorageLevel()
        if (level.useMemory() or level.useDisk()) and "Factors" in (data.name() or ""):
            data.unpersist(False)
        above = data.dependencies()
        open_.extend(above.apply(i).rdd() for i in range(above.size()))


def item_factors(model: ALSModel) -> DataFrame:
    return model.itemFactors


def recommend(model: ALSModel, users: DataFrame, k: int) -> DataFrame:
    """The k best of all items for each of the given users that the model knows."""
    wanted = users.select("user_id").distinct()
    known = model.userFactors.join(wanted, F.col("id") == F.col("user_id"), "left_semi")
    return top_items(known, model.itemFactors, k, score_type="FLOAT")
