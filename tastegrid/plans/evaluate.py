"""Scoring of a model against test rows, over several choices of candidates."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.recommendation import ALSModel
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tastegrid.config import EvalConfig, SkewConfig
from tastegrid.operators.als import predict, recommend
from tastegrid.operators.ranking import (
    label_counts,
    metric_means,
    place_candidates,
    ranking_metrics,
    rmse_of_pairs,
    user_metrics,
)
from tastegrid.operators.running import totals_before
from tastegrid.operators.skew import HeavyKeys, heavy_keys
from tastegrid.sources.by_user import UserTables
from tastegrid.sources.workspace import cut

# Which items stand in the list of a user:
#   test_rows     the user's own test rows, ordered by prediction
#   all_items     the best k of all items
#   unseen_items  those of the best k that the user has no training row for
#   recs_in_test  those of the best k that occur in the user's test rows
MODES = ("test_rows", "all_items", "unseen_items", "recs_in_test")

PAIR = ["user_id", "item_id"]
# Rows of all points in one partition of the lists of users, as long as no user has more.
ROWS_SORTED = 250_000


def _ids(entries: Column) -> Column:
    """Item ids of a list of (item_id, rating): the best rating first, then by item."""
    keyed = F.transform(entries, lambda x: F.struct(x["rating"].alias("rating"), (-x["item_id"].cast("bigint")).alias("id")))
    return F.transform(F.sort_array(keyed, asc=False), lambda x: -x["id"])


def _met(facts: DataFrame, lists: DataFrame) -> DataFrame:
    """The facts whose item stands in the list of their user, one row for each ``place`` there."""
    wide = facts.withColumn("item_id", F.col("item_id").cast("bigint"))
    # A merge join streams the facts past one list; no list is sent to the driver.
    both = wide.join(lists.hint("merge"), "user_id").where(F.array_contains("ids", F.col("item_id")))
    places = F.transform("ids", lambda x, i: F.when(x == F.col("item_id"), i.cast("bigint")))
    found = F.explode(F.filter(places, lambda p: p.isNotNull())).alias("place")
    return both.select(*facts.columns, found)


def _candidates_of_lists(lists: DataFrame, seen: DataFrame | None, pairs: DataFrame, cfg: EvalConfig) -> DataFrame:
    """Candidates out of ``lists`` (``user_id``, ``ids`` in list order) that decide a metric.

    These are the tested pairs with their place in the list. An item that is not tested only moves
    others down, so it is counted and makes no row. One more row per list, without item and
    never relevant, stands behind its end, so that a list without any tested item counts too.
    """
    if cfg.mode == "recs_in_test":
        tested = _met(pairs.select(*PAIR, "relevant", F.col("copies").alias("found")), lists)
        times = F.lit(1).cast("bigint") if cfg.dedup else F.col("found")
        rows = tested.select(*PAIR, "relevant", times.alias("copies"), "place")
        return totals_before(rows, ["user_id"], [F.col("place")], {"start": F.col("copies")}).drop("place")
    if cfg.mode == "unseen_items":
        lists = _with_gone(seen, lists)
    else:
        lists = lists.withColumn("gone", F.array().cast("array<bigint>"))
    # Lists are made once: what they meet and their ends come out of one join.
    tested = pairs.select("user_id", F.col("item_id").cast("bigint").alias("item_id"), "relevant")
    met = lists.join(tested.hint("merge"), "user_id", "left").select(
        *PAIR,
        "relevant",
        _places(F.col("ids"), F.col("item_id")).alias("places"),
        "gone",
        F.size("ids").cast("bigint").alias("end"),
    )
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("item_id")) == 1
    stay = F.filter("places", lambda p: ~F.array_contains("gone", p))
    inside = F.transform(stay, lambda p: _entry(F.col("item_id"), F.col("relevant"), p))
    behind = F.array(_entry(F.lit(None).cast("bigint"), F.lit(False), F.col("end")))
    found = F.concat(inside, F.when(F.col("_first"), behind).otherwise(F.slice(behind, 1, 0)))
    rows = met.withColumn("_first", first).select("user_id", "gone", F.inline(found))
    above = F.size(F.filter("gone", lambda p: p < F.col("place")))
    return rows.select(
        *PAIR, "relevant", F.lit(1).cast("bigint").alias("copies"), (F.col("place") - above).cast("bigint").alias("start")
    ).where("item_id IS NOT NULL OR start > 0")


def _entry(item: Column, relevant: Column, place: Column) -> Column:
    return F.struct(item.alias("item_id"), relevant.alias("relevant"), place.alias("place"))


def _places(ids: Column, item: Column) -> Column:
    """The places of the item in a list; most lists do not hold it."""
    places = F.filter(F.transform(ids, lambda x, i: F.when(x == item, i.cast("bigint"))), lambda p: p.isNotNull())
    return F.when(F.array_contains(ids, item), places).otherwise(F.array().cast("array<bigint>"))


def _with_gone(seen: DataFrame, lists: DataFrame) -> DataFrame:
    """The lists with the places of seen items, no more than a list is long."""
    known = seen.select("user_id", F.col("item_id").cast("bigint").alias("item_id"))
    met = lists.join(known.hint("merge"), "user_id", "left")
    places = met.select("user_id", "ids", _places(F.col("ids"), F.col("item_id")).alias("places"))
    gone = F.array_distinct(F.flatten(F.collect_list(F.when(F.size("places") > 0, F.col("places"))))).alias("gone")
    return places.groupBy("user_id").agg(F.first("ids").alias("ids"), gone)


def candidates_from_pairs(
    scored: DataFrame, cfg: EvalConfig, heavy: HeavyKeys | None = None
) -> DataFrame:
    """Candidates of the mode ``test_rows``: scored test pairs, cut at the top k."""
    cands = scored.select(*PAIR, "prediction", "copies", "relevant")
    if cfg.dedup:
        cands = cands.withColumn("copies", F.lit(1).cast("bigint"))
    return place_candidates(cands, cfg.k, cfg.ties, heavy)


def candidates_from_recs(
    recs: DataFrame, train: DataFrame | None, pairs: DataFrame, cfg: EvalConfig
) -> DataFrame:
    """Candidates of the other modes from recommendation lists."""
    if cfg.mode == "unseen_items" and train is None:
        raise ValueError("unseen_items needs the training rows")
    # A user has one list as a rule; entries of several are one list.
    pooled = recs.groupBy("user_id").agg(F.flatten(F.collect_list("recommendations")).alias("entries"))
    return _candidates_of_lists(pooled.select("user_id", _ids(F.col("entries")).alias("ids")), train, pairs, cfg)


@dataclass(frozen=True)
class UserFacts:
    """What evaluations read of the train and test rows, kept by user.

    ``pairs`` are the folded test rows of ``rated_pairs``, ``seen`` the distinct pairs of the train
    rows if the mode needs them, ``heavy`` the users whose pairs take several tasks.
    """

    tables: UserTables
    pairs: DataFrame
    seen: DataFrame | None
    heavy: HeavyKeys


def user_facts(
    tables: UserTables,
    train: DataFrame | None,
    pairs: DataFrame,
    cfg: EvalConfig,
    skew: SkewConfig = SkewConfig(),
) -> UserFacts:
    """Store the facts once; every evaluation then meets them without another shuffle."""
    kept = tables.put("pairs", pairs)
    seen = None
    if cfg.mode == "unseen_items":
        if train is None:
            raise ValueError("unseen_items needs the training rows")
        seen = tables.put("seen", train.select(*PAIR).distinct())
    return UserFacts(tables, kept, seen, heavy_keys(kept, ["user_id"], skew))


def candidates_by_user(recs: DataFrame, facts: UserFacts, cfg: EvalConfig) -> DataFrame:
    """The rows of ``candidates_from_recs`` over stored facts, where an item stands once in a list.

    The lists of the users, one row each, are the only thing that is shuffled. Lists, seen and tested
    pairs then lie in the same task by user.
    """
    if cfg.mode == "unseen_items" and facts.seen is None:
        raise ValueError("unseen_items needs the training rows")
    placed = facts.tables.place(recs)
    pooled = placed.groupBy("user_id").agg(F.flatten(F.collect_list("recommendations")).alias("entries"))
    lists = pooled.select("user_id", F.array_distinct(_ids(F.col("entries"))).alias("ids"))
    return _candidates_of_lists(lists, facts.seen, facts.pairs, cfg)


def evaluate(
    model: ALSModel,
    train: DataFrame | None,
    pairs: DataFrame,
    cfg: EvalConfig = EvalConfig(),
) -> DataFrame:
    """One row with ``rmse``, ``map``, ``precision_at_k``, ``ndcg_at_k`` and ``users``.

    ``pairs`` are the folded test rows of ``rated_pairs``. Precision and NDCG use
    ``cfg.k``; the RMSE covers all test rows with a prediction in every mode.
    """
    _known_mode(cfg)
    scored = predict(model, pairs)
    if cfg.mode == "test_rows":
        placed = candidates_from_pairs(scored, cfg)
    else:
        # Users without a relevant row count in no metric.
        recs = recommend(model, pairs.where("relevant").select("user_id"), cfg.k)
        placed = candidates_from_recs(recs, train, pairs, cfg)
    return _report(scored, placed, label_counts(pairs), cfg)


def measure(model: ALSModel, facts: UserFacts, cfg: EvalConfig = EvalConfig()) -> Row:
    """The row of ``evaluate`` over stored facts; the predictions are computed once for all metrics."""
    _known_mode(cfg)
    scored = predict(model, facts.pairs).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if cfg.mode == "test_rows":
            placed = candidates_from_pairs(scored, cfg, facts.heavy)
        else:
            recs = recommend(model, facts.pairs.where("relevant").select("user_id"), cfg.k)
            placed = candidates_by_user(recs, facts, cfg)
        return _report(scored, placed, label_counts(facts.pairs), cfg).first()
    finally:
        scored.unpersist()


def _known_mode(cfg: EvalConfig) -> None:
    if cfg.mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {cfg.mode!r}")


def _report(scored: DataFrame, placed: DataFrame, labels: DataFrame, cfg: EvalConfig) -> DataFrame:
    return _side_by_side(rmse_of_pairs(scored), ranking_metrics(placed, labels, cfg.k))


def _side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two one-row frames as one row."""
    both = left.unionByName(right, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def evaluate_scores(
    scored: DataFrame, cfg: EvalConfig = EvalConfig(), skew: SkewConfig | None = None
) -> DataFrame:
    """Ranking metrics of test rows that already carry a ``prediction``.

    A pair is relevant if any of its rows is, and it is one relevant item however many predictions
    it has. Rows without a user count nowhere. With ``skew`` the folded rows are stored, and users that are heavy by it take several
    tasks; without, each user is one task, and the rows are read and folded once.
    """
    if skew is None:
        return ranking_metrics(_points_placed(scored, ["prediction"], cfg), None, cfg.k)
    folded = cut(_marked(_folded(scored, ["prediction"], cfg), PAIR))
    heavy = heavy_keys(folded, ["user_id"], skew)
    return ranking_metrics(candidates_from_pairs(folded, cfg, heavy), label_counts(folded.where("label")), cfg.k)


def evaluate_points(
    scored: DataFrame, predictions: Sequence[str], cfg: EvalConfig = EvalConfig()
) -> DataFrame:
    """The metrics of several predictions in one pass: one row each, ``point`` from 0.

    ``predictions`` name the columns, one a point. The rows are read and folded once and dealt to
    users once; the points are stacked after that, as lists of (user, point).
    """
    users = user_metrics(_points_placed(scored, predictions, cfg), None, cfg.k, ("user_id", "point"))
    return users.groupBy("point").agg(*metric_means())


def _folded(scored: DataFrame, predictions: Sequence[str], cfg: EvalConfig) -> DataFrame:
    rated = F.coalesce(F.col("rating") >= cfg.min_rating, F.lit(False))
    return scored.groupBy(*PAIR, *predictions).agg(
        F.count(F.lit(1)).alias("copies"), F.max(rated).alias("relevant")
    )


def _marked(rows: DataFrame, pair: Sequence[str]) -> DataFrame:
    """``relevant`` if any row of the pair is, and ``label`` on the one row that stands for a relevant pair."""
    every = Window.partitionBy(*pair)
    relevant = F.max("relevant").over(every)
    first = F.row_number().over(every.orderBy("prediction")) == 1
    return rows.withColumns({"relevant": relevant, "label": relevant & first})


def _points_placed(scored: DataFrame, predictions: Sequence[str], cfg: EvalConfig) -> DataFrame:
    """Candidates of all points with ``labels``, the number of relevant items of the user."""
    known = scored.where(F.col("user_id").isNotNull())
    # Several sorts of a partition are held at once, so their number follows the rows.
    rows = known.select("user_id").count() * len(predictions)
    least = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    folded = _folded(known, predictions, cfg).repartition(max(least, math.ceil(rows / ROWS_SORTED)), "user_id")
    stacked = F.inline(
        F.array(*[F.struct(F.lit(i).alias("point"), F.col(p).alias("prediction")) for i, p in enumerate(predictions)])
    )
    rows = folded.select(*PAIR, "copies", "relevant", stacked)
    by = ("user_id", "point")
    # Rows of one pair that differ in another point only are one candidate in this one.
    once = rows.groupBy(*PAIR, "point", "prediction").agg(
        F.sum("copies").alias("copies"), F.max("relevant").alias("relevant")
    )
    marked = _marked(once, (*PAIR, "point"))
    counted = marked.withColumn("labels", F.count_if("label").over(Window.partitionBy(*by)))
    if cfg.dedup:
        counted = counted.withColumn("copies", F.lit(1).cast("bigint"))
    return place_candidates(counted.drop("label"), cfg.k, cfg.ties, by=by)
