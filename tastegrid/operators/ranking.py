"""Top-k, ordered lists and ranking metrics.

The metrics work on rows, not on one array per user: a candidate carries the place in
its user's list and the number of copies that stand there side by side. A user is
never gathered into a single value, however many rows the user has.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.config import MIN_RELEVANT_RATING, SkewConfig
from tastegrid.operators.running import totals_before
from tastegrid.operators.skew import HeavyKeys, copies, heavy_keys, salted_join

# Copies of one candidate that are added up one by one; beyond, the rest of the
# harmonic sum has a closed form that is exact to double precision.
SUMMED_COPIES = 4096
# Copies of one row that one step spreads out.
COPIES_AT_ONCE = 10_000


def top_k_per_user(
    df: DataFrame,
    k: int,
    ties: str = "rank",
    tie_break: Sequence[str] = ("item_id",),
    skew: SkewConfig = SkewConfig(),
) -> DataFrame:
    """Rows with the ``k`` best predictions of each user, with their ``rank``.

    ``ties="rank"`` keeps all rows tied with the k-th, ``"row_number"`` exactly k. Each
    task drops what cannot be in the result before the shuffle. With ``"rank"`` a heavy
    user may be tied without bound, so heavy users take another road: ranks come from
    counts per prediction, at most k a user, and are joined back to salted rows.
    """
    if ties == "row_number":
        order = [F.desc("prediction"), *tie_break]
        return _best_rows(df, k, F.row_number(), order)
    if ties != "rank":
        raise ValueError(f"ties must be 'rank' or 'row_number', not {ties!r}")
    heavy = heavy_keys(df, ["user_id"], skew)
    if not heavy:
        return _best_rows(df, k, F.rank(), [F.desc("prediction")])
    hot, cold = heavy.divide(df)
    levels = copies(hot, ["user_id", "prediction"], "n")
    best = _best_rows(levels, k, F.row_number(), [F.desc("prediction")]).drop("rank")
    above = (
        Window.partitionBy("user_id")
        .orderBy(F.desc("prediction"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ranks = best.withColumn(
        "rank", (F.coalesce(F.sum("n").over(above), F.lit(0)) + 1).cast("int")
    ).where(F.col("rank") <= k)
    found = salted_join(hot, ranks.drop("n"), "inner", heavy, on=["user_id", "prediction"])
    return _best_rows(cold, k, F.rank(), [F.desc("prediction")]).unionByName(found)


def _best_rows(
    df: DataFrame, k: int, number: Column, order: list, by: Sequence[str] = ("user_id",)
) -> DataFrame:
    place = number.over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", place).where(F.col("rank") <= k)


def place_candidates(
    cands: DataFrame,
    k: int | None = None,
    ties: str = "rank",
    heavy: HeavyKeys | None = None,
    by: Sequence[str] = ("user_id",),
    among: Column | None = None,
) -> DataFrame:
    """Add ``start``: the 0-based place of a candidate in its user's list.

    Candidates are unique per user, item and prediction and carry ``copies``. The list
    runs from the best prediction down, then by item. With ``k`` only the top is kept,
    tied candidates included unless ``ties="row_number"``; ``among`` limits that to some lists. A
    ``relevant`` flag gives ``hits``, the relevant rows on earlier places. The rows of ``heavy`` users are
    cut into ranges of their lists, so one user takes several tasks.
    """
    order = [F.desc("prediction"), F.col("item_id")]
    if k is not None and not heavy and among is None:
        # A candidate stands for at least one row, so fewer than k candidates above
        # it are necessary to stay. This cut happens before the shuffle.
        cands = _best_rows(cands, k, F.rank(), order[:1], by).drop("rank")
    totals = {"start": F.col("copies")}
    if "relevant" in cands.columns:
        totals["hits"] = F.when(F.col("relevant"), F.col("copies")).otherwise(0)
    run = F.col("prediction") if k is not None and ties != "row_number" else None
    placed = totals_before(cands, by, order, totals, run, heavy)
    if k is None:
        return placed
    every = F.lit(False) if among is None else ~among
    if ties == "row_number":
        left = F.lit(k) - F.col("start")
        return placed.where(every | (left > 0)).withColumn(
            "copies", F.when(every, F.col("copies")).otherwise(F.least("copies", left))
        )
    # Where a run of equal predictions begins is the number of better ones.
    return placed.where(every | (F.col("run_start") < k)).drop("run_start")


def ordered_places(placed: DataFrame) -> DataFrame:
    """``user_id, place, item_id``: the list of each user, one row per place from 0.

    The form for lists of any length: repeated rows take one place each, and nothing is
    gathered.
    """
    numbered = placed.select("user_id", "item_id", "start", "copies").withColumn("_n", F.col("copies"))
    step = F.lit(COPIES_AT_ONCE).cast("bigint")
    groups = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / step)))
    spread = numbered.withColumn("_group", groups)
    inside = F.sequence(
        F.lit(0).cast("bigint"), F.least(F.col("_n") - F.col("_group") * step, step) - 1
    )
    rows = spread.withColumn("_step", F.explode(inside))
    place = F.col("start") + F.col("_group") * step + F.col("_step")
    return rows.select("user_id", place.cast("bigint").alias("place"), "item_id")


def ordered_lists(placed: DataFrame, limit: int, name: str = "item_ids") -> DataFrame:
    """Item ids of each user in list order, as arrays of at most ``limit`` ids.

    The caller names the limit: a longer list goes on in rows with ``part`` 1, 2, ..., so no
    value grows with the number of rows of one user. ``ordered_places`` has no such parts.
    The parts of a user are built in different tasks.
    """
    spread = _pieces(placed, limit).repartition("user_id", "part")
    return spread.groupBy("user_id", "part").agg(_joined_pieces(F.col("piece")).alias(name))


def _pieces(placed: DataFrame, limit: int, keep: Sequence[str] = ()) -> DataFrame:
    """The share of each candidate in each part of its list, as ``piece``: begin, item and times."""
    first = F.floor(F.col("start") / limit).cast("bigint")
    last = F.floor((F.col("start") + F.col("copies") - 1) / limit).cast("bigint")
    parts = placed.select(
        "user_id", *keep, "item_id", "start", "copies", F.explode(F.sequence(first, last)).alias("part")
    )
    begin = F.greatest(F.col("start"), F.col("part") * limit)
    end = F.least(F.col("start") + F.col("copies"), (F.col("part") + 1) * limit)
    piece = F.struct(begin.alias("begin"), "item_id", (end - begin).cast("int").alias("times"))
    return parts.select("user_id", *keep, "part", piece.alias("piece"))


def _joined_pieces(piece: Column) -> Column:
    """Item ids of one part in list order."""
    ordered = F.array_sort(F.collect_list(piece))
    return F.flatten(F.transform(ordered, lambda p: F.array_repeat(p["item_id"], p["times"])))


def ordered_predictions(
    df: DataFrame, limit: int, k: int | None = None, ties: str = "rank"
) -> DataFrame:
    """Item ids by descending prediction, then item; repeated rows stay repeated."""
    cands = copies(df, ["user_id", "item_id", "prediction"])
    return ordered_lists(place_candidates(cands, k, ties), limit)


def relevant_items(rows: DataFrame, limit: int) -> DataFrame:
    """Item ids of each user in ascending order; repeated rows stay repeated."""
    cands = copies(rows, ["user_id", "item_id"]).withColumn("prediction", F.lit(0))
    return ordered_lists(place_candidates(cands), limit)


def ranking_pairs(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    """Predicted and relevant lists of the users that have both, side by side.

    Where one list has more parts than the other, the missing parts are empty.
    """
    pred = predicted.select("user_id", "part", F.col("item_ids").alias("predicted"))
    label = labels.select("user_id", "part", F.col("item_ids").alias("relevant"))
    both = pred.where("part = 0").select("user_id").join(
        label.where("part = 0").select("user_id"), "user_id"
    )
    empty = F.array().cast(pred.schema["predicted"].dataType)
    return (
        pred.join(label, ["user_id", "part"], "full")
        .join(both, "user_id", "left_semi")
        .select(
            "user_id",
            "part",
            F.coalesce("predicted", empty).alias("predicted"),
            F.coalesce("relevant", empty).alias("relevant"),
        )
    )


def pairs_in_one_pass(
    rows: DataFrame,
    limit: int,
    k: int | None = None,
    ties: str = "rank",
    min_rating: int = MIN_RELEVANT_RATING,
) -> DataFrame:
    """The rows of ``ranking_pairs`` from rows with prediction and rating, read and grouped once.

    Rows are folded, and each folded row stands in the list of predictions and, where it is liked, in that of
    relevant items. Both lists are placed side by side, users with one list go, and the
    parts of both are put together in one grouping. Rows that are kept by user need no shuffle
    before that last one; a missing part is empty.
    """
    liked = F.coalesce(F.col("rating") >= min_rating, F.lit(False))
    kind = rows.schema["prediction"].dataType
    folded = rows.groupBy("user_id", "item_id", "prediction").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(liked).alias("liked")
    )
    # Relevant items go by item alone.
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("prediction"), F.col("n").alias("copies")),
        F.struct(F.lit(1).alias("side"), F.lit(0).cast(kind).alias("prediction"), F.col("liked").alias("copies")),
    )
    tagged = folded.select("user_id", "item_id", F.inline(sides)).where("copies > 0")
    both = Window.partitionBy("user_id")
    known = tagged.withColumn("_both", F.max("side").over(both) > F.min("side").over(both)).where("_both").drop("_both")
    placed = place_candidates(known, k, ties, by=("user_id", "side"), among=F.col("side") == 0)
    pieces = _pieces(placed, limit, ["side"]).repartition("user_id", "part")
    return pieces.groupBy("user_id", "part").agg(
        *[
            _joined_pieces(F.when(F.col("side") == side, F.col("piece"))).alias(name)
            for side, name in enumerate(("predicted", "relevant"))
        ]
    )


def label_counts(pairs: DataFrame) -> DataFrame:
    """Number of distinct relevant items per user, users without any left out."""
    return pairs.where("relevant").groupBy("user_id").agg(F.count(F.lit(1)).alias("labels"))


def _discounts(k: int) -> list[float]:
    """``totals[n]``: sum of the discounts ``1 / ln(i + 2)`` of the first n places."""
    totals = [0.0]
    for i in range(k):
        totals.append(totals[-1] + 1 / math.log(i + 2))
    return totals


def _precision_sum(hits: Column, start: Column, n: Column) -> Column:
    """Precision summed over ``n`` adjacent hits after ``hits`` earlier ones."""
    one = (hits + 1) / (start + 1)
    summed = F.aggregate(
        F.sequence(F.lit(1).cast("bigint"), F.least(n, F.lit(SUMMED_COPIES).cast("bigint"))),
        F.lit(0.0),
        lambda total, j: total + (hits + j) / (start + j),
    )

    def harmonic(x: Column) -> Column:
        return F.log(x) + 1 / (2 * x) - 1 / (12 * x * x)

    a = (start + SUMMED_COPIES).cast("double")
    b = (start + n).cast("double")
    rest = (b - a) + (hits - start) * (harmonic(b) - harmonic(a))
    return F.when(n == 1, one).when(n <= SUMMED_COPIES, summed).otherwise(summed + rest)


def user_metrics(
    placed: DataFrame, labels: DataFrame | None, k: int, by: Sequence[str] = ("user_id",)
) -> DataFrame:
    """Average precision, precision at k and NDCG at k of each user with both lists.

    ``placed`` has ``start``, ``copies`` and ``relevant`` per candidate, and ``hits`` if they are known;
    ``labels`` has the number of relevant items, or is None if each candidate carries it. Average
    precision looks at the whole list; precision at k divides by k even if the list is shorter.
    """
    if "hits" not in placed.columns:
        hit = F.when(F.col("relevant"), F.col("copies")).otherwise(0)
        placed = totals_before(placed, by, [F.col("start")], {"hits": hit})
    n, start = F.col("copies"), F.col("start")
    totals = F.lit(_discounts(k))
    inside = F.greatest(F.lit(0), F.least(start + n, F.lit(k)) - start)
    gain = F.get(totals, F.least(start + n, F.lit(k)).cast("int")) - F.get(
        totals, F.least(start, F.lit(k)).cast("int")
    )
    is_hit = F.col("relevant")
    sums = [
        F.sum(F.when(is_hit, _precision_sum(F.col("hits"), start, n)).otherwise(0.0)).alias("_ap"),
        F.sum(F.when(is_hit, inside).otherwise(0)).alias("_inside"),
        F.sum(F.when(is_hit, gain).otherwise(0.0)).alias("_gain"),
    ]
    if labels is None:
        summed = placed.groupBy(*by).agg(*sums, F.max("labels").alias("labels")).where("labels > 0")
    else:
        summed = placed.groupBy(*by).agg(*sums).join(labels, list(by))
    ideal = F.get(totals, F.least(F.col("labels"), F.lit(k)).cast("int"))
    return summed.select(
        *by,
        (F.col("_ap") / F.col("labels")).alias("average_precision"),
        (F.col("_inside") / k).alias("precision_at_k"),
        (F.col("_gain") / ideal).alias("ndcg_at_k"),
    )


def metric_means() -> list[Column]:
    """The means over users, and how many users they cover."""
    return [
        F.avg("average_precision").alias("map"),
        F.avg("precision_at_k").alias("precision_at_k"),
        F.avg("ndcg_at_k").alias("ndcg_at_k"),
        F.count(F.lit(1)).alias("users"),
    ]


def ranking_metrics(placed: DataFrame, labels: DataFrame | None, k: int) -> DataFrame:
    """One row: the means over users, and how many users they cover."""
    return user_metrics(placed, labels, k).agg(*metric_means())


def rmse(df: DataFrame) -> DataFrame:
    """One row: root of the mean squared difference of rating and prediction."""
    error = F.col("rating").cast("double") - F.col("prediction").cast("double")
    return df.agg(F.sqrt(F.avg(error * error)).alias("rmse"))


def rmse_of_pairs(pairs: DataFrame) -> DataFrame:
    """The same from folded test rows, see ``rated_pairs``."""
    p = F.col("prediction").cast("double")
    squares = (
        F.col("rating_squares") - 2 * p * F.col("rating_sum") + p * p * F.col("rated")
    )
    return pairs.agg(F.sqrt(F.sum(squares) / F.sum("rated")).alias("rmse"))


def exclude_seen(recs: DataFrame, train: DataFrame) -> DataFrame:
    """Recommended rows whose (user, item) pair is not in the training rows.

    The training pairs are folded before the shuffle; heavy copies shrink to one row.
    """
    seen = train.select("user_id", "item_id").distinct()
    return recs.join(seen, ["user_id", "item_id"], "left_anti")


def only_test(recs: DataFrame, test: DataFrame, dedup: bool = False) -> DataFrame:
    """Recommended rows that occur in test, with ``copies``: how often, or 1."""
    found = copies(test, ["user_id", "item_id"])
    joined = recs.join(found, ["user_id", "item_id"])
    return joined.withColumn("copies", F.lit(1).cast("bigint")) if dedup else joined


def rec_items(recs: DataFrame) -> DataFrame:
    """Recommended item ids as an array in list order."""
    return recs.select("user_id", F.col("recommendations.item_id").alias("item_ids"))


def rec_rows(recs: DataFrame) -> DataFrame:
    """One row per recommendation."""
    return recs.select("user_id", F.inline("recommendations"))


def best_point(metrics: DataFrame) -> DataFrame:
    """The grid point with the largest MAP; the earliest of several."""
    row = F.struct(*[F.col(c) for c in metrics.columns])
    best = F.max_by(row, F.struct("map", (-F.col("point")).alias("order"))).alias("best")
    return metrics.where(F.col("map").isNotNull()).agg(best).select("best.*")
