"""SQL counterparts of the registered queries, for DuckDB over the same tables.

Every statement restates what its query means in plain SQL over whole tables: global
window numbering, row-level ranks, pairwise dot products. Nothing is shared with the
Spark code.
"""

from __future__ import annotations

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
WIDTH = 64


def _draw(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


def _scored(step: int) -> str:
    return (
        "SELECT user_id, item_id, rating, row_key, "
        f"(item_id * {step} + user_id * 104729) % 97 AS prediction FROM interactions"
    )


_COUNT_COLUMNS = ", ".join(
    f"CAST(sum(CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS \"{s}\""
    for s in SEGMENTS
)
# The first column that reaches the maximum of the row.
_LARGEST = "CASE " + " ".join(
    f"WHEN \"{s}\" = greatest({', '.join(chr(34) + x + chr(34) for x in SEGMENTS)}) THEN '{s}'"
    for s in SEGMENTS
) + " END"

# Building blocks; a block may use the blocks above it.
BLOCKS = {
    "interactions": """
        SELECT o_custkey AS user_id, l_partkey AS item_id,
               CAST(ceil(l_quantity / 10) AS INT) AS rating,
               md5(concat_ws(':', '1', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                             CAST(round(l_extendedprice * 100) AS BIGINT))) AS row_key
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "scored": _scored(7919),
    "active": """
        SELECT user_id, count(*)::BIGINT AS n FROM interactions
        GROUP BY user_id HAVING count(*) >= 10""",
    "parts": f"""
        SELECT user_id, n, CASE WHEN u < 2576980378 THEN 'train'
                                WHEN u < 3435973837 THEN 'val' ELSE 'test' END AS part
        FROM (SELECT user_id, n, {_draw("'split:1:' || user_id")} AS u FROM active)""",
    "placed": """
        SELECT user_id, item_id, rating, row_key, part,
               row_number() OVER (PARTITION BY part
                                  ORDER BY user_id, md5('shuffle:1:' || row_key), row_key) - 1
               AS ordinal
        FROM interactions JOIN parts USING (user_id)""",
    "labeled": """
        SELECT user_id, item_id, rating, row_key,
               CASE WHEN part <> 'train' AND ordinal % 2 = 0 THEN 'train' ELSE part END AS part
        FROM placed""",
    "train": "SELECT user_id, item_id, rating, row_key FROM labeled WHERE part = 'train'",
    "val": """
        SELECT user_id, item_id, rating, row_key FROM labeled
        WHERE part = 'val' AND item_id IN (SELECT item_id FROM train)""",
    "test": """
        SELECT user_id, item_id, rating, row_key FROM labeled
        WHERE part = 'test' AND item_id IN (SELECT item_id FROM train)""",
    "counts": f"""
        SELECT l_partkey AS item_id, {_COUNT_COLUMNS}
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
                      JOIN customer ON o_custkey = c_custkey
        GROUP BY l_partkey""",
    "tops": f"SELECT item_id, {_LARGEST} AS top_category FROM counts",
    "category_names": """
        SELECT top_category, row_number() OVER (ORDER BY top_category) - 1 AS category_id
        FROM (SELECT DISTINCT top_category FROM tops)""",
    "item_map": """
        SELECT CAST(p_partkey + 100000 AS INT) AS item_id_csv,
               CAST(CASE WHEN p_partkey % 50 = 0 THEN p_partkey + 1000000 ELSE p_partkey END AS INT)
               AS item_id
        FROM part""",
    "factors": """
        SELECT CAST(vec_id AS INT) AS id, embedding AS features,
               CAST(label AS BIGINT) AS category_id
        FROM embeddings""",
    "points": """
        SELECT CAST(vec_id AS INT) AS item_id, CAST(label AS BIGINT) AS category_id,
               embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y
        FROM embeddings""",
    "recs": """
        SELECT * FROM (
            SELECT u.vec_id AS user_id, i.vec_id AS item_id, score AS rating,
                   row_number() OVER (PARTITION BY u.vec_id ORDER BY score DESC, i.vec_id) AS place
            FROM embeddings u, embeddings i,
                 LATERAL (SELECT list_dot_product(u.embedding::DOUBLE[], i.embedding::DOUBLE[])
                          AS score)
        ) WHERE place <= 50""",
}


def _with(names: str, select: str, **more: str) -> str:
    blocks = [f"{n} AS ({BLOCKS[n]})" for n in names.split()]
    blocks += [f"{n} AS ({text})" for n, text in more.items()]
    return f"WITH {', '.join(blocks)} {select}"


def _lists(source: str, order: str, name: str, limit: int = 100_000) -> str:
    return f"""
        SELECT user_id, part, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY place) AS {name}
        FROM (SELECT user_id, item_id, place, CAST(place // {limit} AS BIGINT) AS part
              FROM (SELECT user_id, item_id,
                           row_number() OVER (PARTITION BY user_id ORDER BY {order}) - 1 AS place
                    FROM {source}))
        GROUP BY user_id, part"""


def _pairs(predicted: str, limit: int = 100_000) -> str:
    """Both lists by part, of the users that have both; a missing part is an empty text."""
    ours = _lists(predicted, "prediction DESC, item_id", "predicted", limit)
    liked = "(SELECT * FROM interactions WHERE rating >= 3)"
    theirs = _lists(liked, "item_id", "relevant", limit)
    return f"""
        SELECT user_id, part, coalesce(predicted, '') AS predicted, coalesce(relevant, '') AS relevant
        FROM ({ours}) FULL JOIN ({theirs}) USING (user_id, part)
        WHERE user_id IN (SELECT user_id FROM {predicted}) AND user_id IN (SELECT user_id FROM {liked})"""


def _top(source: str, k: int, ties: str = "rank") -> str:
    number = {
        "rank": "rank() OVER (PARTITION BY user_id ORDER BY prediction DESC)",
        "row_number": "row_number() OVER (PARTITION BY user_id "
        "ORDER BY prediction DESC, item_id, row_key)",
    }[ties]
    return f"SELECT * FROM (SELECT *, CAST({number} AS INT) AS rank FROM {source}) WHERE rank <= {k}"


def _metrics(listed: str, labels: str, k: int, columns: str) -> str:
    """Metrics by definition from rows (user_id, item_id, prediction) and label rows."""
    return f"""
        SELECT {columns} FROM (
            SELECT user_id, sum(CASE WHEN hit THEN hits / place ELSE 0 END) / any_value(n) AS ap,
                   sum(CASE WHEN hit AND place <= {k} THEN 1 ELSE 0 END) / {k} AS precision_k,
                   sum(CASE WHEN hit AND place <= {k} THEN 1 / ln(place + 1) ELSE 0 END)
                   / (SELECT sum(1 / ln(i + 1)) FROM range(1, {k} + 1) r(i)
                      WHERE i <= any_value(n)) AS ndcg
            FROM (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END)
                            OVER (PARTITION BY user_id ORDER BY place) AS hits
                  FROM (SELECT p.user_id, l.item_id IS NOT NULL AS hit, n,
                               row_number() OVER (PARTITION BY p.user_id
                                                  ORDER BY p.prediction DESC, p.item_id) AS place
                        FROM ({listed}) p
                        JOIN (SELECT user_id, count(*) AS n FROM ({labels}) GROUP BY user_id) c
                        ON p.user_id = c.user_id
                        LEFT JOIN ({labels}) l
                        ON p.user_id = l.user_id AND p.item_id = l.item_id))
            GROUP BY user_id)"""


_MAP = "round(avg(ap), 6) AS map"
_PRECISION = "round(avg(precision_k), 6) AS precision_at_k"
_NDCG = "round(avg(ndcg), 6) AS ndcg_at_k"
_USERS = "count(*)::BIGINT AS users"
_ALL = f"{_MAP}, {_PRECISION}, {_NDCG}, {_USERS}"
_LABELS = "SELECT DISTINCT user_id, item_id FROM {} WHERE rating >= 3"
_SPLIT = "interactions active parts placed labeled train test"
_CATEGORIES = "counts tops category_names"


def _fixed(listed: str) -> str:
    return _with(
        f"{_SPLIT} recs",
        _metrics(listed, _LABELS.format("test"), 50, _ALL),
    )


def _grid(steps: tuple[int, ...]) -> str:
    blocks, rows = {}, []
    for i, step in enumerate(steps):
        blocks[f"scored{i}"] = _scored(step)
        listed = _top(f"scored{i}", 10)
        rows.append(
            f"SELECT {i} AS point, map FROM "
            f"({_metrics(listed, _LABELS.format('interactions'), 10, _MAP)})"
        )
    union = " UNION ALL ".join(rows)
    return _with("interactions", f"SELECT * FROM ({union}) ORDER BY map DESC, point LIMIT 1", **blocks)


# 64 bits, the high half from a draw of its own.
_PICK = (
    "(('0x' || substr(md5('pick-high:1:' || {0}), 1, 8))::BIGINT::HUGEINT * 4294967296"
    " + ('0x' || substr(md5('pick:1:' || {0}), 1, 8))::BIGINT)"
)

_RESAMPLE = """
    SELECT d.i AS draw_id, p.* EXCLUDE (place)
    FROM (SELECT i, {pick} % (SELECT count(*) FROM {source}) AS place
          FROM range(CAST(round_even((SELECT count(*) FROM {source}) * {percent} / 100, 0) AS BIGINT))
               r(i)) d
    JOIN (SELECT *, row_number() OVER (ORDER BY md5('place:1:' || {key}), {key}) - 1 AS place
          FROM {source}) p USING (place)"""

_BALANCE = """
    SELECT d.i AS draw_id, p.* EXCLUDE (place, n, least)
    FROM (SELECT {by}, n, i, {pick} % n AS place
          FROM (SELECT {by}, count(*) AS n FROM {source} GROUP BY {by}) c,
               range((SELECT min(n) FROM (SELECT count(*) AS n FROM {source} GROUP BY {by}))) r(i)) d
    JOIN (SELECT *, 0 AS n, 0 AS least,
                 row_number() OVER (PARTITION BY {by} ORDER BY md5('place:1:' || {key}), {order}) - 1
                 AS place
          FROM {source}) p
    ON p.{by} = d.{by} AND p.place = d.place"""

_INTERACTION = "user_id, item_id, rating, row_key"
_XS = ", ".join(f"embedding[{i + 1}]::DOUBLE AS x{i}" for i in range(WIDTH))
_WIDE = (
    f"SELECT CAST(vec_id AS INT) AS item_id, CAST(label AS BIGINT) AS category_id, {_XS} "
    "FROM embeddings"
)
_ACTIVE_ROWS = _with(
    "interactions active",
    f"SELECT {_INTERACTION} FROM interactions WHERE user_id IN (SELECT user_id FROM active)",
)
_COUNTS = _with("counts", "SELECT * FROM counts")
_REC_ROWS = "SELECT user_id, item_id, rating AS prediction FROM recs"
_UNSEEN = (
    "SELECT user_id, item_id, rating FROM recs r WHERE NOT EXISTS "
    "(SELECT 1 FROM train t WHERE t.user_id = r.user_id AND t.item_id = r.item_id)"
)

_KNOWN = (
    "SELECT * FROM test WHERE user_id IN (SELECT user_id FROM train) "
    "AND item_id IN (SELECT item_id FROM train)"
)

ORACLES: dict[str, str] = {
    "scan_interactions": _with("interactions", "SELECT * FROM interactions"),
    "json_counts_roundtrip": _COUNTS,
    "csv_id_map_roundtrip": _with("item_map", "SELECT * FROM item_map"),
    "wide_factors_roundtrip": _WIDE,
    "user_counts": _with("interactions active", "SELECT * FROM active"),
    "active_users_sql": _ACTIVE_ROWS,
    "active_users_df": _ACTIVE_ROWS,
    "distinct_items": _with("interactions", "SELECT DISTINCT item_id FROM interactions"),
    "relevant_items": _with(
        "interactions",
        _lists("(SELECT * FROM interactions WHERE rating >= 3)", "item_id", "item_ids"),
    ),
    "sample_users": _with(
        "interactions active",
        f"SELECT * FROM active WHERE {_draw(chr(39) + 'sample:1:' + chr(39) + ' || user_id')}"
        " < 1073741824",
    ),
    "split_users": _with("interactions active parts", "SELECT * FROM parts"),
    "split_train_users": _with(
        "interactions active parts",
        f"SELECT {_INTERACTION} FROM interactions JOIN parts USING (user_id) WHERE part = 'train'",
    ),
    "global_ordinal": _with("interactions active parts placed", "SELECT * FROM placed"),
    "split_halves": _with(
        "interactions",
        f"""SELECT {_INTERACTION}, CAST(ordinal % 2 AS INT) AS half
            FROM (SELECT *, row_number() OVER (
                      ORDER BY user_id, md5('shuffle:1:' || row_key), row_key) - 1 AS ordinal
                  FROM interactions)""",
    ),
    "merge_train": _with(_SPLIT, "SELECT * FROM train"),
    "warm_items": _with(
        _SPLIT,
        """SELECT * FROM labeled
           WHERE part <> 'train' AND item_id IN (SELECT item_id FROM train)""",
    ),
    "split_train": _with(_SPLIT, "SELECT * FROM train"),
    "split_val": _with(f"{_SPLIT} val", "SELECT * FROM val"),
    "split_test": _with(_SPLIT, "SELECT * FROM test"),
    "expand_counts": _COUNTS,
    "top_category": _with("counts tops", "SELECT * FROM tops"),
    "category_map": _with(
        _CATEGORIES, "SELECT category_id, top_category AS category FROM category_names"
    ),
    "top_category_ids": _with(
        _CATEGORIES,
        "SELECT item_id, category_id, top_category FROM tops JOIN category_names USING (top_category)",
    ),
    "top_category_mapped": _with(
        f"{_CATEGORIES} item_map",
        """SELECT item_id_csv AS item_id, category_id, top_category
           FROM tops JOIN category_names USING (top_category)
                     JOIN item_map ON tops.item_id = item_map.item_id""",
    ),
    "factors_category": _with(
        f"{_CATEGORIES} factors",
        f"""SELECT tops.item_id, category_names.category_id,
                  {", ".join(f"features[{i + 1}]::DOUBLE AS x{i}" for i in range(WIDTH))}
           FROM factors JOIN tops ON factors.id = tops.item_id
                        JOIN category_names USING (top_category)""",
    ),
    "factors_category_name": _with(
        f"{_CATEGORIES} factors",
        """SELECT factors.category_id, id AS item_id, top_category AS category
           FROM factors LEFT JOIN category_names USING (category_id)""",
    ),
    "factor_width": "SELECT CAST(max(len(embedding)) AS INT) AS width FROM embeddings",
    "widen_factors": _WIDE,
    "min_class_count": """
        SELECT min(n)::BIGINT AS min_count
        FROM (SELECT count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY label)""",
    "resample_pct": _with(
        "interactions",
        _RESAMPLE.format(
            source="interactions", percent=30, key="row_key", pick=_PICK.format("i")
        ),
    ),
    "resample_to_min": _with(
        "interactions",
        _BALANCE.format(
            source="interactions",
            by="rating",
            key="row_key",
            order="row_key",
            pick=_PICK.format("rating || ':' || i"),
        ),
    ),
    "plot_points": _with(
        "points",
        """SELECT draw_id, item_id, category_id, first_draw, round(x, 6) AS x, round(y, 6) AS y,
                  x BETWEEN -25 AND 25 AND y BETWEEN -25 AND 25 AS in_view
           FROM balanced""",
        shown="SELECT * EXCLUDE (draw_id), draw_id AS first_draw FROM ("
        + _RESAMPLE.format(
            source="points", percent=80, key="item_id", pick=_PICK.format("i")
        )
        + ")",
        balanced=_BALANCE.format(
            source="shown",
            by="category_id",
            key="item_id || ':' || first_draw",
            order="item_id, first_draw",
            pick=_PICK.format("category_id || ':' || i"),
        ),
    ),
    "top_k_rank": _with("interactions scored", _top("scored", 10)),
    "top_k_row_number": _with("interactions scored", _top("scored", 10, "row_number")),
    "ordered_predictions": _with(
        "interactions scored",
        _lists(f"({_top('scored', 10)})", "prediction DESC, item_id", "item_ids"),
    ),
    "ordered_places": _with(
        "interactions scored",
        """SELECT user_id, item_id,
                  row_number() OVER (PARTITION BY user_id ORDER BY prediction DESC, item_id) - 1 AS place
           FROM scored""",
    ),
    "ranking_pairs": _with("interactions scored", _pairs(f"({_top('scored', 10)})")),
    "ranking_pairs_in_parts": _with("interactions scored", _pairs("scored", 5)),
    "rmse": _with(
        "interactions scored",
        "SELECT round(sqrt(avg((rating - prediction) * (rating - prediction))), 6) AS rmse FROM scored",
    ),
    "eval_test_rows": _with(
        "interactions scored",
        _metrics(_top("scored", 10), _LABELS.format("interactions"), 10, _ALL),
    ),
    "metric_map": _with(
        "interactions scored",
        _metrics(_top("scored", 500), _LABELS.format("interactions"), 500, f"{_MAP}, {_USERS}"),
    ),
    "metric_precision_at_k": _with(
        "interactions scored",
        _metrics(
            _top("scored", 5, "row_number"),
            _LABELS.format("interactions"),
            5,
            f"{_PRECISION}, {_USERS}",
        ),
    ),
    "metric_ndcg_at_k": _with(
        "interactions scored",
        _metrics(
            _top("(SELECT DISTINCT user_id, item_id, prediction FROM scored)", 10),
            _LABELS.format("interactions"),
            10,
            f"{_NDCG}, {_USERS}",
        ),
    ),
    "grid_best_point": _grid((7919, 7907, 7901)),
    "dot_product_top_k": _with(
        "recs",
        """SELECT user_id, CAST(place AS INT) AS rank, item_id, round(rating, 6) AS rating
           FROM recs""",
    ),
    "rec_items_array": _with(
        "recs",
        """SELECT user_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY place) AS item_ids
           FROM recs GROUP BY user_id""",
    ),
    "rec_rows_exploded": _with(
        "recs", "SELECT user_id, item_id, round(rating, 6) AS rating FROM recs"
    ),
    "recs_exclude_seen": _with(
        f"{_SPLIT} recs", f"SELECT user_id, item_id, round(rating, 6) AS rating FROM ({_UNSEEN})"
    ),
    "recs_only_test": _with(
        f"{_SPLIT} recs",
        """SELECT user_id, item_id, round(any_value(r.rating), 6) AS rating,
                  count(*)::BIGINT AS copies
           FROM recs r JOIN test USING (user_id, item_id) GROUP BY user_id, item_id""",
    ),
    "ordered_recs": _with(
        f"{_SPLIT} recs", _lists(f"({_UNSEEN})", "rating DESC, item_id", "item_ids")
    ),
    "als_factor_ids": _with(
        _SPLIT, "SELECT DISTINCT CAST(item_id AS INT) AS item_id, 10::INTEGER AS width FROM train"
    ),
    "als_predicted_rows": _with(_SPLIT, _KNOWN),
    "als_reload_rows": _with(_SPLIT, _KNOWN),
    "als_recommend_counts": _with(
        _SPLIT,
        """SELECT user_id, n, n AS items
           FROM (SELECT DISTINCT user_id FROM test WHERE user_id IN (SELECT user_id FROM train)),
                (SELECT least(500, count(DISTINCT item_id))::BIGINT AS n FROM train)""",
    ),
    "eval_all_items_users": _with(
        _SPLIT,
        """SELECT count(DISTINCT user_id)::BIGINT AS users FROM test
           WHERE rating >= 3 AND user_id IN (SELECT user_id FROM train)""",
    ),
    "als_grid_points": _with(
        f"{_SPLIT} val",
        """SELECT CAST(r * 2 + g AS INT) AS point, CAST([10, 160][r + 1] AS INT) AS rank,
                  [0.001::DOUBLE, 1.0][g + 1] AS reg_param, users
           FROM range(2) a(r), range(2) b(g),
                (SELECT count(DISTINCT user_id)::BIGINT AS users FROM val
                 WHERE rating >= 3 AND user_id IN (SELECT user_id FROM train))""",
    ),
    "job_split": _with(
        f"{_SPLIT} val",
        """SELECT *, 'train' AS part FROM train UNION ALL SELECT *, 'val' FROM val
           UNION ALL SELECT *, 'test' FROM test""",
    ),
    "job_top_categories": _with(
        f"{_CATEGORIES} item_map",
        """SELECT item_id_csv AS item_id, category_id, top_category
           FROM tops JOIN category_names USING (top_category)
                     JOIN item_map ON tops.item_id = item_map.item_id""",
    ),
    "job_factors_by_category": _with(
        f"{_CATEGORIES} factors item_map",
        f"""SELECT item_id_csv AS item_id, category_id,
                   {", ".join(f"features[{i + 1}]::DOUBLE AS x{i}" for i in range(WIDTH))}
            FROM (SELECT id, features FROM factors)
            JOIN item_map ON id + 100000 = item_id_csv JOIN tops ON tops.item_id = item_map.item_id
            JOIN category_names USING (top_category)""",
    ),
    "eval_all_items_fixed": _fixed(_REC_ROWS),
    "eval_unseen_items_fixed": _fixed(
        f"SELECT user_id, item_id, rating AS prediction FROM ({_UNSEEN})"
    ),
    "eval_recs_in_test_fixed": _fixed(
        """SELECT user_id, item_id, r.rating AS prediction
           FROM recs r JOIN test USING (user_id, item_id)"""
    ),
}

_FIT_JOB = _with(
    _SPLIT,
    """SELECT users, items, 10::INTEGER AS width
       FROM (SELECT count(DISTINCT user_id)::BIGINT AS users FROM test
             WHERE rating >= 3 AND user_id IN (SELECT user_id FROM train)),
            (SELECT count(DISTINCT item_id)::BIGINT AS items FROM train)""",
)

_DRAWN = "item_id || ':' || train_draw"

ORACLES |= {
    "factor_moments": f"""
        WITH v AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
                   WHERE len(list_filter(embedding, lambda x: x IS NULL)) = 0)
        SELECT i::INTEGER AS i, j::INTEGER AS j, count(*) AS n, round(avg(v[i + 1]), 6) + 0.0::DOUBLE AS mean,
               round(covar_samp(v[i + 1], v[j + 1]), 6) + 0.0::DOUBLE AS covariance
        FROM v, range({WIDTH}) a(i), range({WIDTH}) b(j) WHERE j >= i GROUP BY i, j""",
    "job_factor_view": _with(
        f"{_CATEGORIES} factors",
        """SELECT draw_id, first_draw, train_draw, item_id, category_id, top_category AS category
           FROM balanced LEFT JOIN category_names USING (category_id)""",
        wide="SELECT id AS item_id, category_id FROM factors",
        train="SELECT * EXCLUDE (draw_id), draw_id AS train_draw FROM ("
        + _RESAMPLE.format(source="wide", percent=50, key="item_id", pick=_PICK.format("i"))
        + ")",
        shown="SELECT * EXCLUDE (draw_id), draw_id AS first_draw FROM ("
        + _RESAMPLE.format(source="train", percent=80, key=_DRAWN, pick=_PICK.format("i"))
        + ")",
        balanced=_BALANCE.format(
            source="shown",
            by="category_id",
            key=f"{_DRAWN} || ':' || first_draw",
            order="item_id, train_draw, first_draw",
            pick=_PICK.format("category_id || ':' || i"),
        ),
    ),
    "job_train_eval_test_rows": _FIT_JOB,
    "job_train_eval_all_items": _FIT_JOB,
}

# Other ways to the same rows.
SAME_ROWS = {
    "top_category_from_map": "top_category",
    "dot_product_top_k_stored": "dot_product_top_k",
    "ordered_places_in_ranges": "ordered_places",
    "eval_test_rows_in_ranges": "eval_test_rows",
    "eval_all_items_by_user": "eval_all_items_fixed",
    "eval_unseen_items_by_user": "eval_unseen_items_fixed",
    "eval_recs_in_test_by_user": "eval_recs_in_test_fixed",
}
ORACLES |= {name: ORACLES[other] for name, other in SAME_ROWS.items()}
