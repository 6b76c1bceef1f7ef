"""Small tables with the awkward cases."""

from __future__ import annotations

# Columns whose names operators use inside; they must neither disturb nor be read.
CLASHING = "name STRING, key STRING, n INT, row INT, copy INT, position INT, level INT, block INT, _key INT, kept INT"
EXTRA = ("x", "y", 1, 2, 3, 4, 5, 6, 7, 8)
LONG = " ".join(f"word{i % 997} of{i}" for i in range(30_000))


def documents(spark, rows, clashing: bool = False):
    """Rows are (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
    if clashing:
        return spark.createDataFrame([(*r, *EXTRA) for r in full], f"{schema}, {CLASHING}")
    return spark.createDataFrame(full, schema)
