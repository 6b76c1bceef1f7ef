"""Seeded draws that depend on row content only.

A draw is the leading 32 bits of ``md5("<purpose>:<seed>:<key>...")``. It stays the
same under any partitioning, recomputation or engine, so a sample or a split can be
evaluated in several branches of a plan and still agree with itself. The purpose
keeps two decisions with the same seed and key independent of each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_BITS = 32
DRAW_SPACE = 1 << DRAW_BITS


def digest(purpose: str, seed: int, keys: Sequence[str | Column]) -> Column:
    """Hex digest of the keys: a reproducible shuffle order."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = [p.cast("string") for p in parts]
    return F.md5(F.concat_ws(":", F.lit(f"{purpose}:{seed}"), *text))


def leading_bits(hex_digest: Column) -> Column:
    """The first 32 bits of a digest as a BIGINT; ordered like the digest itself."""
    return F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("bigint")


def draw(purpose: str, seed: int, keys: Sequence[str | Column]) -> Column:
    """A uniform integer in ``[0, 2^32)``."""
    return leading_bits(digest(purpose, seed, keys))


def threshold(share: float) -> int:
    """The draw below which ``share`` of all keys fall."""
    return round(share * DRAW_SPACE)
