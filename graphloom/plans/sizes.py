"""Broadcasts only behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows of one or two long columns that may be sent to every executor (16 to 32 MB).
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, measured: DataFrame | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for a broadcast if a count that stops beyond ``limit`` finds it small; else ``df``, to be shuffled.

    ``measured``: the rows to count instead, where ``df`` has gathered them into lists.
    """
    rows = df if measured is None else measured
    return F.broadcast(df) if rows.limit(limit + 1).count() <= limit else df
