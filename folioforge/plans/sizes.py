"""Broadcasts behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows up to which a table of short rows is sent to all tasks.
SMALL_ROWS = 50_000

#: Characters up to which a table of a few long texts is.
SHORT_CHARS = 8 << 20


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df``, marked for a broadcast join if it has at most ``rows`` rows; else the planner chooses."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def broadcast_if_short(df: DataFrame, text: str, chars: int = SHORT_CHARS, rows: int = SMALL_ROWS) -> DataFrame:
    """``df``, marked for a broadcast join if it has at most ``rows`` rows and ``chars`` characters in ``text``; else the planner chooses."""
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= chars else df
