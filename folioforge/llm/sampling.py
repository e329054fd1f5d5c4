"""Bounded samples by hash, whose cost doesn't grow with the number of tasks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def thinned(pick: Column, wanted: int, total: Column | int) -> Column:
    """Keeps about twice ``wanted`` of ``total`` rows by their hash ``pick``, and all of a small table.

    A sample that sorts by the same hash then gets a bounded number of rows, not ``wanted`` from every task.
    """
    total = total if isinstance(total, Column) else F.lit(total)
    return (F.pmod(pick, F.lit(1 << 30)) / float(1 << 30)) * total < 2.0 * wanted + 50
