"""Bounded samples for fitting, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded_sample(rows: DataFrame, seed: int, key: str, bound: int, *ties: str | Column) -> DataFrame:
    """At most ``bound`` rows of least hash of ``key``. Rows are thinned by that hash first, so that a task
    sends its share of the sample and not ``bound`` rows of its own."""
    total = rows.count()
    order = F.xxhash64(F.lit(seed), F.col(key))
    if total > bound:
        share = min(1.0, 1.3 * bound / total + 50 / total)
        rows = rows.where(order <= F.lit(int(-(2**63) + share * (2**64 - 1))))
    return rows.orderBy(order, *ties).limit(bound)
