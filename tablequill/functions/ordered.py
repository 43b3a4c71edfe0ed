"""Ordered aggregation helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined(value: Column, order: list[Column], separator: str) -> Column:
    """Aggregate: the values of a group in order, as one string."""
    keys = [c.alias(f"o{i}") for i, c in enumerate(order)]
    rows = F.array_sort(F.collect_list(F.struct(*keys, value.alias("v"))))
    return F.array_join(F.transform(rows, lambda r: r["v"]), separator)


def percent(part: Column, total: Column) -> Column:
    """100 * part / total, 0 for an empty total."""
    return F.when(total > 0, F.lit(100) * part / total).otherwise(F.lit(0.0))
