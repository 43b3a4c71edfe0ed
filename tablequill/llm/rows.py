"""Whole rows beside columns of an operator, whatever the rows' columns are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def boxed(docs: DataFrame, *columns: Column) -> DataFrame:
    """(row, columns): the row as one struct, so that no name of it can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *columns)


def unboxed(frame: DataFrame) -> DataFrame:
    return frame.select("row.*")
