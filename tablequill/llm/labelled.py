"""A bounded sample of labelled documents, and the split every classifier keeps to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(id_col: str) -> Column:
    """crc32 of the id as text mod 5 is 0; a NULL id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def training_labels(labels: DataFrame, label: str, bound: int, id_col: str = "doc_id") -> DataFrame:
    """(id, target) of about ``bound`` labelled ids, held-out ids left out.

    An id is taken if its hash lies below bound / (number of labelled ids): the
    same ids on every run, spread over all tasks, and few enough to broadcast.
    Rows without id or label are left out; of several labels of an id the
    largest counts.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("_label_id"))
        .agg(F.max(F.col(label).cast("int")).alias("_target"))
    )
    total = known.count()
    if total <= bound:
        return known
    share = F.pmod(F.xxhash64("_label_id", F.lit(17)), F.lit(1 << 40))
    return known.where(share < int((1 << 40) * bound / total))
