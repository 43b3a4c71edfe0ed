"""Queries in logical form: ``sel int, agg int, conds array<struct<col, op, value, is_str>>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablequill import constants as K
from tablequill.functions import scale


def _name(header: Column, index: Column) -> Column:
    return F.coalesce(F.get(header, index), F.lit("?"))


def _code(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def render_sql(header: Column, sel: Column, agg: Column, conds: Column) -> Column:
    """SQL text over the table ``"table"``.

    A column past the header becomes ``?``, an unknown operator ``=``; string
    values are quoted but not escaped. An unknown aggregate is an error.
    """
    column = F.concat(F.lit('"'), _name(header, sel), F.lit('"'))
    function = F.coalesce(
        _code(K.AGGREGATES, F.coalesce(agg, F.lit(0))),
        F.raise_error(F.concat(F.lit("unknown aggregate "), agg.cast("string"))),
    )
    selected = F.when(function == "", column).otherwise(
        F.concat(function, F.lit("("), column, F.lit(")"))
    )

    def condition(c: Column) -> Column:
        value = F.when(c["is_str"], F.concat(F.lit("'"), c["value"], F.lit("'"))).otherwise(c["value"])
        op = F.coalesce(_code(K.CONDITION_OPS, c["op"]), F.lit("="))
        return F.concat(F.lit('"'), _name(header, c["col"]), F.lit('" '), op, F.lit(" "), value)

    where = F.array_join(F.transform(conds, condition), " AND ")
    return F.concat(
        F.lit("SELECT "),
        selected,
        F.lit(' FROM "table"'),
        F.when(F.size(conds) > 0, F.concat(F.lit(" WHERE "), where)).otherwise(F.lit("")),
    )


def pattern(agg: Column, conds: Column) -> Column:
    """Class of a query; an unknown aggregate counts as none."""
    function = F.coalesce(_code(K.AGGREGATES, F.coalesce(agg, F.lit(0))), F.lit(""))
    plain = F.when(F.size(conds) > 0, F.lit("where_only")).otherwise(F.lit("select_only"))
    return F.when(function != "", F.lower(function)).otherwise(plain)


def with_pattern(queries: DataFrame) -> DataFrame:
    return queries.withColumn("pattern", pattern(F.col("agg"), F.col("conds")))


def histogram(queries: DataFrame) -> DataFrame:
    counts = with_pattern(queries).groupBy("pattern").agg(F.count("*").alias("examples"))
    return counts.orderBy(F.desc("examples"), "pattern")


def quotas(sizes: DataFrame, total: int) -> DataFrame:
    """Rows to take per pattern, for ``sizes(pattern, available)`` of non-empty patterns.

    The rest of the division goes to the first patterns of the fixed list, whose
    places count empty patterns too; a short pattern is not made up for.
    """
    names = F.array(*[F.lit(p) for p in K.PATTERNS])
    place = F.array_position(names, F.col("pattern")) - 1
    patterns = F.count("*").over(Window.partitionBy())
    base = F.floor(F.lit(total) / patterns)
    extra = F.when(place < F.lit(total) % patterns, F.lit(1)).otherwise(F.lit(0))
    return sizes.select("pattern", F.least(base + extra, F.col("available")).alias("quota"))


def balanced_sample(queries: DataFrame, total: int, seed: int = 42) -> DataFrame:
    """About ``total`` queries, the same number of every pattern, in hash order.

    Counts per (pattern, hash bucket) tell which buckets a quota takes whole
    and which it cuts; only rows up to the cut are ranked.
    """
    rows = (
        with_pattern(queries)
        .withColumn("shuffle_key", scale.hash_order(seed, F.col("example_id")))
        .withColumn("_bucket", scale.hash_bucket(F.col("shuffle_key")))
    )
    offsets = scale.bucket_offsets(rows, ["pattern"], ["_bucket"], {"_n": F.count("*")})
    sizes = offsets.groupBy("pattern").agg(F.sum("_n").alias("available"))
    # At most 7 patterns x 4096 buckets, so this side has a fixed bound.
    wanted = offsets.join(quotas(sizes, total), "pattern").where(F.col("_n_before") < F.col("quota"))
    inside = Window.partitionBy("pattern", "_bucket").orderBy("shuffle_key", "example_id")
    kept = F.broadcast(wanted.select("pattern", "_bucket", "_n_before", "quota"))
    return (
        rows.join(kept, ["pattern", "_bucket"])
        .withColumn("_rn", F.row_number().over(inside) + F.col("_n_before"))
        .where(F.col("_rn") <= F.col("quota"))
        .drop("_rn", "_n_before", "quota", "_bucket")
    )


def dev_quota(train_quota: int) -> int:
    """Size of the development sample that goes with a training sample."""
    return min(train_quota // 5, 1000)
