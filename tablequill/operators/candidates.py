"""Choice of one query per example among several decoded candidates.

All choices are aggregates with map-side combine, so an example with very
many candidates does not fill one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablequill import constants as K
from tablequill.functions.ordered import percent
from tablequill.functions.text import collapse, contains_any


def decoding_score(ord_: Column) -> Column:
    """1.0 for the greedy candidate and the first sample, then 0.1 less each."""
    sampled = F.lit(1.0) - (ord_ - 1) * F.lit(0.1)
    return F.when(ord_ == 0, F.lit(1.0)).otherwise(sampled)


def distinct_candidates(candidates: DataFrame) -> DataFrame:
    """Score by position; of equal texts (case, blanks) the first stays."""
    kept = [c for c in candidates.columns if c != "example_id"]
    return (
        candidates.groupBy("example_id", collapse(F.lower("sql")).alias("_norm"))
        .agg(F.min_by(F.struct(*kept), F.col("ord")).alias("c"))
        .select("example_id", "c.*")
        .withColumn("score", decoding_score(F.col("ord")))
    )


def syntax_error(sql: Column) -> Column:
    """Text of the first failed rule, empty if the query passes; NULL is an empty query."""
    upper = F.upper(sql)
    return (
        F.when(sql.isNull() | (sql == ""), F.lit(K.ERROR_EMPTY))
        .when(~upper.contains("SELECT"), F.lit(K.ERROR_NO_SELECT))
        .when(~contains_any(upper, ["FROM", "COUNT("]), F.lit(K.ERROR_NO_FROM))
        .otherwise(F.lit(""))
    )


def with_syntax(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("syntax_error", syntax_error(F.col("sql"))).withColumn(
        "syntax_valid", F.col("syntax_error") == ""
    )


def select_candidate(examples: DataFrame, candidates: DataFrame) -> DataFrame:
    """One query per example of ``examples(example_id)``, with the method of its choice."""
    order = F.struct((-F.col("score")).alias("s"), F.col("ord"))
    ran = F.col("syntax_valid") & F.col("executed")
    valid = F.col("syntax_valid")
    choices = (
        with_syntax(candidates)
        .groupBy("example_id")
        .agg(
            F.min_by(F.struct("sql", "syntax_valid", "executed"), order).alias("first"),
            F.min_by("sql", F.when(ran, order)).alias("ran_sql"),
            F.min_by("sql", F.when(valid, order)).alias("valid_sql"),
        )
    )
    first_valid = F.col("first.syntax_valid")
    method = (
        F.when(F.col("first").isNull(), "none")
        .when(first_valid & F.col("first.executed"), "first_valid")
        .when(first_valid, "first_syntax_valid")
        .when(F.col("ran_sql").isNotNull(), "executed")
        .when(F.col("valid_sql").isNotNull(), "syntax_valid")
        .otherwise("highest_score")
    )
    sql = (
        F.when(F.col("method") == "none", F.lit(""))
        .when(F.col("method") == "executed", F.col("ran_sql"))
        .when(F.col("method") == "syntax_valid", F.col("valid_sql"))
        .otherwise(F.col("first.sql"))
    )
    return (
        examples.join(choices, "example_id", "left")
        .withColumn("method", method)
        .select("example_id", sql.alias("sql"), "method")
    )


def method_rates(selected: DataFrame) -> DataFrame:
    """Share of every method; ``executed`` is the rate of rescued examples."""
    counts = selected.groupBy("method").agg(F.count("*").alias("examples"))
    # at most one row per method reaches this window
    total = F.sum("examples").over(Window.partitionBy())
    return counts.select("*", percent(F.col("examples"), total).alias("share"))
