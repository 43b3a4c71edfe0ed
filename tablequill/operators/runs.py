"""Ranking of stored prediction runs (one run per training checkpoint)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablequill.functions.ordered import percent

NO_PREDICTIONS = "no predictions"


def run_summary(runs: DataFrame, scored: DataFrame) -> DataFrame:
    """One row per run of ``runs(run_id)``; a run without rows scores 0 with an error."""
    totals = scored.groupBy("run_id").agg(
        F.count("*").alias("total"),
        F.count_if("exact_match").alias("em_count"),
        F.count_if("execution_match").alias("ex_count"),
    )
    zero = F.lit(0).cast("long")
    step = F.regexp_extract("run_id", r"checkpoint-(\d+)", 1)
    return (
        runs.join(totals, "run_id", "left")
        .withColumn("error", F.when(F.col("total").isNull(), F.lit(NO_PREDICTIONS)))
        .withColumn("step", F.when(step != "", step).otherwise(F.lit("final")))
        .withColumns({c: F.coalesce(c, zero) for c in ("total", "em_count", "ex_count")})
        .withColumn("em_accuracy", percent(F.col("em_count"), F.col("total")))
        .withColumn("ex_accuracy", percent(F.col("ex_count"), F.col("total")))
    )


def rank_runs(summary: DataFrame) -> DataFrame:
    """Order by EX, then EM, then step; marks the best run by each metric."""
    step = F.col("step").try_cast("long")
    order = [F.desc("ex_accuracy"), F.desc("em_accuracy"), F.asc_nulls_last(step), F.asc("run_id")]
    ranked = summary.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    by_em = F.row_number().over(Window.orderBy(F.desc("em_accuracy"), "rank"))
    return (
        ranked.withColumn("best_em", by_em == 1)
        .withColumn("best_ex", F.col("rank") == 1)
        .orderBy("rank")
    )


def best_run(summary: DataFrame, metric: str = "ex_accuracy") -> DataFrame:
    """Best run by one metric, first name wins a tie.

    A run named otherwise than ``checkpoint-…`` counts only if there is no
    such run; failed runs never win.
    """
    numbered = F.col("run_id").startswith("checkpoint-")
    any_numbered = F.max(numbered).over(Window.partitionBy())
    return (
        summary.withColumn("_any", any_numbered)
        .where((numbered == F.col("_any")) & F.col("error").isNull())
        .orderBy(F.desc(metric), "run_id")
        .limit(1)
        .select("run_id", F.col(metric).alias("metric"), "em_accuracy")
    )
