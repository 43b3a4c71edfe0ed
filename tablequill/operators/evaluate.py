"""Scoring of predicted SQL against gold SQL, and the reports over the scores.

``scored`` frames carry: example_id, db_id, gold_sql, pred_sql, num_tables,
has_join, exact_match, execution_match, exec_error (see ``verdicts``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablequill import constants as K
from tablequill.functions import scale
from tablequill.functions.ordered import percent
from tablequill.functions.text import collapse, contains_any, occurrences


def normal_form(sql: Column, unify_quotes: bool = True) -> Column:
    """Lower case, single quotes, single blanks."""
    low = F.lower(sql)
    return collapse(low, '"', "'") if unify_quotes else collapse(low)


def with_exact_match(predictions: DataFrame, unify_quotes: bool = True) -> DataFrame:
    """Adds ``exact_match``; a missing prediction is no match."""
    gold = normal_form(F.col("gold_sql"), unify_quotes)
    pred = normal_form(F.col("pred_sql"), unify_quotes)
    # Equal texts need no normal form.
    same = (F.col("gold_sql") == F.col("pred_sql")) | (gold == pred)
    return predictions.withColumn("exact_match", F.coalesce(same, F.lit(False)))


def verdicts(predictions: DataFrame, start_from_exact: bool = True) -> DataFrame:
    """Execution verdict from the flags gold_ran, pred_ran and same_result.

    The flags count only where the texts differ; with ``start_from_exact=False``
    (scores of candidate selection) they always count.
    """
    scored = with_exact_match(predictions)
    ran_equal = F.col("gold_ran") & F.col("pred_ran") & F.col("same_result")
    neither_ran = ~F.col("gold_ran") & ~F.col("pred_ran")
    if start_from_exact:
        match = F.col("exact_match") | ran_equal
        error = ~F.col("exact_match") & neither_ran
    else:
        match, error = ran_equal, F.lit(False)
    return scored.withColumn("execution_match", match).withColumn("exec_error", error)


# --- result sets -----------------------------------------------------------


def same_result_sets(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Equality of two results as sets of rows.

    ``rows(example_id, side, row array<string>)`` has both results in long form,
    ``runs(example_id, gold_ran, pred_ran)`` says which queries gave a result.
    Rows are reduced per (example, row) before they meet per example, so one
    huge result spreads over all tasks.
    """
    sides = rows.groupBy("example_id", "row").agg(
        F.max(F.col("side") == "gold").alias("in_gold"),
        F.max(F.col("side") == "pred").alias("in_pred"),
    )
    equal = sides.groupBy("example_id").agg(
        F.bool_and(F.col("in_gold") == F.col("in_pred")).alias("equal")
    )
    return runs.join(equal, "example_id", "left").select(
        "example_id",
        (F.col("gold_ran") & F.col("pred_ran") & F.coalesce("equal", F.lit(True))).alias(
            "same_result"
        ),
    )


def canonical_value(value: Column, side: Column) -> Column:
    """A text that two VARIANT values share exactly if the values are equal.

    Numbers are equal by value, whatever their types; TRUE is 1 and FALSE is 0.
    A text never equals a number. NULL equals NULL, NaN equals nothing, not even
    itself: its text names the ``side``. Nested values are compared as JSON with
    sorted keys.
    """
    kind = F.schema_of_variant(value)
    text = F.variant_get(value, "$", "string")
    real = F.try_variant_get(value, "$", "double")
    # a double as its shortest text says it, so that 0.1 is 0.1 in both types
    decimal = F.coalesce(text.try_cast("decimal(38,18)"), F.try_variant_get(value, "$", "decimal(38,18)"))
    plain = F.regexp_replace(F.regexp_replace(decimal.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    floating = kind.isin("DOUBLE", "FLOAT")
    # tiny and huge doubles do not fit a decimal; they equal only what prints alike
    number = F.when(floating & (decimal.cast("double") != real), text).otherwise(F.coalesce(plain, text))
    return (
        F.when(value.isNull() | F.is_variant_null(value), "null")
        .when(floating & F.isnan(real), F.concat(F.lit("NaN:"), side))
        .when(floating | kind.startswith("BIGINT") | kind.startswith("DECIMAL"), F.concat(F.lit("n:"), number))
        .when(kind == "BOOLEAN", F.when(text == "true", "n:1").otherwise("n:0"))
        .when(kind == "STRING", F.concat(F.lit("s:"), text))
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.concat(F.lit("j:"), F.to_json(value)))
        .otherwise(F.concat(F.lower(kind), F.lit(":"), F.to_json(value)))
    )


def canonical_rows(rows: DataFrame) -> DataFrame:
    """``rows(example_id, side, row array<variant>)`` with the texts that stand for the values."""
    texts = F.transform("row", lambda v: canonical_value(v, F.col("side")))
    return rows.select("example_id", "side", texts.alias("row"))


def same_typed_result_sets(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """``same_result_sets`` of typed rows, ``row`` an array of VARIANT values."""
    return same_result_sets(canonical_rows(rows), runs)


# --- properties of a query text ---------------------------------------------


def operation_flags(sql: Column) -> dict[str, Column]:
    upper = F.upper(sql)
    flags = {name: contains_any(upper, words) for name, words in K.OPERATION_KEYWORDS.items()}
    flags["has_subquery"] = occurrences(upper, "SELECT") > 1
    return flags


def table_estimate(sql: Column) -> Column:
    upper = F.upper(sql)
    return F.greatest(F.lit(1), occurrences(upper, " FROM ") + occurrences(upper, " JOIN "))


def complexity_class(num_tables: Column, has_join: Column, sql: Column) -> Column:
    tables = F.coalesce(num_tables, F.lit(1))
    joins = F.coalesce(has_join, F.lit(False))
    nested = operation_flags(sql)["has_subquery"]
    simple, medium, complex_, rest = [F.lit(label) for label in K.COMPLEXITY_LABELS]
    return (
        F.when((tables <= 1) & ~joins, simple)
        .when((tables <= 2) & ~nested, medium)
        .when((tables <= 4) & ~nested, complex_)
        .otherwise(rest)
    )


# --- reports ----------------------------------------------------------------


def _scores() -> list[Column]:
    return [
        F.count("*").alias("total"),
        F.count_if("exact_match").alias("em_correct"),
        F.count_if("execution_match").alias("ex_correct"),
    ]


def _rates() -> list[Column]:
    return [
        percent(F.col("em_correct"), F.col("total")).alias("em_accuracy"),
        percent(F.col("ex_correct"), F.col("total")).alias("ex_accuracy"),
    ]


def _db() -> Column:
    return F.coalesce(F.col("db_id"), F.lit(K.UNKNOWN))


def overall(scored: DataFrame) -> DataFrame:
    return scored.agg(
        *_scores(),
        F.count_if("exec_error").alias("execution_errors"),
        F.count_if(F.col("execution_match") & ~F.col("exact_match")).alias("ex_only"),
    ).select("*", *_rates())


def train_counts(train: DataFrame) -> DataFrame:
    return train.groupBy(_db().alias("db_id")).agg(F.count("*").alias("train_samples"))


def by_database(scored: DataFrame, train: DataFrame) -> DataFrame:
    counts = scored.groupBy(_db().alias("db_id")).agg(*_scores())
    return (
        counts.join(train_counts(train), "db_id", "left")
        .select(
            "db_id",
            F.col("total").alias("eval_samples"),
            F.coalesce("train_samples", F.lit(0)).alias("train_samples"),
            "em_correct",
            "ex_correct",
            *_rates(),
        )
        .orderBy("em_accuracy", "db_id")
    )


def _operations() -> Column:
    """Names of the operations of the gold query."""
    flags = operation_flags(F.col("gold_sql"))
    return F.array_compact(F.array(*[F.when(flag, F.lit(name)) for name, flag in flags.items()]))


def by_operation(scored: DataFrame) -> DataFrame:
    """A row counts once in every operation its gold query has."""
    return (
        scored.select(F.explode(_operations()).alias("operation"), "exact_match", "execution_match")
        .groupBy("operation")
        .agg(*_scores())
        .select("*", *_rates())
        .orderBy("em_accuracy", "operation")
    )


def by_complexity(scored: DataFrame) -> DataFrame:
    level = complexity_class(F.col("num_tables"), F.col("has_join"), F.col("gold_sql"))
    labels = F.array(*[F.lit(label) for label in K.COMPLEXITY_LABELS])
    return (
        scored.groupBy(level.alias("complexity"))
        .agg(*_scores())
        .select("*", *_rates())
        .orderBy(F.array_position(labels, F.col("complexity")))
    )


def worst(scored: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` databases and the ``n`` operations with the lowest exact match.

    One pass: a row counts for its database and for each of its operations.
    """
    groups = F.concat(
        F.array(F.struct(F.lit("database").alias("kind"), _db().alias("name"))),
        F.transform(
            _operations(), lambda o: F.struct(F.lit("operation").alias("kind"), o.alias("name"))
        ),
    )
    rates = (
        scored.select(F.explode(groups).alias("g"), "exact_match", "execution_match")
        .groupBy("g.kind", "g.name")
        .agg(*_scores())
        .select("kind", "name", *_rates())
    )
    lowest = Window.partitionBy("kind").orderBy("em_accuracy", "name")
    return rates.withColumn("_rn", F.row_number().over(lowest)).where(F.col("_rn") <= n).drop("_rn")


def filter_databases(
    rows: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None
) -> DataFrame:
    """An include list wins over an exclude list; no list keeps all rows."""
    if include:
        return rows.where(_db().isin(include))
    if exclude:
        return rows.where(~_db().isin(exclude))
    return rows


def removed_by_database(
    rows: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None
) -> DataFrame:
    if include:
        gone = rows.where(~_db().isin(include))
    elif exclude:
        gone = rows.where(_db().isin(exclude))
    else:
        gone = rows.where(F.lit(False))
    return gone.groupBy(_db().alias("db_id")).agg(F.count("*").alias("removed"))


def database_distribution(rows: DataFrame, top_n: int = 20) -> DataFrame:
    """Rows per database, the ``top_n`` largest, and how many databases are left out."""
    counts = rows.groupBy(_db().alias("db_id")).agg(F.count("*").alias("samples"))
    total = counts.agg(F.sum("samples")).scalar()
    left = F.greatest(counts.agg(F.count("*")).scalar() - top_n, F.lit(0))
    return (
        counts.select(
            "*", percent(F.col("samples"), total).alias("share"), left.alias("databases_left")
        )
        .orderBy(F.desc("samples"), "db_id")
        .limit(top_n)
    )


def by_database_capped(scored: DataFrame, key: str, max_per_db: int, train: DataFrame) -> DataFrame:
    """First ``max_per_db`` rows of every database, with a total over all of them.

    The total is the row whose ``db_id`` is NULL; its ``train_samples`` counts
    all training rows, also those of databases that are not evaluated.
    """
    kept = scale.first_rows(scored.withColumn("db_id", _db()), ["db_id"], key, max_per_db)
    per_db = kept.groupBy("db_id").agg(*_scores()).join(train_counts(train), "db_id", "left")
    all_train = train.agg(F.count("*")).scalar()
    own_train = F.coalesce("train_samples", F.lit(0))
    return (
        per_db.rollup("db_id")
        .agg(
            F.sum("total").alias("total"),
            F.sum("em_correct").alias("em_correct"),
            F.sum("ex_correct").alias("ex_correct"),
            F.sum("train_samples").alias("train_samples"),
            F.grouping("db_id").alias("_all"),
        )
        .withColumn("train_samples", F.when(F.col("_all") == 1, all_train).otherwise(own_train))
        .drop("_all")
        .select("*", *_rates())
    )


def unmatched_predictions(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Example ids that only one side has; must be empty before scoring."""
    missing = gold.join(predictions, "example_id", "left_anti").select(
        "example_id", F.lit("prediction").alias("missing")
    )
    extra = predictions.join(gold, "example_id", "left_anti").select(
        "example_id", F.lit("gold").alias("missing")
    )
    return missing.unionByName(extra)


def exact_by_database(gold: DataFrame, predictions: DataFrame, train: DataFrame) -> DataFrame:
    """Exact match per database from stored predictions; a gold row without one is wrong."""
    pairs = gold.select("example_id", "db_id", "gold_sql").join(
        predictions.select("example_id", "pred_sql"), "example_id", "left"
    )
    counts = (
        with_exact_match(pairs)
        .groupBy(_db().alias("db_id"))
        .agg(F.count("*").alias("eval_samples"), F.count_if("exact_match").alias("em_correct"))
    )
    return counts.join(train_counts(train), "db_id", "left").select(
        "db_id",
        "eval_samples",
        F.coalesce("train_samples", F.lit(0)).alias("train_samples"),
        "em_correct",
        percent(F.col("em_correct"), F.col("eval_samples")).alias("em_accuracy"),
    )


def show_examples(
    scored: DataFrame, key: str, n_correct: int = 3, n_incorrect: int = 3, by: str = "exact_match"
) -> DataFrame:
    """The first correct and the first incorrect rows; a NULL verdict is incorrect."""
    right = F.coalesce(F.col(by), F.lit(False))
    correct = scored.where(right).orderBy(key).limit(n_correct)
    incorrect = scored.where(~right).orderBy(key).limit(n_incorrect)
    return correct.unionByName(incorrect)


def running_accuracy(scored: DataFrame, run: list[str], key: str, every: int = 10) -> DataFrame:
    """Accuracy after every ``every`` rows of a run, in the order of ``key``.

    Totals per key bucket are summed up first; the window over rows never
    spans more than one bucket. ``scored`` is read twice: pass a stored table.
    """
    rows = scored.select(
        *run,
        key,
        F.col("exact_match").cast("int").alias("_em"),
        F.col("execution_match").cast("int").alias("_ex"),
        scale.key_bucket(key).alias("_bucket"),
    )
    sums = {"n": F.count("*"), "em": F.sum("_em"), "ex": F.sum("_ex")}
    offsets = scale.bucket_offsets(rows, run, ["_bucket"], sums)
    upto = (
        Window.partitionBy(*run, "_bucket")
        .orderBy(key)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = offsets.select(*run, "_bucket", "n_before", "em_before", "ex_before")
    return (
        scale.null_safe_join(rows, before, run + ["_bucket"])
        .select(
            *run,
            (F.count("*").over(upto) + F.col("n_before")).alias("rows_seen"),
            (F.sum("_em").over(upto) + F.col("em_before")).alias("em_correct"),
            (F.sum("_ex").over(upto) + F.col("ex_before")).alias("ex_correct"),
        )
        .where(F.col("rows_seen") % every == 0)
        .select(
            "*",
            percent(F.col("em_correct"), F.col("rows_seen")).alias("em_accuracy"),
            percent(F.col("ex_correct"), F.col("rows_seen")).alias("ex_accuracy"),
        )
    )
