"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps one bit per failed
rule and the measurements; versioned policies (sets of rules) are applied to
the bits afterwards, and ablations are bitwise aggregates over the ledger, so
that a new policy or a report reads no text again.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablequill.llm import measures
from tablequill.llm.rows import boxed, unboxed
from tablequill.session import settle

RULE_COLUMNS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
    "n_distinct_words", "n_upper", "n_lower", "n_marks", "n_window_words",
]
SCHEMA = T.StructType([T.StructField(c, T.LongType(), False) for c in RULE_COLUMNS])

# (name, what fails), in the order of the bits; only integers, so exact everywhere.
# New rules go at the end: bits that are stored keep their meaning.
RULES = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("marks", "2 * n_marks > n_words"),
    ("capitals", "2 * n_upper > n_upper + n_lower and n_upper > 20"),
    ("few_distinct_words", "n_words >= 20 and 10 * n_distinct_words < 3 * n_words"),
    ("duplicate_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    ("few_distinct_in_windows", "n_words >= 20 and 10 * n_window_words < 3 * n_words"),
]
BIT = {name: i for i, (name, _) in enumerate(RULES)}
BASE = ("few_words", "repeated_windows")

# A published version never changes; a change is a new version.
POLICIES = {
    1: BASE,
    2: (*BASE, "symbols", "marks", "capitals"),
    3: tuple(name for name, _ in RULES[:8]),
    # the share of distinct words in a whole text falls with its length alone
    4: tuple(name for name, _ in RULES if name != "few_distinct_words"),
}
CURRENT = 4


def _measured(texts: pa.Array) -> pa.Array:
    found = measures.measure(texts)
    return pa.StructArray.from_arrays([pa.array(found[c]) for c in RULE_COLUMNS], RULE_COLUMNS)


def measured(text: Column | str) -> Column:
    """The measurements of a text as one struct; NULL measures as the empty text."""
    return F.arrow_udf(_measured, SCHEMA)(text)


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << BIT[r] for r in rules)


def failures() -> Column:
    """Bits of the failed rules, from the columns of the measurements."""
    bits = F.lit(0).cast("long")
    for i, (_, fails) in enumerate(RULES):
        bit = F.when(F.expr(fails), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
        bits = bits.bitwiseOR(bit)
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, measurements, fail_bits), one row per row of ``docs``.

    NULL and empty texts measure 0 and fail ``few_words``; repeated rows and
    NULL ids stay as they are; other columns of ``docs`` are not touched.
    """
    rows = docs.select(F.col(id_col), measured(F.col(text)).alias("_m"))
    return rows.select(id_col, "_m.*").withColumn("fail_bits", failures())


def store(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """The ledger as a stored table, at ``path`` or in the scratch folder.

    Policies and ablations that read it measure no text again. Numbers only,
    about fifty bytes a document.
    """
    rows = ledger(docs, id_col, text)
    if path is None:
        return settle(rows, "ledger")
    rows.write.mode("errorifexists").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def apply_policy(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """Adds ``kept``: no rule of the policy has failed."""
    chosen = F.lit(mask(POLICIES[version])).cast("long")
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(chosen) == 0)


def ablations(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """(rule, failed, only): documents that fail the rule, and that nothing else rejects.

    ``only`` is what the policy would keep more without the rule. One bitwise
    aggregate over the ledger, one row per rule.
    """
    chosen = mask(POLICIES[version])
    bits = F.col("fail_bits")
    sums = []
    for name in POLICIES[version]:
        bit = F.lit(1 << BIT[name]).cast("long")
        hit = bits.bitwiseAND(bit) != 0
        alone = bits.bitwiseAND(F.lit(chosen).cast("long")) == bit
        sums.append(F.struct(
            F.lit(name).alias("rule"), F.count_if(hit).alias("failed"), F.count_if(alone).alias("only")
        ))
    return rows.agg(F.array(*sums).alias("r")).select(F.inline("r"))


def filter_documents(docs: DataFrame, text: str = "text", version: int = CURRENT) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, all their columns unchanged."""
    rows = boxed(docs, measured(F.col(text)).alias("m")).select("row", "m.*")
    chosen = F.lit(mask(POLICIES[version])).cast("long")
    return unboxed(rows.where(failures().bitwiseAND(chosen) == 0))


def op8_rows(docs: DataFrame, version: int = CURRENT) -> DataFrame:
    """The ledger under one policy, with the bits up to the last rule of the policy."""
    rows = apply_policy(store(docs), version)
    known = F.lit((2 << max(BIT[r] for r in POLICIES[version])) - 1).cast("long")
    base = F.col("fail_bits").bitwiseAND(F.lit(mask(BASE)).cast("long")) != 0
    return rows.withColumn("base_failed", base).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.col("fail_bits").bitwiseAND(known).alias("fail_bits"),
    )
