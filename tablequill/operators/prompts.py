"""Prompts and training records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablequill import constants as K
from tablequill.functions.ordered import joined
from tablequill.functions.scale import first_rows
from tablequill.functions.text import strip

# Own default texts per style; callers may pass another table of the same shape.
STYLE_TEXTS = {
    "simple": ("You write SQL. Answer with the query only.", None),
    "detailed": (
        "You are a careful SQL developer. Translate the question into one query that runs on "
        "the given schema. Answer with the query only.",
        "\n\nNotes:\n- Use only names from the schema.\n- Join tables through their foreign keys.",
    ),
    "expert": (
        "You are a senior SQL developer. Prefer exact names, explicit joins and the fewest "
        "tables that answer the question. Answer with the query only.",
        "\n\nNotes:\n- Use only names from the schema.\n- Qualify names that occur twice.",
    ),
    "few_shot": (
        "You write SQL. Follow the pattern of the examples. Answer with the query only.",
        "\n\nNotes:\n- Use only names from the schema.",
    ),
}


def style_table(spark: SparkSession) -> DataFrame:
    """(style, system_message, guidelines); four rows."""
    rows = [(style, *texts) for style, texts in STYLE_TEXTS.items()]
    return spark.createDataFrame(rows, "style string, system_message string, guidelines string")


def with_style(
    requests: DataFrame, styles: DataFrame, include_guidelines: bool = True
) -> DataFrame:
    """Attach system message and instruction to ``requests(…, style)``.

    The simple style never has guidelines; ``styles`` has one row per style.
    """
    return (
        requests.join(F.broadcast(styles), "style")
        .withColumn("instruction", _instruction(include_guidelines))
        .drop("guidelines")
    )


def _instruction(include_guidelines: bool) -> Column:
    guidelines = F.when(
        F.lit(include_guidelines) & (F.col("style") != "simple"), F.col("guidelines")
    )
    return F.concat(F.lit(K.INSTRUCTION), F.coalesce(guidelines, F.lit("")))


def instruction_of(styles: DataFrame, style: str, include_guidelines: bool = True) -> Column:
    """Instruction of one style, as a scalar subquery."""
    return styles.where(F.col("style") == style).select(_instruction(include_guidelines)).scalar()


def few_shot_blocks(examples: DataFrame, group: str, key: str, n: int = 2) -> DataFrame:
    """(group, few_shot): the first ``n`` examples of each group as one block."""
    first = first_rows(examples.select(group, key, "schema", "question", "sql"), [group], key, n)
    body = F.concat(
        F.lit("[SCHEMA]\n"), "schema",
        F.lit("\n\n[QUESTION]\n"), "question",
        F.lit("\n\n[SQL]\n"), "sql",
        F.lit("\n\n"),
    )
    block = F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), body.alias("body")))),
        lambda r, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit(":\n"), r["body"]),
    )
    text = F.concat(F.lit("\n\n[EXAMPLES]\n\n"), F.array_join(block, ""), F.lit("[END EXAMPLES]\n\n"))
    return first.groupBy(group).agg(text.alias("few_shot"))


def user_prompt(
    instruction: Column,
    schema: Column,
    question: Column,
    schema_links: Column | None = None,
    few_shot: Column | None = None,
) -> Column:
    """Instruction, examples, schema, links and question, each on its own lines."""
    parts = [instruction]
    if few_shot is not None:
        parts.append(F.when(few_shot != "", few_shot))
    parts += [F.lit("[SCHEMA]"), schema]
    if schema_links is not None:
        parts.append(F.when(schema_links != "", F.concat(F.lit("\n"), schema_links)))
    parts += [F.lit("\n[QUESTION]"), question]
    return F.concat_ws("\n", *parts)


def training_record(examples: DataFrame, prompt: Column) -> DataFrame:
    """Columns ``input`` and ``output`` for ``examples`` with a column ``sql``."""
    sql = F.coalesce(F.col("sql"), F.lit(""))
    return examples.withColumn("input", prompt).withColumn("output", F.concat(F.lit("[SQL]\n"), sql))


def simple_record(examples: DataFrame, include_instruction: bool = True) -> DataFrame:
    """Record of the simple style; ``output`` and ``sql`` only if there is a query."""
    head = [F.lit(K.INSTRUCTION)] if include_instruction else []
    links = F.when(F.col("links_text") != "", F.col("links_text")) if "links_text" in examples.columns else None
    parts = [*head, F.col("schema"), *([links] if links is not None else [])]
    question = F.concat(F.lit("[QUESTION]\n"), "question")
    sql = F.nullif(F.col("sql"), F.lit(""))
    return (
        examples.withColumn("input", F.concat_ws("\n\n", *parts, question))
        .withColumn("sql", sql)
        .withColumn("output", F.concat(F.lit("[SQL]\n"), sql))
    )


def legacy_record(examples: DataFrame, include_instruction: bool = True) -> DataFrame:
    """Record of the older format: no section tags and no links."""
    head = [F.lit(K.INSTRUCTION)] if include_instruction else []
    question = F.concat(F.lit("Question: "), "question")
    sql = F.nullif(F.col("sql"), F.lit(""))
    return (
        examples.withColumn("input", F.concat_ws("\n\n", *head, "schema", question))
        .withColumn("sql", sql)
        .withColumn("output", sql)
    )


def chat_markup(user: Column, answer: Column) -> Column:
    """Training text with chat tags."""
    bare = F.regexp_replace(answer, r"^\[SQL\]\n", "")
    return F.concat(
        F.lit(f"<|im_start|>system\n{K.CHATML_SYSTEM}<|im_end|>\n<|im_start|>user\n"),
        user,
        F.lit("<|im_end|>\n<|im_start|>assistant\n"),
        bare,
        F.lit("<|im_end|>"),
    )


def answer_of(examples: DataFrame) -> Column:
    """The query of a record, else its output, else nothing."""
    have = [F.col(c) for c in ("sql", "output") if c in examples.columns]
    return F.coalesce(*have, F.lit(""))


def extract_sql(generated: Column, after_assistant: bool = False) -> Column:
    """The query in a generated text.

    After the last ``[SQL]`` and up to the first end tag; without ``[SQL]`` all
    of it, or what follows the last assistant tag.
    """
    marked = F.substring_index(F.substring_index(generated, "[SQL]", -1), "<|im_end|>", 1)
    rest = F.substring_index(generated, "<|im_start|>assistant", -1) if after_assistant else generated
    return strip(F.when(generated.contains("[SQL]"), marked).otherwise(rest))
