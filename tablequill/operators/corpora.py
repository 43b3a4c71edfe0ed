"""Corpora of (question, schema, SQL) into training examples.

``examples`` frames carry: example_id, dataset, split, schema_id, question,
sql, schema, num_tables, has_join, complexity, source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablequill import constants as K
from tablequill.functions import scale
from tablequill.functions.text import strip
from tablequill.operators import catalog as C
from tablequill.operators import logical_form, semantic
from tablequill.operators.schema_text import schema_text

EXAMPLE = [
    "example_id", "dataset", "split", "schema_id", "question", "sql", "schema",
    "num_tables", "has_join", "complexity", "source",
]

# --- selection of rows ----------------------------------------------------------------


def positional_split(corpus: DataFrame, partition: list[str], key: str) -> DataFrame:
    """First nine tenths of every partition (NULL is one) are ``train``, the rest ``dev``.

    Only ``partition`` and ``key`` are read to find the place of the cut; the
    wide rows are compared with it where they are.
    """
    quota = F.expr("total * 9 div 10")
    cut = scale.first_cutoffs(corpus, partition, key, quota)
    placed = scale.before_cutoff(corpus, cut, partition, key, "_train")
    split = F.when(F.col("_train"), F.lit("train")).otherwise(F.lit("dev"))
    return placed.withColumn("split", split).drop("_train")


def of_complexity(corpus: DataFrame, complexities: list[str]) -> DataFrame:
    return corpus.where(F.col("complexity").isin(complexities))


def first_examples(corpus: DataFrame, partition: list[str], key: str, n: int) -> DataFrame:
    return scale.first_rows(corpus, partition, key, n)


def split_instruction(corpus: DataFrame) -> DataFrame:
    """Columns ``ddl`` and ``question`` out of ``instruction``.

    Leading paragraphs with a table definition, and blank ones, are the schema;
    the question starts at the first other paragraph.
    """
    parts = F.split("instruction", "\n\n")
    is_schema = F.transform(
        parts, lambda p: F.upper(p).contains("CREATE TABLE") | (strip(p) == "")
    )
    first = F.array_position(is_schema, False).cast("int")
    whole = F.size(parts) == 1
    ddl = F.when(whole | (F.col("_first") == 0), F.col("instruction")).otherwise(
        F.array_join(F.slice(parts, F.lit(1), F.col("_first") - 1), "\n\n")
    )
    asked = F.when(whole | (F.col("_first") == 0), F.lit(K.DEFAULT_QUESTION)).otherwise(
        F.array_join(F.slice(parts, F.greatest(F.col("_first"), F.lit(1)), F.size(parts)), "\n\n")
    )
    bare = strip(F.regexp_replace("_asked", "^-+", ""))
    question = F.when(F.col("_asked").startswith("--"), bare).otherwise(F.col("_asked"))
    return (
        corpus.withColumn("_first", first)
        .withColumn("ddl", ddl)
        .withColumn("_asked", asked)
        .withColumn("question", question)
        .drop("_first", "_asked")
    )


# --- examples ------------------------------------------------------------------------------


def has_join(sql: Column) -> Column:
    return F.upper(sql).contains("JOIN")


def table_counts(catalog: C.Catalog) -> DataFrame:
    return catalog.tables.groupBy("schema_id").agg(
        F.countDistinct("table_name").cast("int").alias("num_tables")
    )


def with_schema(corpus: DataFrame, texts: DataFrame, counts: DataFrame) -> DataFrame:
    """Attach the text and size of each schema; rows without tables drop out.

    ``corpus`` carries example_id and schema_id; see ``scale.attach`` for popular schemas.
    """
    known = texts.select("schema_id", F.col("text").alias("schema")).join(counts, "schema_id")
    return (
        scale.attach(corpus, known, ["schema_id"], ["example_id"])
        .withColumn("has_join", has_join(F.col("sql")))
    )


def _example(df: DataFrame) -> DataFrame:
    for name in ("complexity", "source"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    return df.select(*EXAMPLE)


def semantic_links(
    catalog: C.Catalog, term_vectors: DataFrame, threshold: float = K.VECTOR_THRESHOLD
) -> DataFrame:
    """The best links between similar columns of every schema, for its text."""
    pairs = semantic.similar_columns(catalog.columns, catalog.fks, term_vectors, threshold)
    return semantic.top_links(pairs)


def from_catalog(
    corpus: DataFrame, catalog: C.Catalog, style: str = "structured", links: DataFrame | None = None
) -> DataFrame:
    """Examples whose schema is a catalog record, joined by ``schema_id``.

    ``links`` are shown in the schema text, see ``semantic_links``.
    """
    texts = schema_text(catalog, style, True, links)
    return _example(with_schema(corpus, texts, table_counts(catalog)))


def without_catalog(corpus: DataFrame, catalog: C.Catalog) -> DataFrame:
    """Rows that ``from_catalog`` skips: schema unknown, NULL or without tables.

    Only the distinct schema ids meet the catalog; the rows then meet the
    unknown ids, spread where one id has many rows.
    """
    known = catalog.tables.select("schema_id").distinct()
    unknown = corpus.select("schema_id").distinct().join(known, "schema_id", "left_anti")
    return scale.attach(corpus, unknown, ["schema_id"], ["example_id"], null_safe=True)


def ddl_id(ddl: Column) -> Column:
    return F.sha2(ddl, 256)


def ddl_catalog(corpus: DataFrame) -> C.Catalog:
    """Stored catalog of the DDL texts of a corpus; every distinct DDL is parsed once."""
    keyed = corpus.select(ddl_id(F.col("ddl")).alias("schema_id"), "ddl")
    return C.store(C.catalog_from_ddl(keyed.dropDuplicates(["schema_id"])))


def from_ddl(
    corpus: DataFrame, style: str = "structured", drop_empty: list[str] | None = None,
    catalog: C.Catalog | None = None, links: DataFrame | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """Examples whose schema is a DDL text; ``catalog`` is its ``ddl_catalog`` if there is one.

    ``known(schema_id, schema, num_tables)`` are texts made before, in the same
    style (``text_store.ddl_texts``); nothing is parsed then.

    Rows whose DDL yields no table drop out for the datasets in ``drop_empty``
    (all if None); the others keep an example with an empty schema. ``links``
    are shown in the schema text, see ``semantic_links``.
    """
    keyed = corpus.withColumn("schema_id", ddl_id(F.col("ddl")))
    if known is None:
        catalog = ddl_catalog(corpus) if catalog is None else catalog
        texts = schema_text(catalog, style, False, links)
        known = texts.select("schema_id", F.col("text").alias("schema")).join(
            table_counts(catalog), "schema_id"
        )
    else:
        known = known.where("num_tables > 0")
    how = "inner" if drop_empty is None else "left"
    joined = scale.attach(keyed.drop("ddl"), known, ["schema_id"], ["example_id"], how)
    if drop_empty is not None:
        joined = joined.where(F.col("schema").isNotNull() | ~F.col("dataset").isin(drop_empty))
    empty = EMPTY_SCHEMA[style]
    filled = (
        joined.withColumn("schema", F.coalesce("schema", F.lit(empty)))
        .withColumn("num_tables", F.coalesce("num_tables", F.lit(0)))
        .withColumn("has_join", has_join(F.col("sql")))
    )
    return _example(filled)


# Text of a schema without tables.
EMPTY_SCHEMA = {
    "basic": "Schema Graph:",
    "detailed": "Schema:",
    "typed": "",
    "compact": "Tables: ",
    "structured": "[TABLES]",
}


def from_logical_form(
    queries: DataFrame, tables: DataFrame, style: str = "structured"
) -> DataFrame:
    """Examples of the single-table corpus; queries on unknown tables drop out.

    ``queries(example_id, dataset, split, table_id, question, sel, agg, conds)``,
    ``tables(id, page_title, header, types)``.
    """
    catalog = C.catalog_from_single_tables(tables)
    texts = schema_text(catalog, style, include_db_id=False)
    known = texts.select(F.col("schema_id").alias("table_id"), F.col("text").alias("schema")).join(
        tables.select(F.col("id").alias("table_id"), "header"), "table_id"
    )
    rendered = scale.attach(queries, known, ["table_id"], ["example_id"]).withColumn(
        "sql",
        logical_form.render_sql(F.col("header"), F.col("sel"), F.col("agg"), F.col("conds")),
    )
    none = F.lit(None)
    return _example(
        rendered.withColumn("schema_id", F.col("table_id"))
        .withColumn("num_tables", none.cast("int"))
        .withColumn("has_join", none.cast("boolean"))
    )


# --- the combined corpus ---------------------------------------------------------------------


def combine(*datasets: DataFrame) -> DataFrame:
    combined = datasets[0]
    for other in datasets[1:]:
        combined = combined.unionByName(other, allowMissingColumns=True)
    return combined


def shuffle_order(examples: DataFrame, seed: int = 42) -> DataFrame:
    """Place of every training example in a reproducible random order.

    Development examples keep their order; they are not part of the result.
    """
    train = examples.where(F.col("split") == "train").withColumn(
        "shuffle_key", scale.hash_order(seed, F.col("example_id"))
    )
    digits = scale.hash_digits(train.select("example_id").count())
    keyed = train.withColumn("_bucket", scale.hash_bucket(F.col("shuffle_key"), digits))
    order = [F.col("shuffle_key"), F.col("example_id")]
    return scale.bucketed_row_number(keyed, ["split"], ["_bucket"], order, "position").drop("_bucket")


def stats(examples: DataFrame) -> DataFrame:
    """Per dataset: rows, rows on schemas with several tables, rows with a join."""
    return examples.groupBy("dataset").agg(*_counts())


def _counts() -> list[Column]:
    tables = F.coalesce(F.col("num_tables"), F.lit(1))
    joins = F.coalesce(F.col("has_join"), F.lit(False))
    return [
        F.count("*").alias("examples"),
        F.count_if(tables > 1).alias("multi_table"),
        F.count_if(joins).alias("with_join"),
    ]


def summary(examples: DataFrame) -> DataFrame:
    """Training rows per dataset and in total (dataset NULL), with shares in percent."""
    train = examples.where(F.col("split") == "train")
    return train.rollup("dataset").agg(*_counts()).select(
        "*",
        (F.col("multi_table") * 100 / F.col("examples")).alias("multi_table_share"),
        (F.col("with_join") * 100 / F.col("examples")).alias("with_join_share"),
    )


def phase(examples: DataFrame, split: str, dataset: str | None = None) -> DataFrame:
    """Rows of one training phase: one dataset, or all for the combined phase."""
    rows = examples.where(F.col("split") == split)
    return rows if dataset is None else rows.where(F.col("dataset") == dataset)
