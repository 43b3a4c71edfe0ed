"""Schemas as prompt text, and schema text back to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablequill.functions.ordered import joined
from tablequill.functions.text import strip, unquote
from tablequill.operators.catalog import Catalog

STYLES = ("basic", "detailed", "typed", "compact", "structured")


def _table_texts(catalog: Catalog, column: Column, separator: str) -> DataFrame:
    """(schema_id, table_ord, table_name, cols): columns of a table as one string."""
    cols = (
        catalog.columns.select("schema_id", "table_ord", "col_ord", column.alias("txt"))
        .groupBy("schema_id", "table_ord")
        .agg(joined(F.col("txt"), [F.col("col_ord")], separator).alias("cols"))
    )
    return catalog.tables.join(cols, ["schema_id", "table_ord"], "left")


def _schema_texts(tables: DataFrame, table: Column, separator: str) -> DataFrame:
    return tables.groupBy("schema_id").agg(
        joined(table, [F.col("table_ord")], separator).alias("body")
    )


def _fk_texts(catalog: Catalog, form: str) -> DataFrame:
    source = F.concat_ws(".", "from_table", "from_column")
    target = F.concat_ws(".", "to_table", "to_column")
    return catalog.fks.groupBy("schema_id").agg(
        joined(F.format_string(form, source, target), [F.col("fk_ord")], "\n").alias("fk_text")
    )


def _reference() -> Column:
    return F.concat_ws(".", "fk_table", "fk_column")


def _with_fks(catalog: Catalog, body: DataFrame, form: str) -> DataFrame:
    return body.join(_fk_texts(catalog, form), "schema_id", "left")


def basic(catalog: Catalog) -> DataFrame:
    tables = _table_texts(catalog, F.col("col_name"), ", ")
    line = F.concat(F.lit("Table: "), "table_name", F.lit("("), F.coalesce("cols", F.lit("")), F.lit(")"))
    body = _with_fks(catalog, _schema_texts(tables, line, "\n"), "Foreign Key: %s -> %s")
    return body.select(
        "schema_id", F.concat_ws("\n", F.lit("Schema Graph:"), "body", "fk_text").alias("text")
    )


def detailed(catalog: Catalog) -> DataFrame:
    marks = F.concat_ws(
        ", ",
        F.col("dtype"),
        F.when(F.col("is_pk"), F.lit("PK")),
        F.when(F.col("is_fk"), F.concat(F.lit("FK->"), _reference())),
    )
    column = F.concat("col_name", F.lit(" ("), marks, F.lit(")"))
    tables = _table_texts(catalog, column, ", ")
    lines = F.concat(
        F.lit("Table: "), "table_name", F.lit("\n  Columns: "), F.coalesce("cols", F.lit(""))
    )
    body = _with_fks(catalog, _schema_texts(tables, lines, "\n"), "  %s = %s")
    relations = F.when(F.col("fk_text").isNotNull(), F.concat(F.lit("Relations:\n"), "fk_text"))
    return body.select(
        "schema_id", F.concat_ws("\n", F.lit("Schema:"), "body", relations).alias("text")
    )


def typed(catalog: Catalog) -> DataFrame:
    kind = (
        F.when(F.col("is_pk"), F.lit("column_primary"))
        .when(F.col("is_fk"), F.lit("column_foreign"))
        .otherwise(F.lit("column"))
    )
    column = F.concat(F.lit("  ["), kind, F.lit("] "), "col_name")
    tables = _table_texts(catalog, column, "\n")
    lines = F.concat_ws("\n", F.concat(F.lit("[table] "), "table_name"), "cols")
    body = _with_fks(catalog, _schema_texts(tables, lines, "\n"), "[foreign_key_edge] %s -> %s")
    return body.select("schema_id", F.concat_ws("\n", "body", "fk_text").alias("text"))


def compact(catalog: Catalog) -> DataFrame:
    column = F.concat(
        "col_name",
        F.when(F.col("is_pk"), F.lit("*")).otherwise(F.lit("")),
        F.when(F.col("is_fk"), F.concat(F.lit("^"), _reference())).otherwise(F.lit("")),
    )
    tables = _table_texts(catalog, column, ", ")
    line = F.concat("table_name", F.lit("("), F.coalesce("cols", F.lit("")), F.lit(")"))
    body = _schema_texts(tables, line, " | ")
    return body.select("schema_id", F.concat(F.lit("Tables: "), "body").alias("text"))


def structured(
    catalog: Catalog, include_db_id: bool = True, semantic_links: DataFrame | None = None
) -> DataFrame:
    """Sections joined by blank lines; empty sections are left out."""
    marks = F.concat_ws(
        ", ", F.when(F.col("is_pk"), F.lit("PK")), F.when(F.col("is_fk"), F.lit("FK"))
    )
    column = F.concat(
        F.lit("    "),
        F.col("col_name"),
        F.when(marks != "", F.concat(F.lit(" ("), marks, F.lit(")"))).otherwise(F.lit("")),
    )
    tables = _table_texts(catalog, column, "\n")
    lines = F.concat_ws("\n", F.concat("table_name", F.lit(":")), "cols")
    body = _with_fks(catalog, _schema_texts(tables, lines, "\n"), "%s -> %s")
    body = _with_links(body, semantic_links, "%s ≈ %s")
    database = F.when(
        F.lit(include_db_id) & (F.col("schema_id") != ""),
        F.concat(F.lit("[DATABASE]\n"), "schema_id"),
    )
    sections = [
        database,
        F.concat(F.lit("[TABLES]\n"), "body"),
        F.when(F.col("fk_text").isNotNull(), F.concat(F.lit("[FOREIGN KEYS]\n"), "fk_text")),
        F.when(F.col("link_text").isNotNull(), F.concat(F.lit("[SEMANTIC LINKS]\n"), "link_text")),
    ]
    return body.select("schema_id", F.concat_ws("\n\n", *sections).alias("text"))


def _with_links(body: DataFrame, links: DataFrame | None, form: str) -> DataFrame:
    """Attach ``links(schema_id, source, target, rank)`` as text lines, in rank order."""
    if links is None:
        return body.withColumn("link_text", F.lit(None).cast("string"))
    lines = links.groupBy("schema_id").agg(
        joined(F.format_string(form, "source", "target"), [F.col("rank")], "\n").alias("link_text")
    )
    return body.join(lines, "schema_id", "left")


def schema_text(
    catalog: Catalog,
    style: str = "structured",
    include_db_id: bool = True,
    semantic_links: DataFrame | None = None,
) -> DataFrame:
    """(schema_id, text) in one of the STYLES."""
    if style not in STYLES:
        raise ValueError(f"Unknown style: {style}. Choose from {list(STYLES)}")
    if style == "structured":
        return structured(catalog, include_db_id, semantic_links)
    plain = {"basic": basic, "detailed": detailed, "typed": typed, "compact": compact}[style]
    body = _with_links(plain(catalog), semantic_links, "Semantic Link: %s ≈ %s")
    prefix = F.concat(F.lit("Database: "), "schema_id") if include_db_id else F.lit(None).cast("string")
    return body.select("schema_id", F.concat_ws("\n", prefix, "text", "link_text").alias("text"))


# --- header texts of single-table records ------------------------------------------


def _header_or_table(records: DataFrame, catalog: Catalog, separator: str) -> DataFrame:
    """Header as one string; else the columns of the table named ``table``; else NULL."""
    plain = catalog.columns.where("table_name = 'table'")
    cols = plain.groupBy(F.col("schema_id").alias("id")).agg(
        joined(F.col("col_name"), [F.col("col_ord")], separator).alias("cols")
    )
    return records.join(cols, "id", "left").select(
        "id", F.coalesce(F.array_join("header", separator), "cols").alias("names")
    )


def header_text(records: DataFrame, catalog: Catalog) -> DataFrame:
    names = _header_or_table(records, catalog, ", ")
    return names.select(
        F.col("id").alias("schema_id"),
        F.concat(F.lit("Table columns: "), F.coalesce("names", F.lit("(unknown)"))).alias("text"),
    )


def header_text_structured(records: DataFrame, catalog: Catalog) -> DataFrame:
    names = _header_or_table(records, catalog, "\n    ")
    return names.select(
        F.col("id").alias("schema_id"),
        F.concat(
            F.lit("[TABLES]\ntable:\n    "), F.coalesce("names", F.lit("(unknown)"))
        ).alias("text"),
    )


# --- back from text to rows ------------------------------------------------------------


def text_to_columns(texts: DataFrame) -> DataFrame:
    """Columns named in ``texts(schema_id, schema)``.

    Inside ``[TABLES]`` a line ``x:`` opens a table and the lines after it are
    its columns; a table opened again with columns replaces the earlier one.
    Texts without such tables fall back to ``table: column`` lines.
    """
    line = F.col("line")
    lines = (
        texts.select("schema_id", F.posexplode(F.split("schema", "\n")).alias("line_ord", "raw"))
        .select("schema_id", "line_ord", strip(F.col("raw")).alias("line"))
        .where(line != "")
    )
    # All windows lie within a text: the lines are shuffled once.
    by_line = Window.partitionBy("schema_id").orderBy("line_ord")
    section = Window.partitionBy("schema_id", "section").orderBy("line_ord")
    is_tables = line == "[TABLES]"
    leaves = line.startswith("[") & line.endswith("]") & ~is_tables
    opens = F.col("inside") & line.endswith(":") & ~is_tables
    opened = unquote(strip(F.expr("substring(line, 1, length(line) - 1)")))
    col = F.col("col")
    is_column = (
        F.col("inside") & ~is_tables & ~leaves & ~opens & (F.col("current.name") != "")
        & (col != "") & ~col.startswith("#") & ~col.startswith("--")
    )
    state = (
        lines.withColumn("section", F.sum(leaves.cast("int")).over(by_line))
        .withColumn("inside", F.max(is_tables).over(section))
        .withColumn("opener", F.when(opens, F.struct("line_ord", opened.alias("name"))))
        .withColumn("current", F.last("opener", ignorenulls=True).over(section))
        .withColumn("col", unquote(strip(F.substring_index(line, "(", 1))))
        .withColumn("column_of", F.when(is_column, F.col("current.name")))
        .withColumn(
            "last_opened",
            F.max("current.line_ord").over(Window.partitionBy("schema_id", "column_of")),
        )
        .withColumn("found", F.max(F.col("column_of").isNotNull()).over(Window.partitionBy("schema_id")))
    )
    listed = F.col("column_of").isNotNull() & (F.col("current.line_ord") == F.col("last_opened"))
    parts = F.split(line, ":")
    pair = F.struct(
        strip(F.get(parts, F.lit(0))).alias("table"),
        strip(F.substring_index(strip(F.get(parts, F.lit(1))), "(", 1)).alias("col"),
    )
    is_pair = ~F.col("found") & ~line.startswith("[") & ~line.startswith("#") & (F.size(parts) == 2)
    return (
        state.where(listed | is_pair)
        .withColumn("pair", pair)
        .select(
            "schema_id",
            F.when(listed, F.col("column_of")).otherwise(F.col("pair.table")).alias("table_name"),
            "line_ord",
            F.when(listed, col).otherwise(F.col("pair.col")).alias("col_name"),
        )
        .where("table_name <> '' AND col_name <> ''")
    )
