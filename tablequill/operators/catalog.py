"""Database schemas as node and edge tables.

A ``Catalog`` holds three frames keyed by ``schema_id``:

tables  (schema_id, table_ord, table_name)
columns (schema_id, table_ord, table_name, col_ord, col_name, dtype, is_pk,
         is_fk, fk_table, fk_column)
fks     (schema_id, fk_ord, from_table, from_column, to_table, to_column)

Edges are derived from them, see ``edges``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablequill import constants as K
from tablequill.functions.text import one_of, words
from tablequill.operators import ddl
from tablequill.session import settle

TABLE_COLUMN, FOREIGN_KEY, TABLE_TABLE = "table_column", "foreign_key", "table_table"


@dataclass(frozen=True)
class Catalog:
    tables: DataFrame
    columns: DataFrame
    fks: DataFrame
    # Column definitions as they were read; differs from ``columns`` only where a
    # table name is defined more than once.
    definitions: DataFrame | None = None


def _first_of_name() -> Column:
    """Whether a column is the first of its name in its table."""
    same = Window.partitionBy("schema_id", "table_name", "col_name").orderBy("col_ord")
    return F.row_number().over(same) == 1


def mark_foreign_keys(columns: DataFrame, fks: DataFrame) -> DataFrame:
    """Set is_fk and the reference; of several references of a column the last wins.

    Where a table has two columns of the same name, the first is marked. Join
    and window share one partitioning.
    """
    refs = fks.groupBy(
        "schema_id", F.col("from_table").alias("table_name"), F.col("from_column").alias("col_name")
    ).agg(F.max_by(F.struct("to_table", "to_column"), "fk_ord").alias("ref"))
    bare = columns.drop("is_fk", "fk_table", "fk_column")
    return (
        bare.join(refs, ["schema_id", "table_name", "col_name"], "left")
        .withColumn("_first", _first_of_name())
        .withColumn("ref", F.when(F.col("_first"), F.col("ref")))
        .select(
            *columns_of(bare),
            F.col("ref").isNotNull().alias("is_fk"),
            F.col("ref.to_table").alias("fk_table"),
            F.col("ref.to_column").alias("fk_column"),
        )
    )


def mark_primary_keys(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """Set is_pk on the first column of that name, for ``keys(schema_id, table_name, col_name)``."""
    marked = keys.distinct().withColumn("_key", F.lit(True))
    return (
        columns.join(marked, ["schema_id", "table_name", "col_name"], "left")
        .withColumn("_first", _first_of_name())
        .withColumn("is_pk", F.col("is_pk") | (F.col("_first") & F.col("_key").isNotNull()))
        .select(*columns_of(columns))
    )


def columns_of(df: DataFrame) -> list[str]:
    order = [
        "schema_id", "table_ord", "table_name", "col_ord", "col_name", "dtype",
        "is_pk", "is_fk", "fk_table", "fk_column",
    ]
    return [c for c in order if c in df.columns]


# --- multi-table catalog records ---------------------------------------------


def record_tables(records: DataFrame) -> DataFrame:
    return records.select(
        F.col("db_id").alias("schema_id"),
        F.posexplode("table_names_original").alias("table_ord", "table_name"),
    )


def record_columns(records: DataFrame) -> DataFrame:
    """Column rows; ``col_ord`` is the global index of the column in its record."""
    exploded = records.select(
        F.col("db_id").alias("schema_id"),
        "table_names_original",
        "column_types",
        "primary_keys",
        F.posexplode("column_names_original").alias("col_ord", "pair"),
    ).withColumn("table_ord", F.get("pair", F.lit(0)).cast("int"))
    return exploded.where(F.col("table_ord") != -1).select(
        "schema_id",
        "table_ord",
        F.get("table_names_original", F.col("table_ord")).alias("table_name"),
        "col_ord",
        F.get("pair", F.lit(1)).alias("col_name"),
        F.coalesce(F.get("column_types", F.col("col_ord")), F.lit("text")).alias("dtype"),
        F.array_contains("primary_keys", F.col("col_ord")).alias("is_pk"),
    )


def record_foreign_keys(records: DataFrame, columns: DataFrame) -> DataFrame:
    """Index pairs resolved to names; pairs with ``*`` or an unknown index drop out."""
    pairs = records.select(
        F.col("db_id").alias("schema_id"), F.posexplode("foreign_keys").alias("fk_ord", "pair")
    ).select(
        "schema_id",
        "fk_ord",
        F.get("pair", F.lit(0)).cast("int").alias("from_idx"),
        F.get("pair", F.lit(1)).cast("int").alias("to_idx"),
    )
    names = columns.select("schema_id", "col_ord", "table_name", "col_name")
    source = names.toDF("schema_id", "from_idx", "from_table", "from_column")
    target = names.toDF("schema_id", "to_idx", "to_table", "to_column")
    return (
        pairs.join(source, ["schema_id", "from_idx"])
        .join(target, ["schema_id", "to_idx"])
        .select("schema_id", "fk_ord", "from_table", "from_column", "to_table", "to_column")
    )


def catalog_from_records(records: DataFrame) -> Catalog:
    columns = record_columns(records)
    fks = record_foreign_keys(records, columns)
    return Catalog(record_tables(records), mark_foreign_keys(columns, fks), fks)


# --- single-table records ------------------------------------------------------


def clean_title(title: Column) -> Column:
    """Table name from a page title; ``table`` if there is none."""
    name = F.regexp_replace(F.translate(title, " -", "__"), r"[^\p{L}\p{N}_]", "")
    return F.when(F.coalesce(title, F.lit("")) == "", F.lit("table")).otherwise(name)


def catalog_from_single_tables(records: DataFrame) -> Catalog:
    """``records(id, page_title, header, types)``; the first column is the key.

    Header and types are paired up to the shorter one; without types every
    column is text.
    """
    named = records.select(
        F.col("id").alias("schema_id"),
        F.lit(0).alias("table_ord"),
        clean_title(F.col("page_title")).alias("table_name"),
        "header",
        F.coalesce(
            F.col("types"), F.transform("header", lambda h: F.lit("text"))
        ).alias("types"),
    )
    n = F.least(F.size("header"), F.size("types"))
    columns = named.select(
        "schema_id",
        "table_ord",
        "table_name",
        F.posexplode(F.slice(F.arrays_zip("header", "types"), F.lit(1), n)).alias("col_ord", "c"),
    ).select(
        "schema_id",
        "table_ord",
        "table_name",
        "col_ord",
        F.col("c.header").alias("col_name"),
        F.col("c.types").alias("dtype"),
        (F.col("col_ord") == 0).alias("is_pk"),
        F.lit(False).alias("is_fk"),
        F.lit(None).cast("string").alias("fk_table"),
        F.lit(None).cast("string").alias("fk_column"),
    )
    spark = records.sparkSession
    none = spark.createDataFrame(
        [],
        "schema_id string, fk_ord int, from_table string, from_column string,"
        " to_table string, to_column string",
    )
    return Catalog(named.select("schema_id", "table_ord", "table_name"), columns, none)


# --- DDL texts -----------------------------------------------------------------


def fold_type(raw: Column) -> Column:
    low = F.lower(raw)
    return (
        F.when(low.isNull(), F.lit("text"))
        .when(one_of(low, K.TEXT_TYPES), F.lit("text"))
        .when(one_of(low, K.NUMBER_TYPES), F.lit("number"))
        .otherwise(low)
    )


def ddl_definitions(ddls: DataFrame) -> DataFrame:
    """One row per table definition found in ``ddls(schema_id, ddl)``.

    The table ends at the first closing parenthesis, so ``VARCHAR(255)`` cuts
    it short: a property of the format that training sets rely on. ``cols`` has
    the columns of the definition. A name that is defined again keeps its first
    place (``table_ord``), and only its last definition counts (``is_last``).
    """
    pattern = F.lit(K.DDL_TABLE_PATTERN)
    name, place = F.col("d.name"), F.col("def_ord")
    last = F.size("names") - F.array_position(F.reverse("names"), name)
    found = ddls.select(
        "schema_id",
        F.regexp_extract_all("ddl", pattern, F.lit(1)).alias("names"),
        F.regexp_extract_all("ddl", pattern, F.lit(2)).alias("bodies"),
    )

    def column(text: Column, place: Column) -> Column:
        w, upper = words(text), F.upper(text)
        return F.struct(
            place.alias("col_ord"),
            F.get(w, F.lit(0)).alias("col_name"),
            fold_type(F.get(w, F.lit(1))).alias("dtype"),
            (upper.contains("PRIMARY") & upper.contains("KEY")).alias("is_pk"),
        )

    cols = F.filter(
        F.transform(F.split("body", ","), column), lambda c: c["col_name"].isNotNull()
    )
    pairs = F.arrays_zip(F.col("names").alias("name"), F.col("bodies").alias("body"))
    return (
        found.select("schema_id", "names", F.posexplode(pairs).alias("def_ord", "d"))
        .select(
            "schema_id",
            "def_ord",
            name.alias("table_name"),
            (F.array_position("names", name) - 1).cast("int").alias("table_ord"),
            (last == place).alias("is_last"),
            F.col("d.body").alias("body"),
        )
        .select("schema_id", "def_ord", "table_name", "table_ord", "is_last", cols.alias("cols"))
    )


def ddl_columns(definitions: DataFrame) -> DataFrame:
    """Column rows of all definitions, also of those that are defined again later."""
    return definitions.select(
        "schema_id", "def_ord", "table_name", "table_ord", "is_last", F.explode("cols").alias("c")
    ).select("schema_id", "def_ord", "table_name", "table_ord", "is_last", "c.*")


def infer_foreign_keys(tables: DataFrame, columns: DataFrame, candidates: DataFrame) -> DataFrame:
    """``x_id`` refers to the first table named ``x``, whatever the case.

    The target is the first key column, else the last column named ``id`` or
    like the referring column; a table never refers to itself.
    ``candidates(schema_id, def_ord, col_ord, table_name, col_name)``.
    """
    referring = candidates.where(F.lower("col_name").endswith("_id")).select(
        "schema_id",
        "def_ord",
        "col_ord",
        F.col("table_name").alias("from_table"),
        F.col("col_name").alias("from_column"),
        F.regexp_replace(F.lower("col_name"), "_id$", "").alias("base"),
    )
    named = tables.groupBy("schema_id", F.lower("table_name").alias("base")).agg(
        F.min_by("table_name", "table_ord").alias("to_table")
    )
    hits = referring.join(named, ["schema_id", "base"])
    # Per table the first key column and the last column named id; per name the last column.
    low = F.lower("col_name")
    position = F.struct(F.col("col_ord").alias("o"), F.col("col_name").alias("n"))
    by_table = columns.groupBy("schema_id", F.col("table_name").alias("to_table")).agg(
        F.min(F.when(F.col("is_pk"), position)).alias("key_col"),
        F.max(F.when(low == "id", position)).alias("id_col"),
    )
    by_name = columns.groupBy(
        "schema_id", F.col("table_name").alias("to_table"), low.alias("low")
    ).agg(F.max(position).alias("same_col"))
    resolved = (
        hits.withColumn("low", F.lower("from_column"))
        .join(by_table, ["schema_id", "to_table"])
        .join(by_name, ["schema_id", "to_table", "low"], "left")
    )
    last_named = F.greatest("id_col", "same_col")["n"]
    return (
        resolved.withColumn("to_column", F.coalesce(F.col("key_col.n"), last_named))
        .where(F.col("to_column").isNotNull() & (F.col("from_table") != F.col("to_table")))
        .select(
            "schema_id",
            # total order of the referring columns: definition, then position
            (F.col("def_ord").cast("long") * F.lit(1 << 20) + F.col("col_ord")).alias("fk_ord"),
            "from_table",
            "from_column",
            "to_table",
            "to_column",
        )
    )


def catalog_from_ddl(ddls: DataFrame, strict: bool = False) -> Catalog:
    """The catalog of ``ddls(schema_id, ddl)``.

    With ``strict`` nested parentheses, quoted and dotted names, comments and
    clauses of keys are read as SQL has them (``ddl.definitions``), and declared
    references come before inferred ones; without, as the corpora's own format
    has it (``ddl_definitions``).
    """
    # Read by every branch below: the texts are parsed once.
    found = ddl.definitions(ddls, fold_type) if strict else ddl_definitions(ddls)
    definitions = settle(found, "definitions")
    every = ddl_columns(definitions)
    tables = definitions.where(F.col("def_ord") == F.col("table_ord")).select(
        "schema_id", "table_ord", "table_name"
    )
    columns = every.where("is_last").select(
        "schema_id", "table_ord", "table_name", "col_ord", "col_name", "dtype", "is_pk"
    )
    fks = infer_foreign_keys(tables, columns, every)
    if strict:
        declared = ddl.declared_foreign_keys(definitions, columns)
        own = ["schema_id", "from_table", "from_column"]
        fks = declared.unionByName(fks.join(declared.select(*own).distinct(), own, "left_anti"))
    return Catalog(tables, mark_foreign_keys(columns, fks), fks, every)


def store(catalog: Catalog) -> Catalog:
    """The catalog as stored tables, for jobs that read it more than once."""
    return Catalog(
        settle(catalog.tables, "tables"),
        settle(catalog.columns, "columns"),
        settle(catalog.fks, "fks"),
        catalog.definitions,
    )


# --- edges, lookups ---------------------------------------------------------------


def edges(catalog: Catalog) -> DataFrame:
    """Containment edges, then a column edge and a table edge per foreign key."""
    source = catalog.columns if catalog.definitions is None else catalog.definitions
    contains = source.select(
        "schema_id",
        F.col("table_name").alias("source"),
        F.concat_ws(".", "table_name", "col_name").alias("target"),
        F.lit(TABLE_COLUMN).alias("edge_type"),
    )
    by_column = catalog.fks.select(
        "schema_id",
        F.concat_ws(".", "from_table", "from_column").alias("source"),
        F.concat_ws(".", "to_table", "to_column").alias("target"),
        F.lit(FOREIGN_KEY).alias("edge_type"),
    )
    by_table = catalog.fks.select(
        "schema_id",
        F.col("from_table").alias("source"),
        F.col("to_table").alias("target"),
        F.lit(TABLE_TABLE).alias("edge_type"),
    )
    return contains.unionByName(by_column).unionByName(by_table)


def primary_keys(columns: DataFrame) -> DataFrame:
    return columns.where("is_pk")


def foreign_keys(columns: DataFrame) -> DataFrame:
    return columns.where("is_fk")


def edges_of_type(all_edges: DataFrame, edge_type: str) -> DataFrame:
    return all_edges.where(F.col("edge_type") == edge_type)


def summary(catalog: Catalog) -> DataFrame:
    """Tables and edges per schema."""
    tables = catalog.tables.groupBy("schema_id").agg(F.count("*").alias("n_tables"))
    links = edges(catalog).groupBy("schema_id").agg(F.count("*").alias("n_edges"))
    return tables.join(links, "schema_id", "left").select(
        "schema_id", "n_tables", F.coalesce("n_edges", F.lit(0)).alias("n_edges")
    )
