"""Readers; every source has an explicit schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablequill.constants import UNKNOWN
from tablequill.functions.scale import attach, bucket_offsets
from tablequill.session import settle

EXAMPLE_SCHEMA = (
    "example_id string, dataset string, split string, schema_id string, question string,"
    " sql string, schema string, input string, output string, num_tables int,"
    " has_join boolean, complexity string, source string"
)
# Mixed arrays such as [0, "name"] are read as strings and cast where used.
CATALOG_RECORD_SCHEMA = (
    "db_id string, table_names_original array<string>,"
    " column_names_original array<array<string>>, column_types array<string>,"
    " primary_keys array<int>, foreign_keys array<array<int>>"
)
CATALOG_EXAMPLE_SCHEMA = "db_id string, question string, query string"
SINGLE_TABLE_SCHEMA = (
    "id string, header array<string>, types array<string>, page_title string"
)
LOGICAL_FORM_SCHEMA = (
    "phase int, table_id string, question string,"
    " sql struct<sel: int, agg: int, conds: array<array<variant>>>"
)


def read_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One JSON object per line; blank lines are skipped, a malformed line stops the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Files that each hold one JSON array of records; a malformed file stops the job.

    One file is one task; ``read_large_array`` cuts files, for three passes over the text.
    """
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def split_path(folder: str, split: str, train_file: str, dev_file: str) -> str:
    """Path of a split; every split but ``train`` reads the development file."""
    return f"{folder}/{train_file if split == 'train' else dev_file}"


def read_logical_form(spark: SparkSession, path: str) -> DataFrame:
    """Logical-form examples; a condition value keeps whether it was a string."""
    raw = read_lines(spark, path, LOGICAL_FORM_SCHEMA)

    def condition(c: Column) -> Column:
        value = F.get(c, F.lit(2))
        return F.struct(
            F.variant_get(F.get(c, F.lit(0)), "$", "int").alias("col"),
            F.variant_get(F.get(c, F.lit(1)), "$", "int").alias("op"),
            F.variant_get(value, "$", "string").alias("value"),
            (F.schema_of_variant(value) == "STRING").alias("is_str"),
        )

    return raw.select(
        "phase",
        "table_id",
        "question",
        "sql.sel",
        F.coalesce("sql.agg", F.lit(0)).alias("agg"),
        F.coalesce(
            F.transform("sql.conds", condition),
            F.array().cast("array<struct<col:int,op:int,value:string,is_str:boolean>>"),
        ).alias("conds"),
    )


def _running(pieces: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all earlier pieces of the file: sums of blocks, then inside a block."""
    place = ["_file", "_block"]
    offsets = bucket_offsets(pieces, ["_file"], ["_block"], {"_sum": F.sum(value)})
    inside = Window.partitionBy(*place).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        pieces.join(offsets.select(*place, "_sum_before"), place)
        .withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col("_sum_before"))
        .drop("_sum_before")
    )


def read_large_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Records of files that hold one JSON array of objects each, a file read by many tasks.

    Files are cut at every closing brace, wherever the blocks of the file begin.
    Whether a piece begins inside a string follows from the number of quotes
    before it, its depth from the brackets outside of strings; both are prefix
    sums over blocks and inside a block. An object of the array ends where the
    depth returns to that of the array; its pieces are put together by one
    shuffle. Records come in no particular order; what is no object is skipped, an
    object that is no valid JSON stops the job.
    """
    raw = spark.read.option("lineSep", "}").text(path)
    quotes = F.regexp_count(F.regexp_replace("value", r"(?s)\\.", ""), F.lit('"'))
    pieces = settle(
        raw.select(
            "value", F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_row"), (quotes % 2).alias("_odd"),
        ),
        "pieces",
    )
    placed = _running(pieces, F.col("_odd"), "_quotes")
    quoted = F.col("_quotes") % 2 == 1
    still = (F.col("_quotes") + F.col("_odd")) % 2 == 1
    text = F.concat(F.when(quoted, '"').otherwise(""), "value")
    bare = F.regexp_replace(text, r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|$)', "")
    opened = F.length(bare) - F.length(F.translate(bare, "{[", ""))
    closed = F.length(bare) - F.length(F.translate(bare, "]", "")) + F.when(still, 0).otherwise(1)
    deep = settle(placed.select("value", "_file", "_block", "_row", still.alias("_still"), (opened - closed).alias("_step")), "depths")
    deep = _running(deep, F.col("_step"), "_depth")
    ends = (~F.col("_still") & (F.col("_depth") + F.col("_step") == 1)).cast("int")
    ended = settle(deep.select("value", "_file", "_block", "_row", ends.alias("_end")), "ends")
    numbered = _running(ended, F.col("_end"), "_record")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_row", "value"))), lambda p: p["value"])
    records = numbered.groupBy("_file", "_record").agg(
        F.concat(F.array_join(parts, "}"), F.lit("}")).alias("text"), F.max("_end").alias("whole")
    ).where("whole = 1")
    one = F.regexp_replace("text", r"^[^{]*", "")
    return records.select(F.from_json(one, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def with_ordinal(df: DataFrame, name: str = "ord") -> DataFrame:
    """Dense position of every row of a Parquet source: files by path, rows as stored.

    Spark numbers the rows of a file itself; only the row counts of the files
    are summed up, and the rows stay where they are.
    """
    rows = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias("_row"),
    )
    counts = df.select(F.col("_metadata.file_path").alias("_file")).groupBy("_file").agg(
        F.count("*").alias("_n")
    )
    # one row per file reaches this window
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return (
        attach(rows, offsets, ["_file"], ["_row"])
        .withColumn(name, F.col("_before") + F.col("_row"))
        .drop("_file", "_row", "_before")
    )


def with_line_ordinal(rows: DataFrame, name: str = "ord") -> DataFrame:
    """Dense position of every row of a text or JSON source: files by path, rows as they stand.

    ``rows`` must read the source itself. Spark reads a file in blocks, each as
    one run of a task's rows, so a row's place is (file, start of the block,
    place in the run). The rows are stored with it; counts per block are summed
    up per file and then over files, and no row moves or is sorted.
    """
    placed = settle(
        rows.select(
            "*",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "lines",
    )
    blocks = placed.groupBy("_file", "_block").agg(
        F.min("_row").alias("_first"), F.count("*").alias("_n")
    )
    files = blocks.groupBy("_file").agg(F.sum("_n").alias("_all"))
    # one row per file reaches this window, one per block of a file the other
    by_file = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    by_block = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("_file", F.coalesce(F.sum("_all").over(by_file), F.lit(0)).alias("_start"))
    offsets = blocks.join(starts, "_file").select(
        "_file", "_block",
        (F.col("_start") + F.coalesce(F.sum("_n").over(by_block), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    return (
        attach(placed, offsets, ["_file", "_block"], ["_row"])
        .withColumn(name, F.col("_row") + F.col("_shift"))
        .drop("_file", "_block", "_row", "_shift")
    )


# --- renaming of hub corpora -----------------------------------------------------

DDL_CONTEXT = {"question": "question", "answer": "sql", "context": "ddl"}
SYNTHETIC = {
    "sql_prompt": "question", "sql": "sql", "sql_context": "ddl", "sql_complexity": "complexity",
}
INSTRUCTIONS = {"instruction": "instruction", "output": "sql", "source": "source"}


def rename_corpus(corpus: DataFrame, names: dict[str, str]) -> DataFrame:
    """Keep and rename the columns of one corpus; a missing source is ``unknown``."""
    other = [c for c in corpus.columns if c in ("example_id", "ord", "dataset", "split")]
    renamed = corpus.select(
        *other, *[F.col(old).alias(new) for old, new in names.items() if old in corpus.columns]
    )
    if "source" in names.values():
        known = F.col("source") if "source" in renamed.columns else F.lit(None).cast("string")
        renamed = renamed.withColumn("source", F.coalesce(known, F.lit(UNKNOWN)))
    return renamed


# --- rows per key ------------------------------------------------------------------


def last_by_key(records: DataFrame, key: str, position: str) -> DataFrame:
    """Of records with the same key the last one stays (map-side combined)."""
    rest = [c for c in records.columns if c != key]
    return (
        records.groupBy(key).agg(F.max_by(F.struct(*rest), position).alias("r")).select(key, "r.*")
    )


def first_schema_per_db(
    joined: DataFrame, payload: list[str], position: str, splits: tuple[str, ...] = ("train", "validation")
) -> DataFrame:
    """Schema catalog of a corpus that repeats the schema in every example.

    The first row of a database counts, earlier splits before later ones, and
    splits that are not listed (or NULL) last.
    """
    names = F.array(*[F.lit(s) for s in splits])
    place = F.coalesce(F.array_position(names, F.col("split")), F.lit(0))
    rank = F.when(place == 0, len(splits) + 1).otherwise(place)
    order = F.struct(rank.alias("rank"), F.col(position))
    return (
        joined.groupBy("db_id")
        .agg(F.min_by(F.struct(*payload), order).alias("r"))
        .select("db_id", "r.*")
    )


def split_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("dataset", "split").agg(F.count("*").alias("rows"))


def file_counts(rows: DataFrame, name: str | None = None) -> DataFrame:
    """Rows per file of a file source.

    With ``name`` the source counts as one file of this name, though it be a
    folder of many part files, or without rows.
    """
    if name is not None:
        return rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("file_name"), "rows")
    file = F.col("_metadata.file_name").alias("file_name")
    return rows.select(file).groupBy("file_name").agg(F.count("*").alias("rows"))


def schema_counts(records: DataFrame) -> DataFrame:
    """Number of schemas, and of those with tables."""
    return records.agg(
        F.count("*").alias("schemas"),
        F.count_if(F.size("table_names_original") > 0).alias("with_tables"),
    )
