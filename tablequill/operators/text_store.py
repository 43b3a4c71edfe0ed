"""Schema texts of DDL kept across runs.

A store is a folder with one Parquet table per generation, partitioned by the
rules, the style and the mode of reading the DDL. A row is found by the hash of
its DDL, so a row never changes: a run reads the newest generation, parses only
the DDL texts it does not find, and appends them.

Two runs at once may both append the same text; readers keep one of the equal
rows. ``compact`` writes the next generation with every text once, in few files.
Rows that another run appends to the old generation meanwhile are parsed again
by the next run that needs them: a store can be behind, never wrong.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablequill.operators import catalog as C
from tablequill.operators.corpora import ddl_id, table_counts
from tablequill.operators.schema_text import STYLES, schema_text
from tablequill.session import settle

# Raised whenever the texts or counts of a DDL change: older rows are left unread.
RULES = 1
KEY = ["rules", "style", "strict"]
SCHEMA = "schema_id string, schema string, num_tables int, rules int, style string, strict boolean"


def _path(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _generation(store: str, number: int) -> str:
    return f"{store.rstrip('/')}/generation-{number:06d}"


def _generations(spark: SparkSession, store: str) -> list[int]:
    """Numbers of the complete generations, ascending."""
    files, folder = _path(spark, store)
    if not files.exists(folder):
        return []
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    numbers = sorted(int(n.split("-")[1]) for n in names if n.startswith("generation-"))
    return [n for n in numbers if files.exists(_path(spark, f"{_generation(store, n)}/_SUCCESS")[1])]


def _read(spark: SparkSession, store: str) -> DataFrame:
    done = _generations(spark, store)
    if not done:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(_generation(store, done[-1]))


def stored_texts(spark: SparkSession, store: str, style: str, strict: bool = False) -> DataFrame:
    """(schema_id, schema, num_tables) of the store; equal rows of two runs may both be there.

    DDL without tables has no text and the count 0, so it is not parsed again.
    """
    kept = (F.col("rules") == RULES) & (F.col("style") == style) & (F.col("strict") == F.lit(strict))
    return _read(spark, store).where(kept).drop(*KEY)


def ddl_texts(
    corpus: DataFrame, store: str, style: str = "structured", strict: bool = False
) -> DataFrame:
    """(schema_id, schema, num_tables), one row per distinct ``ddl`` of ``corpus``.

    Extends the store by the texts it lacks. NULL is not a DDL text and has no
    row; an empty text is one like any other. Other columns are not read.
    """
    if style not in STYLES:
        raise ValueError(f"Unknown style: {style}. Choose from {list(STYLES)}")
    spark = corpus.sparkSession
    keyed = corpus.where(F.col("ddl").isNotNull()).select(ddl_id(F.col("ddl")).alias("schema_id"), "ddl")
    seen = stored_texts(spark, store, style, strict).select("schema_id")
    # Combined before the shuffle: a DDL text that most rows have is sent once a task.
    unseen = settle(
        keyed.dropDuplicates(["schema_id"]).join(seen, "schema_id", "left_anti"), "unseen"
    )
    if not unseen.isEmpty():
        catalog = C.store(C.catalog_from_ddl(unseen, strict))
        texts = schema_text(catalog, style, False).withColumnRenamed("text", "schema")
        known = texts.join(table_counts(catalog), "schema_id")
        rows = unseen.select("schema_id").join(known, "schema_id", "left").select(
            "schema_id", "schema", F.coalesce("num_tables", F.lit(0)).alias("num_tables"),
            F.lit(RULES).alias("rules"), F.lit(style).alias("style"), F.lit(strict).alias("strict"),
        )
        newest = (_generations(spark, store) or [0])[-1]
        rows.write.mode("append").partitionBy(*KEY).parquet(_generation(store, newest))
    own = keyed.select("schema_id").distinct()
    texts = stored_texts(spark, store, style, strict).join(own, "schema_id", "left_semi")
    return texts.dropDuplicates(["schema_id"])


def compact(spark: SparkSession, store: str) -> None:
    """Write the next generation: every text once; rows of older rules drop out.

    The generation before stays for jobs that still read it, older ones are removed.
    An attempt that broke off is written anew.
    """
    done = _generations(spark, store)
    if not done:
        return
    current = _read(spark, store).where(F.col("rules") == RULES)
    once = current.dropDuplicates([*KEY, "schema_id"])
    once.write.mode("overwrite").partitionBy(*KEY).parquet(_generation(store, done[-1] + 1))
    for number in done[:-1]:
        files, folder = _path(spark, _generation(store, number))
        files.delete(folder, True)
