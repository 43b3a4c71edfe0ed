"""Writers: JSON lines in plain, instruction and chat form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablequill import constants as K
from tablequill.functions.scale import hash_order
from tablequill.operators.prompts import answer_of
from tablequill.session import DROP_SHUFFLES, folder_bytes, session_conf


def write_lines(examples: DataFrame, path: str) -> None:
    """One JSON object per line; absent values are left out."""
    examples.write.json(path)


def _user_text() -> Column:
    return F.concat("schema", F.lit("\n\nQuestion: "), "question")


def _line(examples: DataFrame) -> list[Column]:
    return [F.col(c) for c in examples.columns]


def _instruction(examples: DataFrame) -> list[Column]:
    return [
        F.lit(K.INSTRUCTION).alias("instruction"),
        _user_text().alias("input"),
        answer_of(examples).alias("output"),
    ]


def instruction_records(examples: DataFrame) -> DataFrame:
    return examples.select(*_instruction(examples))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _chat(examples: DataFrame) -> list[Column]:
    messages = F.array(
        _message("system", F.lit(K.CHAT_SYSTEM)),
        _message("user", _user_text()),
        _message("assistant", answer_of(examples)),
    )
    return [messages.alias("messages")]


def chat_records(examples: DataFrame) -> DataFrame:
    return examples.select(*_chat(examples))


def write_partitioned(examples: DataFrame, path: str) -> None:
    """One folder per dataset and split; the combined corpus is their union.

    Files stay near ``maxRecordsPerFile`` rows, so a large dataset is written
    by many tasks.
    """
    (
        examples.write.partitionBy("dataset", "split").option("maxRecordsPerFile", 1_000_000)
        .option("compression", "zstd").parquet(path)
    )


# Splits that have records, and the setting for the files that a task may hold open.
RECORD_SPLITS = ("train", "dev")
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
FORMATS = {"lines": _line, "instruction": _instruction, "chat": _chat}
# Codec of Spark's own jars that writes text as zstd; Spark (from 4.1 on) reads it by its file name.
CODECS = {"zstd": "org.apache.parquet.hadoop.codec.ZstandardCodec"}
# Ranges of the shuffled order that are sorted one after the other, if there is more to sort than this.
ROUNDS = 4
ROUND_BYTES = 32 * 1024 * 1024
# Settings for how many tasks a range has at most.
PARTITIONS = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")


def in_shuffled_order(train: DataFrame, seed: int = 42) -> DataFrame:
    """Rows in a reproducible random order, spread over all tasks by range."""
    order = hash_order(seed, F.col("example_id"))
    return (
        train.withColumn("_order", order)
        .repartitionByRange("_order", "example_id")
        .sortWithinPartitions("_order", "example_id")
        .drop("_order")
    )


def _rounds(place: Column, n: int) -> list[Column]:
    """Conditions for the dev rows, and for ``n`` (up to 16) ranges of the train rows in their order."""
    digit = F.coalesce(F.substring(place, 1, 1), F.lit(""))
    train = F.col("split") == "train"
    cuts = [f"{16 * i // n:x}" for i in range(1, n)]
    lows = [train, *[train & (digit >= c) for c in cuts]]
    highs = [*[digit < c for c in cuts], F.lit(True)]
    return [F.col("split") == "dev", *[low & high for low, high in zip(lows, highs)]]


def write_corpus(
    examples: DataFrame, folder: str, formats: tuple[str, ...] = tuple(FORMATS), seed: int = 42,
    position: str = "example_id", compression: str = "zstd",
) -> None:
    """All outputs of a preparation: per dataset, and combined in every format.

    ``folder/datasets`` is partitioned by dataset and split; ``examples`` is
    computed once, for it. From there one sort by range gives the lines of all
    formats, ``folder/records/format=.../split=...``, in the order of the file
    names: train shuffled by ``seed``, dev by dataset and ``position``. A large
    corpus is read again for every range of this order, so that only a part of it
    lies in shuffle files at a time. The lines repeat every text per format, so
    they are packed; ``none`` leaves them plain.
    """
    spark = examples.sparkSession
    # The rows are sorted, not the lines made from them: a task keeps one file open per
    # format and split, so its lines need no order by folder.
    open_files = session_conf(spark, OPEN_FILES, str(len(RECORD_SPLITS) * len(formats)))
    with session_conf(spark, DROP_SHUFFLES, "true"), open_files:
        write_partitioned(examples, f"{folder}/datasets")
        rows = (
            spark.read.schema(examples.schema).parquet(f"{folder}/datasets")
            .select(*examples.columns).where(F.col("split").isin(*RECORD_SPLITS))
        )
        shuffled = hash_order(seed, F.col("example_id"))
        rounds = [F.lit(True)]
        if folder_bytes(spark, f"{folder}/datasets") > ROUND_BYTES:
            rounds = _rounds(shuffled, ROUNDS)
        lines = [
            F.struct(F.lit(name).alias("format"), F.to_json(F.struct(*FORMATS[name](rows))).alias("value"))
            for name in formats
        ]
        # not shuffled with the rows but computed again
        place = F.when(F.col("split") == "train", shuffled).otherwise(F.col("dataset"))
        partitions = max(int(spark.conf.get(c, None) or 1) for c in PARTITIONS)
        for i, chosen in enumerate(rounds):
            packed = (
                rows.where(chosen).repartitionByRange("split", place, position).withColumn("_place", place)
                .sortWithinPartitions("split", "_place", position)
                .select("split", F.explode(F.array(*lines)).alias("_line"))
                .select("_line.format", "split", "_line.value")
            )
            if i:
                # the names of files begin with the number of the task: empty ones come first
                before = spark.range(0, i * partitions, 1, i * partitions).where("id < 0")
                packed = before.select(
                    *[F.lit(None).cast("string").alias(c) for c in packed.columns]
                ).unionAll(packed)
            (
                packed.write.mode("append" if i else "error").partitionBy("format", "split")
                .option("compression", CODECS.get(compression, compression))
                # zstd's fifth level: files an eighth smaller than of its usual one, and half of gzip's
                .option("parquet.compression.codec.zstd.level", "5")
                # gzip's quickest level: a third of the usual one's time, files a sixth larger
                .option("zlib.compress.level", "BEST_SPEED").text(f"{folder}/records")
            )
