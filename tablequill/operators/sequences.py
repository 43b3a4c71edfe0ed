"""Fixed-length id sequences over a vocabulary that is a Spark aggregate."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablequill.functions.scale import range_row_number
from tablequill.functions.text import words
from tablequill.session import settle

PAD = 0
# The most frequent words, but for very long ones: few enough to go to every task,
# and no other word can hold more than 1 / HOT_WORDS of all tokens.
HOT_WORDS = 100_000
HOT_CHARS = 100
# Texts that a Python task splits at a time.
ROWS = 2000


def vocabulary(texts: DataFrame, column: str = "text") -> DataFrame:
    """(word, occurrences, word_id): ids from 1, most frequent word first.

    Words are ranked by ranges of (count, word), so no task sorts the whole
    vocabulary, nor all words of one count.
    """
    counts = (
        texts.select(F.explode(words(F.col(column))).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("occurrences"))
    )
    order = [F.col("occurrences").desc(), F.col("word").asc()]
    return range_row_number(counts, order, "word_id").select("word", "occurrences", "word_id")


def _coder(hot: pa.Table, max_length: int):
    """Function from batches of (_row, example_id, text) to their ids, a row per text.

    Splitting, at the white space of ``functions.text``, stops after ``max_length``
    words. A word of ``hot`` becomes its id,
    the k-th other word of a text -k; these words are listed in ``rare``. It refers
    to nothing of this package, so that Python workers need no copy of the package
    on their path.
    """
    known = hot["word"].combine_chunks()
    known_ids = hot["word_id"].to_numpy()
    rows = ROWS

    def first_words(text: bytes | None) -> list[str]:
        # one piece more than words, for the rest of the text
        return [] if text is None else text.decode("utf-8", "replace").split(None, max_length)[:max_length]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                pieces = [first_words(t) for t in part.column("text").cast(pa.binary()).to_pylist()]
                sizes = [len(p) for p in pieces]
                flat = pa.array(chain.from_iterable(pieces), pa.string())
                place = pc.index_in(flat, value_set=known.cast(pa.string()))
                miss = place.is_null().to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                missed = np.concatenate([[0], np.cumsum(miss)]).astype(np.int32)
                ids = np.zeros(len(flat), np.int64)
                ids[~miss] = known_ids[place.drop_null().to_numpy()]
                ids[miss] = -(missed[1:] - np.repeat(missed[ends[:-1]], sizes))[miss]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_row"), part.column("example_id"),
                        pa.ListArray.from_arrays(ends, ids),
                        pa.ListArray.from_arrays(missed[ends], flat.filter(pa.array(miss))),
                    ],
                    ["_row", "example_id", "ids", "rare"],
                )

    return coded


def _coded(texts: DataFrame, vocab: DataFrame, max_length: int) -> DataFrame:
    """(example_id, ids) of ``texts(_row, example_id, text)``: a row per text from end to end.

    Frequent words are looked up in the tasks; only the others get a row each
    and meet the vocabulary in a shuffle. A word that the vocabulary does not
    have gets the id after its last.
    """
    frequent = (F.col("word_id") <= HOT_WORDS) & (F.length("word") <= HOT_CHARS)
    hot = vocab.where(frequent).select("word", "word_id").toArrow()
    rest = vocab.where(~frequent).select("word", "word_id")
    unknown = vocab.agg(F.coalesce(F.max("word_id"), F.lit(0)) + 1).scalar()
    kind = texts.schema["example_id"].dataType.simpleString()
    shape = f"_row bigint, example_id {kind}, ids array<bigint>, rare array<string>"
    # read for the rare words and for the ids
    coded = settle(texts.mapInArrow(_coder(hot, max_length), shape), "coded")
    others = coded.select("_row", F.posexplode("rare").alias("rank", "word")).join(rest, "word", "left").select(
        "_row", F.struct("rank", F.coalesce("word_id", unknown).alias("word_id")).alias("place")
    )
    found = others.groupBy("_row").agg(
        F.transform(F.array_sort(F.collect_list("place")), lambda p: p["word_id"]).alias("found")
    )

    def filled(x: Column) -> Column:
        return F.when(x < 0, F.element_at("found", (-x).cast("int"))).otherwise(x)

    joined = coded.select("_row", "example_id", "ids").join(found, "_row", "left")
    return joined.select("example_id", F.transform("ids", filled).alias("ids"))


def encode(texts: DataFrame, vocab: DataFrame, max_length: int, column: str = "text") -> DataFrame:
    """(example_id, input_ids, attention_mask, labels), cut and padded to ``max_length``.

    ``vocab`` is a stored vocabulary; words that it lacks share one id of their own.
    """
    numbered = texts.select(
        F.monotonically_increasing_id().alias("_row"), "example_id", F.col(column).alias("text")
    )
    n = F.size("ids")
    return (
        _coded(numbered, vocab, max_length)
        .select(
            "example_id",
            F.concat("ids", _repeat(PAD, max_length - n)).alias("input_ids"),
            F.concat(F.array_repeat(F.lit(1), n), _repeat(0, max_length - n).cast("array<int>")).alias(
                "attention_mask"
            ),
        )
        .withColumn("labels", F.col("input_ids"))
    )


def _repeat(value: int, n: Column) -> Column:
    return F.array_repeat(F.lit(value).cast("bigint"), n)
