"""Token ids as length-delimited binary records, with an offset index.

A record file is a sequence of frames, in ascending order of the documents:

    length of the payload      8 bytes, little-endian
    masked crc32 of the length 4 bytes
    payload
    masked crc32 of the payload 4 bytes
    line feed                  1 byte

A payload is the document's id (8 bytes, signed), a byte that is 1 if there is
an id, a byte with the width of a token id (2 or 4), and the token ids, all
little-endian. The mask rotates a crc right by 15 bits and adds a constant, so
that a payload that holds crcs of its own does not look valid by accident.

Files are written by Spark's text writer (the line feed is its separator), so
they reach any file system of Spark and a lost task leaves no half file. The
index, a Parquet table, has the file, byte offset and size of every record.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablequill.llm import encoding

# Bytes of text that make up one file: what a reader holds in memory.
BYTES_PER_FILE = 12 << 20
HEADER, FOOTER = 12, 5
INDEX = "shard int, ordinal long, doc_id long, offset long, size long, n_tokens long"
# Files whose sums one task adds up.
PREFIX_GROUP = 4096


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int | None = None) -> bytes:
    """One record without the line feed, which the writer adds.

    Without a ``width`` the record takes the narrowest that holds its ids; ids
    that do not fit a given width are refused.
    """
    largest = int(ids.max()) if len(ids) else 0
    if width is None:
        width = 2 if largest < 1 << 16 else 4
    if width not in (2, 4) or largest >= 1 << 8 * width or (len(ids) and int(ids.min()) < 0):
        raise ValueError(f"ids up to {largest} do not fit {width} bytes")
    payload = struct.pack("<qBB", doc_id or 0, doc_id is not None, width)
    payload += ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload,
                     struct.pack("<I", masked(payload))))


class Damaged(ValueError):
    """A record file whose lengths or checksums do not hold."""


def read_frame(data: memoryview, at: int) -> tuple[memoryview, int]:
    """(payload of the frame at ``at``, where the next one begins); checks both crcs."""
    if at + HEADER > len(data):
        raise Damaged(f"cut off in a header at {at}")
    length, check = struct.unpack_from("<QI", data, at)
    if masked(bytes(data[at : at + 8])) != check:
        raise Damaged(f"length at {at}")
    end = at + HEADER + length
    if end + FOOTER > len(data):
        raise Damaged(f"cut off in a record at {at}")
    payload = data[at + HEADER : end]
    if struct.unpack_from("<I", data, end)[0] != masked(bytes(payload)) or data[end + 4] != 10:
        raise Damaged(f"payload at {at}")
    return payload, end + FOOTER


def parse(payload: memoryview) -> tuple[int | None, np.ndarray]:
    doc_id, known, width = struct.unpack_from("<qBB", payload)
    return (doc_id if known else None), np.frombuffer(payload[10:], f"<u{width}")


def _framer(tokenizer: str, end_id: int, width: int | None):
    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding.encoder(tokenizer)
        for batch in batches:
            doc_ids = batch.column("_id").to_pylist()
            for first, ids, bounds in encoder.encode(batch.column("_text")):
                ids, bounds = encoding.with_end(ids, bounds, end_id)
                out = [frame(doc_ids[first + i], ids[bounds[i] : bounds[i + 1]], width)
                       for i in range(len(bounds) - 1)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    return frames


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id",
          text: str = "text", width: int | None = None, bytes_per_file: int = BYTES_PER_FILE) -> None:
    """Write the record files of ``docs`` below ``path/records`` and their index.

    One file per range of ids, each sorted; NULL ids come first, equal ids in
    any order (they are told apart by a row number, so a repeated id spreads
    over files). A NULL text is an empty one. No document gives no file. See
    ``frame`` for ``width``; records of both widths may share a file.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_text"),
        F.monotonically_increasing_id().alias("_row"),
    )
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0]
    n_files = max(1, -(-(size or 0) // bytes_per_file))
    sorted_rows = rows.repartitionByRange(n_files, "_id", "_row").sortWithinPartitions("_id", "_row")
    frames = sorted_rows.select("_id", "_text").mapInArrow(_framer(tokenizer, end_id, width), "frame binary")
    frames.select(F.col("frame").cast("string")).write.text(f"{path}/records", lineSep="\n")
    _indexed(spark, path).write.parquet(f"{path}/index")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the record files; ``part-00012-...`` is file 12."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records")
    return files.select("path", "content")


def _file_number(path: str) -> int:
    return int(re.search(r"part-(\d+)[^/]*$", path)[1])


def _indexer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            data, at, rows = memoryview(content.as_buffer()), 0, []
            while at < len(data):
                payload, after = read_frame(data, at)
                doc_id, ids = parse(payload)
                rows.append((len(rows), doc_id, at, after - at, len(ids)))
                at = after
            columns = [pa.array(list(c), pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 5
            shard = pa.array(np.full(len(rows), _file_number(path)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [shard, *columns], ["shard", "ordinal", "doc_id", "offset", "size", "n_tokens"]
            )


def _indexed(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path).mapInArrow(_indexer, INDEX)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            data, at, before, rows = memoryview(content.as_buffer()), 0, 0, []
            shard, ordinal, held = _file_number(path), 0, 0

            def flushed():
                doc_id, ordinals, starts, sizes, ids = zip(*rows)
                return pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(rows), pa.int32()), pa.array(ordinals, pa.int64()),
                     pa.array(doc_id, pa.int64()), pa.array(starts, pa.int64()),
                     pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                    ["shard", "ordinal", "doc_id", "before", "n_tokens", "ids"],
                )

            while at < len(data):
                payload, at = read_frame(data, at)
                doc_id, ids = parse(payload)
                rows.append((doc_id, ordinal, before, len(ids), ids.astype("<u4").tobytes()))
                before, ordinal, held = before + len(ids), ordinal + 1, held + 4 * len(ids)
                if held > 4 << 20:
                    yield flushed()
                    rows, held = [], 0
            if rows:
                yield flushed()


def read(spark: SparkSession, path: str) -> DataFrame:
    """(shard, ordinal, doc_id, before, n_tokens, ids), from files whose checksums hold.

    ``ids`` are the token ids as little-endian unsigned 32-bit integers,
    ``before`` counts the ids of earlier records of the same file.
    """
    return _files(spark, path).mapInArrow(
        _reader, "shard int, ordinal long, doc_id long, before long, n_tokens long, ids binary"
    )


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, file_start): ids in all earlier files. Prefix sums in two steps, so that no
    task gets more than PREFIX_GROUP files or one row per such group."""
    totals = spark.read.schema(INDEX).parquet(f"{path}/index").groupBy("shard").agg(
        F.sum("n_tokens").alias("n")
    ).withColumn("part", F.expr(f"shard div {PREFIX_GROUP}"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    groups = totals.groupBy("part").agg(F.sum("n").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("group_start")
    )
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.join(groups, "part").select(
        "shard", (F.col("group_start") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("file_start")
    )


def read_shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """The records in a random order that depends on ``seed`` only.

    The order is drawn over the index; each file is opened once and its records
    are cut out at their offsets.
    """
    order = F.xxhash64(F.lit(seed), "shard", "ordinal")
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    wanted = index.groupBy("shard").agg(F.collect_list(F.struct("offset", order.alias("key"))).alias("at"))
    files = _files(spark, path).withColumn(
        "shard", F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("int")
    )

    def batched(rows: list) -> pa.RecordBatch:
        keys, doc_ids, ids = zip(*rows)
        columns = [pa.array(keys, pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(ids, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, at in zip(batch.column("content"), batch.column("at").to_pylist()):
                data, rows, held = memoryview(content.as_buffer()), [], 0
                for place in at:
                    doc_id, ids = parse(read_frame(data, place["offset"])[0])
                    rows.append((place["key"], doc_id, ids.astype("<u4").tobytes()))
                    held += 4 * len(ids)
                    if held > 4 << 20:
                        yield batched(rows)
                        rows, held = [], 0
                if rows:
                    yield batched(rows)

    rows = files.join(wanted, "shard").select("content", "at").mapInArrow(
        cut, "key long, doc_id long, ids binary"
    )
    return rows.orderBy("key", "doc_id").drop("key")


def op3_rows(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> DataFrame:
    spark = docs.sparkSession
    write(docs, path, tokenizer, end_id)
    records = read(spark, path).select(
        "shard", "doc_id", "before", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )
    return records.join(file_starts(spark, path), "shard").select(
        "doc_id", (F.col("file_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
