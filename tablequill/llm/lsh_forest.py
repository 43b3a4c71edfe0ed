"""Near-duplicate texts: an LSH forest finds candidates, exact Jaccard verifies them.

Every distinct text gets ``TREES`` signatures of ``MAX_DEPTH`` MinHash values;
sorted, the signatures of a tree form a prefix trie. Starting from the full
depth, the matched prefix is shortened until a pair at the threshold shares a
node in some tree with the target probability. Texts that share a node, and
whose signatures do not speak clearly against it, fall into one cluster; inside
a cluster all pairs are verified on their five-word shingles. Exact copies count
as one text with a weight throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablequill.llm import graph
from tablequill.llm import textkernel as tk
from tablequill.llm.subspace_join import _spanning, chunk_tasks, runs
from tablequill.llm.rows import boxed, unboxed
from tablequill.session import settle

THRESHOLD = 0.8
TREES = 24
MAX_DEPTH = 6
TARGET_RECALL = 0.9999
# Nodes with more texts are joined as a whole, smaller ones pair by pair.
NODE = 256
# Texts per chunk of a cluster: a task holds two chunks.
CHUNK = 192
# Standard errors by which the estimated similarity of a pair may miss the threshold.
ERRORS = 5.0


def depth(threshold: float = THRESHOLD, trees: int = TREES, most: int = MAX_DEPTH,
          recall: float = TARGET_RECALL) -> int:
    """Longest prefix at which a pair at the threshold meets in some tree often enough.

    A target that not even the first values of all trees reach is refused.
    """
    for k in range(most, 0, -1):
        if 1 - (1 - threshold**k) ** trees >= recall:
            return k
    raise ValueError(f"{trees} trees do not reach recall {recall} at similarity {threshold}")


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(4242))
    factor = rng.integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1)
    return factor, rng.integers(0, 1 << 64, n, dtype=np.uint64)


def _signer(trees: int, most: int, used: int):
    """Function from texts to {sketch: one byte per MinHash value, nodes: one hash per tree}.

    A text without words has NULL for both.
    """
    factor, shift = _permutations(trees * most)

    def sign(texts: pa.Array) -> pa.Array:
        n = len(texts)
        values = np.zeros((trees * most, n), np.uint64)
        some = np.zeros(n, bool)
        for first, data, offsets in tk.slices(texts):
            found = tk.words(data, offsets)
            keys, bounds = tk.shingles(tk.word_hashes(data, found), found.bounds)
            full = np.flatnonzero(np.diff(bounds) > 0)
            if len(full) == 0:
                continue
            some[first + full] = True
            begins = bounds[full]
            for k in range(trees * most):
                values[k, first + full] = np.minimum.reduceat(keys * factor[k] + shift[k], begins)
        sketch = (tk.mix(values) & np.uint64(0xFF)).astype(np.uint8).T.copy()
        # the number of the tree is part of the hash, so a node is one number
        prefix = np.tile(np.arange(1, trees + 1, dtype=np.uint64), (n, 1))
        for t in range(trees):
            for k in range(used):
                prefix[:, t] = tk.mix(prefix[:, t] * np.uint64(0x9E3779B97F4A7C15) + values[t * most + k])
        raw = sketch.tobytes()
        width = trees * most
        sketches = [raw[i * width : (i + 1) * width] if some[i] else None for i in range(n)]
        at = pa.array(np.concatenate([[0], np.cumsum(some * trees)]).astype(np.int32))
        nodes = pa.ListArray.from_arrays(at, pa.array(prefix[some].view(np.int64).ravel()),
                                         mask=pa.array(~some))
        return pa.StructArray.from_arrays([pa.array(sketches, pa.binary()), nodes], ["sketch", "nodes"])

    return F.arrow_udf(sign, T.StructType([
        T.StructField("sketch", T.BinaryType()), T.StructField("nodes", T.ArrayType(T.LongType())),
    ]))


def _near_in_nodes(least: float):
    """Function from sorted node members to (rid, root): members with similar sketches."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a, out_b = [], []
        for node in runs(batches, "task"):
            rid = node.column("rid").to_numpy()
            column = node.column("sketch").combine_chunks()
            n = len(rid)
            sketch = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(n, -1)
            i, j = np.triu_indices(n, 1)
            linked = np.empty(len(i), bool)
            for at in range(0, len(i), 1 << 14):
                part = slice(at, at + (1 << 14))
                linked[part] = (sketch[i[part]] == sketch[j[part]]).mean(axis=1) >= least
            if linked.any():
                root = _spanning(n, i[linked], j[linked])
                moved = np.flatnonzero(root != np.arange(n))
                out_a.append(rid[moved])
                out_b.append(rid[root[moved]])
            if len(out_a) >= 1000:
                yield _two_columns(out_a, out_b)
                out_a, out_b = [], []
        if out_a:
            yield _two_columns(out_a, out_b)

    return near


def _two_columns(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["rid", "root"]
    )


def _verifier(threshold: float):
    """Function from sorted chunk pairs of a cluster to (rid, root, links) of the similar texts.

    ``links`` counts the rows on the other side of each link, copies included.
    """

    def overlaps(keys: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Shingles that each text of ``a`` shares with each of ``b``."""
        own = np.concatenate([np.full(len(keys[i]), i) for i in range(len(keys))])
        distinct, column = np.unique(np.concatenate(keys), return_inverse=True)
        often = np.bincount(column) > 1  # a shingle of one text is shared with none
        place = np.cumsum(often) - 1
        keep = often[column]
        own, column = own[keep], place[column[keep]]
        order = np.argsort(column, kind="stable")
        own, column = own[order], column[order]
        shared = np.zeros((len(a), len(b)), np.float32)
        row_a, row_b = np.full(len(keys), -1), np.full(len(keys), -1)
        row_a[a], row_b[b] = np.arange(len(a)), np.arange(len(b))
        width = 4096
        for low in range(0, int(often.sum()), width):
            lo, hi = np.searchsorted(column, [low, low + width])
            o, c = own[lo:hi], column[lo:hi] - low
            left = np.zeros((len(a), width), np.float32)
            right = np.zeros((len(b), width), np.float32)
            some = row_a[o] >= 0
            left[row_a[o[some]], c[some]] = 1
            some = row_b[o] >= 0
            right[row_b[o[some]], c[some]] = 1
            shared += left @ right.T
        return shared

    def verify(task: pa.Table) -> pa.RecordBatch | None:
        rid = task.column("rid").to_numpy()
        side = task.column("side").to_numpy()
        weight = task.column("weight").to_numpy()
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alone = len(b) == 0
        if alone:
            b = a
        if len(rid) < 2 or len(a) == 0:
            return None
        keys: list[np.ndarray] = []
        for _, data, offsets in tk.slices(task.column("text").combine_chunks()):
            found = tk.words(data, offsets)
            all_keys, bounds = tk.shingles(tk.word_hashes(data, found), found.bounds)
            keys += [np.unique(all_keys[lo:hi]) for lo, hi in zip(bounds[:-1], bounds[1:])]
        size = np.array([len(k) for k in keys])
        if len(rid) == 2:
            shared = np.array([[len(np.intersect1d(keys[0], keys[1], assume_unique=True))]], float)
            a, b, alone = np.array([0]), np.array([1]), False
        else:
            shared = overlaps(keys, a, b)
        union = size[a][:, None] + size[b][None, :] - shared
        similar = (shared >= threshold * union - 1e-9) & (shared > 0)
        if alone:
            similar &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
        i, j = np.nonzero(similar)
        if len(i) == 0:
            return None
        i, j = a[i], b[j]
        links = np.bincount(i, weight[j], len(rid)) + np.bincount(j, weight[i], len(rid))
        root = _spanning(len(rid), i, j)
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays(
            [pa.array(rid[some]), pa.array(rid[root[some]]), pa.array(links[some].astype(np.int64))],
            ["rid", "root", "links"],
        )

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in runs(batches, "task"):
            found = verify(task)
            if found is not None:
                yield found

    return tasks


def text_key(text: Column) -> Column:
    """What equal texts share: NULL and empty texts are the same."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _sorted_tasks(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "task").sortWithinPartitions("task")


def text_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                 threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(texts, classes): every row's text, and what the distinct texts link to.

    ``texts``: id, text_key, one row per row of ``docs``. ``classes``: text_key,
    rid, first_id (smallest id with the text), weight (rows with it), n_links
    (rows with another, similar text), root (rid of the class, its own without
    links).
    """
    k = depth(threshold)
    signed = settle(docs.select(
        F.col(id_col).alias("id"), text_key(F.col(text)).alias("text_key"),
        _signer(TREES, MAX_DEPTH, k)(F.col(text)).alias("s"),
    ).select("id", "text_key", "s.*"), "signed")
    distinct = signed.groupBy("text_key").agg(
        F.min("id").alias("first_id"), F.count("*").alias("weight"),
        F.first("sketch").alias("sketch"), F.first("nodes").alias("nodes"),
    )
    distinct = settle(distinct.withColumn("rid", F.monotonically_increasing_id()), "distinct")

    # 24 narrow rows per text meet their nodes; sketches only join what shares one
    members = distinct.where(F.col("nodes").isNotNull()).select("rid", F.explode("nodes").alias("node"))
    nodes = settle(members.groupBy("node").agg(
        F.count("*").alias("n"), F.min("rid").alias("least")
    ).where("n > 1"), "nodes")
    # the nodes grow with the corpus: never broadcast them
    shared = settle(members.join(nodes.hint("merge"), "node"), "shared")
    large = shared.where(F.col("n") > NODE).select("rid", F.col("least").alias("root"))
    sketches = distinct.select("rid", "sketch")
    small = shared.where(F.col("n") <= NODE).join(sketches.hint("merge"), "rid")
    error = (threshold * (1 - threshold) / (TREES * MAX_DEPTH)) ** 0.5
    near = _sorted_tasks(small.select(F.col("node").alias("task"), "rid", "sketch")).mapInArrow(
        _near_in_nodes(threshold - ERRORS * error), "rid long, root long"
    )
    clusters = settle(graph.components(large.unionByName(near), "rid", "root"), "clusters")

    # only the texts of clusters travel, one row of each
    wanted = clusters.join(
        distinct.select(F.col("rid").alias("node"), "text_key", "first_id", "weight"), "node"
    )
    source = docs.select(
        F.col(id_col).alias("_id"), text_key(F.col(text)).alias("text_key"), F.col(text).alias("text")
    )
    full = (
        source.join(wanted, (source["text_key"] == wanted["text_key"]) & F.col("_id").eqNullSafe(F.col("first_id")))
        .select(F.col("node").alias("rid"), F.col("root").alias("cluster"), "weight", "text")
        .groupBy("rid").agg(F.first("cluster").alias("cluster"), F.first("weight").alias("weight"),
                            F.first("text").alias("text"))
    )
    narrow = clusters.select(F.col("node").alias("rid"), F.col("root").alias("cluster"), F.lit(True).alias("home"))
    dealt = chunk_tasks(narrow, ["cluster"], CHUNK).select("rid", "task", "side")
    tasks = dealt.join(full.select("rid", "weight", "text"), "rid")
    found = settle(_sorted_tasks(tasks.select("task", "side", "rid", "weight", "text")).mapInArrow(
        _verifier(threshold), "rid long, root long, links long"
    ), "similar")
    links = found.groupBy("rid").agg(F.sum("links").alias("n_links"))
    roots = graph.components(found.where("rid <> root"), "rid", "root").withColumnsRenamed({"node": "rid"})
    classes = (
        distinct.select("text_key", "rid", "first_id", "weight", F.col("nodes").isNotNull().alias("has_words"))
        .join(links, "rid", "left").join(roots, "rid", "left")
        .select("text_key", "rid", "first_id", "weight", "has_words",
                F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "rid").alias("root"))
    )
    return signed.select("id", "text_key"), classes


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                    threshold: float = THRESHOLD) -> DataFrame:
    """(id, class_id, n_links, kept), one row per row of ``docs``.

    Texts are linked if the Jaccard similarity of their sets of five-word
    shingles is at least ``threshold``; ``n_links`` counts the other rows a row
    is linked to, copies included. ``class_id`` is the smallest id that links
    lead to; ``kept`` is true where it is the row's own. A text of one to four
    words is one shingle. A text without words (NULL too) links with nothing,
    is in a class of its own and kept. NULL ids come last; repeated rows are
    copies of each other and share all of this.
    """
    texts, classes = text_classes(docs, id_col, text, threshold)
    least = classes.groupBy("root").agg(F.min("first_id").alias("class_id"))
    of_text = classes.join(least, "root").select(
        "text_key", "class_id", (F.col("n_links") + F.col("weight") - 1).alias("n_links"), "has_words"
    )
    own = F.when(F.col("has_words"), F.col("class_id")).otherwise(F.col("id"))
    return texts.join(of_text, "text_key").select(
        F.col("id").alias(id_col), own.alias("class_id"),
        F.when(F.col("has_words"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.col("id").eqNullSafe(own).alias("kept"),
    )


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                      threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with one of each class of near-duplicates, all columns unchanged.

    The one with the smallest id stays; of rows that share it and the text, one.
    Texts without words all stay.
    """
    texts, classes = text_classes(docs, id_col, text, threshold)
    best = classes.groupBy("root").agg(
        F.min_by(F.struct("text_key", "first_id"), F.struct(F.col("first_id").isNull(), "first_id", "rid")).alias("b")
    )
    chosen = best.select("b.*").join(classes.select("text_key", "has_words"), "text_key")
    times = texts.groupBy("text_key", "id").agg(F.count("*").alias("_times"))
    stay = chosen.where("has_words").join(
        times, (chosen["text_key"] == times["text_key"]) & chosen["first_id"].eqNullSafe(times["id"])
    ).select(chosen["text_key"].alias("_key"), F.col("id").alias("_id"), F.col("_times"))
    stay = settle(stay, "stay")
    keyed = boxed(docs, F.col(f"`{id_col}`").alias("own_id"), text_key(F.col(text)).alias("own_key"),
                  F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("has_words"))
    match = (F.col("own_key") == F.col("_key")) & F.col("own_id").eqNullSafe(F.col("_id"))
    out = unboxed(keyed.where("has_words").join(stay.where("_times = 1"), match))
    out = out.unionByName(unboxed(keyed.where("not has_words")))
    if stay.where("_times > 1").take(1):
        again = keyed.where("has_words").join(stay.where("_times > 1"), match)
        out = out.unionByName(unboxed(again.groupBy("own_key").agg(F.first("row").alias("row"))))
    return out


def op4_rows(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
