"""Ranked lexical search with range-maximum tables over posting lists.

The index holds, per segment of documents, one posting list per term and the
sizes of the documents. A search reads the lists of its terms only. In a
segment every list gets a sparse table of range maxima of its impacts; the
documents are searched best interval first: the maxima of the query's lists
inside an interval, weighted and added up, bound every score in it. The best
interval is split at the document of its largest weighted impact, that document
is scored, and both halves are bounded again; an interval whose bound is below
the k-th best score is never opened.

Every segment is probed first with a few splits. The k-th best score of all
probes is a floor below which no segment needs to look in the second pass, so
that most segments of a large index are left after one bound per query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablequill.functions.scale import attach
from tablequill.llm import terms
from tablequill.session import settle

K = 10
# Splits of an interval in the first pass, per query and segment.
PROBES = 12
# Intervals of so many documents are scored instead of split.
LEAF = 48
# Terms of queries that one task searches for at once; more queries are dealt out in chunks.
CHUNK_TERMS = 50_000
_NO_FLOOR = -1


@dataclass(frozen=True)
class Index:
    """``lists(segment, term, docs, counts)`` and ``segments(segment, ids, sizes)``.

    ``docs`` are places in ``ids``, ascending; ``n_docs`` counts the documents
    with a term, ``n_terms`` all their terms with repeats.
    """

    lists: DataFrame
    segments: DataFrame
    n_docs: int
    n_terms: int


def _index_rows(id_type: pa.DataType):
    table = terms.marked(terms.LETTERS + terms.DIGITS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, segment in enumerate(terms.segments(batches, 1, [0], table)):
            p, ids = segment.merged(), segment.column(0)
            # places follow the ids, NULL last
            order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            at = place[p.docs]
            by_term = np.lexsort((at, p.codes))
            bounds = np.concatenate([[0], np.cumsum(np.bincount(p.codes, minlength=len(p.vocabulary)))])
            name, n = task * (1 << 24) + number, len(p.vocabulary)
            names = ["segment", "term", "docs", "counts", "ids", "sizes"]
            integers, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
            for lo in range(0, n, 50_000):
                cut = bounds[lo : min(lo + 50_000, n) + 1]
                inside = by_term[cut[0] : cut[-1]]
                size = len(cut) - 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(size, name)), p.vocabulary.slice(lo, size).cast(pa.string()),
                    terms.lists(at[inside], cut - cut[0], pa.int32()),
                    terms.lists(p.counts[inside], cut - cut[0], pa.int32()),
                    pa.nulls(size, pa.list_(id_type)), pa.nulls(size, longs),
                ], names=names)
            whole = np.array([0, len(ids)])
            yield pa.RecordBatch.from_arrays([
                pa.array([name]), pa.nulls(1, pa.string()), pa.nulls(1, integers), pa.nulls(1, integers),
                pa.ListArray.from_arrays(pa.array(whole, pa.int32()), ids.take(pa.array(order))),
                terms.lists(p.sizes[order], whole, pa.int64()),
            ], names=names)

    return rows


def build(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> Index:
    """Index every row of ``docs``; stored once, read by any number of searches.

    A row is a document, also if its id is NULL or repeats; NULL and empty texts
    are documents without terms. Ids are integers or strings.
    """
    id_field = docs.schema[id_col].dataType
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    id_type = pa.string() if isinstance(id_field, T.StringType) else pa.int64()
    if pa.types.is_integer(id_type):
        narrow = narrow.withColumn("id", F.col("id").cast("long"))
    kind = "string" if id_type == pa.string() else "long"
    schema = (
        f"segment long, term string, docs array<int>, counts array<int>, ids array<{kind}>, sizes array<long>"
    )
    rows = settle(narrow.mapInArrow(_index_rows(id_type), schema), "index")
    segments = rows.where("term is null").select("segment", "ids", "sizes")
    none = F.lit(0).cast("long")
    totals = segments.select(
        F.coalesce(F.sum(F.size(F.filter("sizes", lambda n: n > 0))), none).alias("n"),
        F.coalesce(F.sum(F.aggregate("sizes", none, lambda a, n: a + n)), none).alias("l"),
    ).first()
    lists = rows.where("term is not null").select("segment", "term", "docs", "counts")
    return Index(lists, segments, totals["n"], totals["l"])


def _query_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, task, row = terms.marked(terms.LETTERS + terms.DIGITS), TaskContext.get().partitionId(), 0
    for batch in batches:
        for p in terms.postings(batch.column(1), table):
            ids = batch.column(0).slice(p.first, len(p.sizes)).take(pa.array(p.docs))
            yield pa.RecordBatch.from_arrays([
                pa.array(task * (1 << 40) + row + p.docs.astype(np.int64)), ids,
                p.vocabulary.take(pa.array(p.codes)).cast(pa.string()), pa.array(p.counts, pa.int64()),
            ], names=["query", "id", "term", "times"])
            row += len(p.sizes)


class _Lists:
    """The lists of a segment one after another, with their range maxima."""

    def __init__(self, lists: pa.Table, sizes: np.ndarray, n_docs: int, n_terms: int):
        names = lists["term"].to_pylist()
        lengths = np.fromiter((len(x) for x in lists["docs"]), np.int64, len(names))
        self.of = {t: i for i, t in enumerate(names)}
        self.end = np.cumsum(lengths)
        self.start = self.end - lengths
        self.docs = _flat(lists["docs"])
        counts = _flat(lists["counts"])
        self.keys = np.repeat(np.arange(len(names)), lengths) * len(sizes) + self.docs
        self.n = len(sizes)
        if 75 * int(sizes.max(initial=0)) * n_docs < 1 << 62:
            share = (75 * sizes * n_docs) // max(n_terms, 1)
        else:
            share = np.array([75 * int(s) * n_docs // n_terms for s in sizes], np.int64)
        m = (25 + share)[self.docs]
        self.impact = (1_000_000_000 * counts) // (1000 * counts + 8 * m)
        levels = int(lengths.max(initial=1)).bit_length()
        place = np.arange(len(self.docs), dtype=np.int32)
        # best[j][i]: place of the largest impact in [i, i + 2 ** j)
        self.best = np.tile(place, (levels, 1))
        for j in range(1, levels):
            half = 1 << (j - 1)
            a, b = self.best[j - 1][: len(place) - half], self.best[j - 1][half:]
            self.best[j][: len(place) - half] = np.where(self.impact[a] >= self.impact[b], a, b)
        self.log = np.zeros(int(lengths.max(initial=1)) + 1, np.int64)
        for i in range(1, levels):
            self.log[1 << i :] = i

    def top(self, lo: np.ndarray, hi: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per list range [lo, hi): its largest impact times the weight, and where it is."""
        length = hi - lo
        level = self.log[length]
        some = length > 0
        a = self.best[level, np.where(some, lo, 0)]
        b = self.best[level, np.where(some, hi - (1 << level), 0)]
        at = np.where(self.impact[a] >= self.impact[b], a, b)
        return np.where(some, self.impact[at] * weights, 0), at


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)


def _best(lists: _Lists, chosen: np.ndarray, weights: np.ndarray, k: int, floor: int, probes: int,
          before_floor: int) -> list[tuple[int, int]]:
    """(score, place) of at most ``k`` documents that may be among the best of all.

    ``floor`` is a score that ``k`` documents of the corpus reach; of those that
    only equal it, places from ``before_floor`` on come too late. With
    ``probes`` the search stops after so many splits.
    """
    base = chosen * lists.n
    found: list[tuple[int, int]] = []  # heap of (score, -place): the worst first

    def offer(score: int, place: int) -> None:
        if score > 0:
            (heapq.heappush if len(found) < k else heapq.heappushpop)(found, (score, -place))

    def hopeless(bound: int, first: int) -> bool:
        if bound <= 0 or bound < floor or (bound == floor and first >= before_floor):
            return True
        return len(found) == k and (bound, -first) <= found[0]

    heap: list[tuple] = []
    number = 0

    def push(docs: list[tuple[int, int]], lo: np.ndarray, hi: np.ndarray) -> None:
        nonlocal number
        values, at = lists.top(lo, hi, weights)
        bounds, most = values.sum(axis=1), values.argmax(axis=1)
        for i, (first, last) in enumerate(docs):
            bound = int(bounds[i])
            if not hopeless(bound, first):
                split = int(lists.docs[at[i, most[i]]])
                heapq.heappush(heap, (-bound, first, number, last, lo[i], hi[i], split))
                number += 1

    push([(0, lists.n)], lists.start[chosen][None], lists.end[chosen][None])
    while heap:
        bound, first, _, last, lo, hi, split = heapq.heappop(heap)
        if hopeless(-bound, first):
            # others may have the same bound and earlier documents, none has a larger one
            if -bound < max(floor, found[0][0] if len(found) == k else 0):
                break
            continue
        if last - first <= LEAF:
            lengths = hi - lo
            inside = np.repeat(lo - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            scores = np.zeros(last - first, np.int64)
            np.add.at(scores, lists.docs[inside] - first,
                      lists.impact[inside] * np.repeat(weights, lengths))
            for place in np.flatnonzero(scores >= max(1, found[0][0] if len(found) == k else 1)).tolist():
                offer(int(scores[place]), first + place)
            continue
        at = np.searchsorted(lists.keys, base + split)
        held = (at < hi) & (lists.keys[np.minimum(at, len(lists.keys) - 1)] == base + split)
        offer(int((lists.impact[at[held]] * weights[held]).sum()), split)
        push([(first, split), (split + 1, last)], np.stack([lo, at + held]), np.stack([at, hi]))
        if probes:
            probes -= 1
            if not probes:
                break
    return [(score, -place) for score, place in found]


def _searcher(n_docs: int, n_terms: int, k: int, probes: int, id_type: pa.DataType):
    def search(lists: pa.Table, segment: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        ids = pa.array([], id_type)
        if len(lists) and len(segment):
            ids = segment["ids"].combine_chunks().flatten()
            sizes = _flat(segment["sizes"])
            held = _Lists(lists, sizes, n_docs, n_terms)
            entries = segment["queries"].combine_chunks().flatten()
            columns = {f: entries.field(f) for f in ("query", "term", "weight", "floor", "floor_id")}
            number = columns["query"].to_numpy()
            code = np.array([held.of.get(t, -1) for t in columns["term"].to_pylist()], np.int64)
            weight = columns["weight"].to_numpy()
            fine = np.flatnonzero((code >= 0) & (weight > 0))
            fine = fine[np.argsort(number[fine], kind="stable")]
            edges = np.flatnonzero(np.diff(number[fine], prepend=-1, append=-1))
            known = ids.drop_null()
            keys = known.to_numpy(zero_copy_only=False)
            for a, b in zip(edges[:-1], edges[1:]):
                mine = fine[a:b]
                floor = columns["floor"][int(mine[0])].as_py()
                last = columns["floor_id"][int(mine[0])].as_py()
                # places up to the id of the floor; without an id all of them count
                upto = len(ids) if last is None else int(np.searchsorted(keys, last, "right"))
                best = _best(held, code[mine], weight[mine], k, floor, probes, upto)
                out += [(int(number[mine[0]]), place, score) for score, place in best]
        query, place, score = (np.array(x, np.int64) for x in (zip(*out) if out else ([], [], [])))
        return pa.table({
            "query": pa.array(query), "id": ids.take(pa.array(place)), "score": pa.array(score),
        })

    return search


def _best_of_all(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of every query; Spark limits the groups before the shuffle."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, id_col: str = "item_id", text: str = "text",
           k: int = K) -> DataFrame:
    """(query id, rank, doc_id, score): the ``k`` best documents of every query, score above 0.

    Every row of ``queries`` is a query, also if its id is NULL or repeats. A
    query without terms has no rows, nor has one whose terms no document holds.
    Equal scores come in the order of the ids, NULL last.
    """
    spark, kind = queries.sparkSession, index.segments.schema["ids"].dataType.elementType
    narrow = queries.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    asked_type = narrow.schema["id"].dataType
    shape = T.StructType().add("query", "long").add("id", asked_type).add("term", "string").add("times", "long")
    asked = settle(narrow.mapInArrow(_query_rows, shape), "queries")
    n_chunks = max(1, -(-asked.count() // CHUNK_TERMS))
    chunk = F.pmod(F.xxhash64("query"), F.lit(n_chunks)).cast("int").alias("chunk")
    wanted = asked.select("term", chunk).distinct()
    # only the lists of the terms that are asked for go on
    lists = settle(attach(index.lists, wanted, ["term"], ["segment"]), "lists")
    held = lists.groupBy("chunk", "term").agg(F.sum(F.size("docs")).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(index.n_docs) + 2) / (2 * F.col("df") + 1)))
    weighed = settle(
        asked.withColumn("chunk", chunk).join(held, ["chunk", "term"])
        .select("query", "chunk", "term", (F.col("times") * weight).cast("long").alias("weight")),
        "weights",
    )
    id_type = pa.string() if isinstance(kind, T.StringType) else pa.int64()
    out = T.StructType().add("query", "long").add("id", kind).add("score", "long")

    def over_segments(floors: DataFrame, probes: int) -> DataFrame:
        entry = F.struct("query", "term", "weight", "floor", "floor_id")
        packed = (
            weighed.join(floors, "query", "left").withColumn("floor", F.coalesce("floor", F.lit(_NO_FLOOR)))
            .groupBy("chunk").agg(F.collect_list(entry).alias("queries"))
        )
        every = F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("chunk")
        sides = attach(index.segments.select("*", every), packed, ["chunk"], ["segment"])
        keys = ["segment", "chunk"]
        return (
            lists.groupBy(*keys).cogroup(sides.groupBy(*keys))
            .applyInArrow(_searcher(index.n_docs, index.n_terms, k, probes, id_type), out)
        )

    no_floors = spark.createDataFrame([], T.StructType().add("query", "long").add("floor", "long").add("floor_id", kind))
    probed = _best_of_all(over_segments(no_floors, PROBES), k).where(F.col("rank") == k)
    floors = settle(probed.select("query", F.col("score").alias("floor"), F.col("id").alias("floor_id")), "floors")
    best = _best_of_all(over_segments(floors, 0), k)
    named = asked.select("query", F.col("id").alias("asked")).distinct()
    return best.join(named, "query").select(
        F.col("asked").alias(id_col), F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("doc_id"), "score",
    )


def op11_rows(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(build(docs), items)
