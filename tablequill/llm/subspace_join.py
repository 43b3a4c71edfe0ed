"""Near-duplicate vectors by a pigeonhole join over subspaces.

Two unit vectors with cosine c are sqrt(2 - 2c) apart. Rotated and split into
blocks of coordinates, a pair within that distance stays within its share of
the squared distance in at least one block (else the shares would add up to
more). So every block is joined by range, in a grid over its first coordinates,
and the union of the candidates is verified with exact cosines in double
precision. Every pair is counted in the first block that admits it.

The vectors of a label are dealt out to chunks. A task holds one chunk and meets
the chunks that follow it on a circle, half of the way round, one at a time: all
blocks of two chunks are joined where both are, so a vector travels once per
chunk it meets and not once per block and cell. Pairs exist only inside a task,
which emits counts per vector and edges that span what is linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablequill.functions.scale import attach
from tablequill.llm import graph
from tablequill.session import settle

BLOCKS = 8
# Vectors per chunk at most; chunks are smaller or fewer as the numbers below say.
CHUNK = 1 << 16
# Chunks that a label is cut into while they stay within the bounds on their numbers.
CHUNKS = 4
# Numbers (vectors times their length) of a chunk, at least for a label with several and at most.
LEAST_NUMBERS = 1 << 20
MOST_NUMBERS = 1 << 22
# Rows of the products inside a task, on either side.
TILE = 256
SPAN = 1024
# Pairs verified at once.
PAIRS = 1 << 16
# Share of a radius by which ranges are widened against rounding.
SLACK = 1e-6
# Squared distances in single precision are near up to so much per coordinate beyond their share.
COARSE = 2e-6


def _rotation(dims: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _bounds(dims: int, blocks: int) -> np.ndarray:
    return np.linspace(0, dims, min(blocks, dims) + 1).astype(int)


def _usable(vector: str) -> F.Column:
    v = F.col(vector)
    squares = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & fine & (squares > 0) & (squares < float("inf")), F.lit(False))


def _units(batch_vectors: pa.Array, dims: int) -> np.ndarray:
    flat = batch_vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(-1, dims)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _spanning(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest number that links lead to, for the numbers 0..n-1."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


class _Chunk:
    """Vectors with their rotated form, laid out per block along the cells of its grid."""

    def __init__(self, part: pa.Table, rotation: np.ndarray, bounds: np.ndarray, shares: np.ndarray):
        self.rid = part.column("rid").to_numpy()
        self.units = _units(part.column("vector").combine_chunks(), len(rotation))
        self.turned = self.units @ rotation
        self.blocks = []
        for lo, hi, share in zip(bounds[:-1], bounds[1:], shares):
            radius = np.sqrt(share) * (1 + SLACK)
            # the first coordinate makes strips a radius wide, the second orders what is in one
            strip = np.floor(self.turned[:, lo] / radius).astype(np.int64)
            along = self.turned[:, min(lo + 1, hi - 1)]
            order = np.lexsort((along, strip))
            rows = self.turned[order, lo:hi].astype(np.float32)
            norms, ones = (rows**2).sum(1, keepdims=True), np.ones((len(rows), 1), np.float32)
            names, starts = np.unique(strip[order], return_index=True)
            ends = [*starts[1:].tolist(), len(rows)]
            self.blocks.append((
                radius, order, along[order], dict(zip(names.tolist(), zip(starts.tolist(), ends))),
                np.hstack([rows, norms, ones]), np.hstack([-2 * rows, ones, norms]),
            ))


def _in_reach(a: _Chunk, b: _Chunk, block: int, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of pairs that one block may admit: a range join over its grid.

    If both are the same chunk every pair comes once.
    """
    radius, order, along, strips, left, _ = a.blocks[block]
    _, other, beside, meets, _, right = b.blocks[block]
    limit = np.float32(share + COARSE * left.shape[1])
    for strip, (start, end) in strips.items():
        for at in range(start, end, TILE):
            to = min(at + TILE, end)
            low, high = along[at] - radius, along[to - 1] + radius
            for near in (strip - 1, strip, strip + 1):
                lo, hi = meets.get(near, (0, 0))
                first = lo + int(np.searchsorted(beside[lo:hi], low, "left"))
                last = lo + int(np.searchsorted(beside[lo:hi], high, "right"))
                if a is b:
                    first = max(first, at)
                for v in range(first, last, SPAN):
                    w = min(v + SPAN, last)
                    close = left[at:to] @ right[v:w].T <= limit
                    i, j = np.divmod(np.flatnonzero(close), w - v)
                    i, j = i + at, j + v
                    if a is b and v < to:
                        i, j = i[i < j], j[i < j]
                    if len(i):
                        yield order[i], other[j]


def _gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs, at most PAIRS at once and few at once only at the end."""
    held, n = [], 0
    for pair in pairs:
        held.append(pair)
        n += len(pair[0])
        if n >= PAIRS:
            x, y = (np.concatenate(side) for side in zip(*held))
            whole = n - n % PAIRS
            yield from ((x[at : at + PAIRS], y[at : at + PAIRS]) for at in range(0, whole, PAIRS))
            held, n = [(x[whole:], y[whole:])], n - whole
    if n:
        yield tuple(np.concatenate(side) for side in zip(*held))


def _links_between(a: _Chunk, b: _Chunk, threshold: float, shares: np.ndarray, bounds: np.ndarray):
    """Numbers (in ``a``, in ``b``) of the pairs whose cosine reaches the threshold."""
    for block in range(len(shares)):
        for i, j in _gathered(_in_reach(a, b, block, shares[block])):
            # a pair that an earlier block admits is counted there
            for k in (block, *range(block)):
                gap = a.turned[i, bounds[k] : bounds[k + 1]] - b.turned[j, bounds[k] : bounds[k + 1]]
                within = (gap**2).sum(1) <= shares[k]
                stays = within if k == block else ~within
                i, j = i[stays], j[stays]
            linked = np.einsum("ij,ij->i", a.units[i], b.units[j]) >= threshold
            yield i[linked], j[linked]


def _verifier(dims: int, threshold: float, blocks: int):
    """Function from sorted pieces of tasks to (rid, root, links) of the linked vectors."""
    rotation, bounds = _rotation(dims), _bounds(dims, blocks)
    shares = (2 - 2 * threshold) * np.diff(bounds) / dims * (1 + SLACK) + 1e-12

    def verify(a: _Chunk, b: _Chunk) -> Iterator[pa.RecordBatch]:
        # one numbering for the vectors of both
        rid, shift = (a.rid, 0) if a is b else (np.concatenate([a.rid, b.rid]), len(a.rid))
        links, root = np.zeros(len(rid), np.int64), np.arange(len(rid))
        for i, j in _gathered(_links_between(a, b, threshold, shares, bounds)):
            j = j + shift
            links += np.bincount(i, minlength=len(rid)) + np.bincount(j, minlength=len(rid))
            root = _spanning(len(rid), root[i], root[j])[root]
        some = np.flatnonzero(links)
        for at in range(0, len(some), PAIRS):
            part = some[at : at + PAIRS]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid[part]), pa.array(rid[root[part]]), pa.array(links[part])],
                ["rid", "root", "links"],
            )

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = task = None
        step = max(1, LEAST_NUMBERS // dims)
        for piece in runs(batches, "piece"):
            if piece.column("side")[0].as_py() == 0:
                task = piece.column("task")[0].as_py()
                held = _Chunk(piece, rotation, bounds, shares)
                yield from verify(held, held)
            elif piece.column("task")[0].as_py() == task:
                for at in range(0, len(piece), step):
                    yield from verify(held, _Chunk(piece.slice(at, step), rotation, bounds, shares))

    return tasks


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows that follow each other with the same ``key``, one table per run."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        edges = [0, *cuts.tolist(), len(keys)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            if held and keys[lo] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = keys[lo]
    if held:
        yield pa.Table.from_batches(held)


def chunk_tasks(members: DataFrame, keys: list[str], chunk: int) -> DataFrame:
    """Members of cells, repeated for the chunk pairs they take part in.

    ``members`` has a ``rid`` and ``home`` per row. The home rows of a cell make
    chunks of about ``chunk``, and so do its guests; home chunks meet each other
    and every guest chunk. Adds ``task`` (a chunk pair) and ``side`` (0 or 1).
    Cells with a single row, or without home, are left out.
    """
    sizes = members.groupBy(*keys).agg(
        F.count_if("home").alias("_homes"), F.count_if(~F.col("home")).alias("_guests")
    ).where((F.col("_homes") > 1) | ((F.col("_homes") > 0) & (F.col("_guests") > 0)))
    sizes = sizes.select(
        *keys, F.ceil(F.col("_homes") / chunk).cast("int").alias("_h"),
        F.ceil(F.col("_guests") / chunk).cast("int").alias("_g"),
    )
    rows = members.join(sizes, keys)
    own = F.pmod(F.xxhash64("rid"), F.when(F.col("home"), F.col("_h")).otherwise(F.greatest("_g", F.lit(1)))).cast("int")
    rows = rows.withColumn("_own", own)
    # (chunk of side 0, chunk of side 1); guest chunks are numbered from _h on, -1 is none
    with_homes = F.transform(F.sequence(F.lit(0), F.col("_h") - 1), lambda o: F.when(
        o == F.col("_own"), F.struct(o.alias("a"), F.lit(-1).alias("b"), F.lit(0).alias("side"))
    ).otherwise(F.struct(
        F.least(o, F.col("_own")).alias("a"), F.greatest(o, F.col("_own")).alias("b"),
        F.when(F.col("_own") < o, 0).otherwise(1).alias("side"),
    )))
    with_guests = F.when(F.col("_g") == 0, F.array().cast("array<struct<a:int,b:int,side:int>>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest("_g", F.lit(1)) - 1), lambda o: F.struct(
            F.col("_own").alias("a"), (F.col("_h") + o).alias("b"), F.lit(0).alias("side"))))
    as_guest = F.transform(F.sequence(F.lit(0), F.col("_h") - 1), lambda o: F.struct(
        o.alias("a"), (F.col("_h") + F.col("_own")).alias("b"), F.lit(1).alias("side")))
    meets = F.when(F.col("home"), F.concat(with_homes, with_guests)).otherwise(as_guest)
    return rows.withColumn("_meet", F.explode(meets)).withColumn(
        "task", F.xxhash64(*keys, "_meet.a", "_meet.b")
    ).withColumn("side", F.col("_meet.side")).drop("_meet", "_own", "_h", "_g")


def linked_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id",
                   vector: str = "embedding", label: str = "label", blocks: int = BLOCKS) -> DataFrame:
    """(id, n_links, component_id, kept), one row per row of ``vectors``.

    Vectors with cosine >= ``threshold`` and equal labels are linked. Rows with
    a NULL label, or a vector that is NULL, zero or not finite, link with
    nothing; vectors of different length do not link. Repeated rows are vectors
    of their own. ``component_id`` is the smallest id that links lead to; NULL ids count
    as largest. ``kept`` is true where it is the row's own id.
    """
    spark = vectors.sparkSession
    given = vectors.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"),
        F.col(label).cast("string").alias("label"), F.col(vector).alias("vector"),
    )
    # length of the vectors that may link, else NULL
    length = F.when(F.col("label").isNotNull() & _usable("vector"), F.size("vector"))
    rows = settle(given.withColumn("n", length), "vectors")
    usable = rows.where("n IS NOT NULL")
    found = spark.createDataFrame([], "rid long, root long, links long")
    # vectors of a table have one length; each further one is a join of its own
    lengths = usable.select("n").distinct().orderBy("n").collect()
    for dims in [r["n"] for r in lengths]:
        part = _links(usable.where(F.col("n") == dims), dims, threshold, blocks)
        found = found.unionByName(part)
    found = settle(found, "links")
    links = found.groupBy("rid").agg(F.sum("links").alias("n_links"))
    roots = graph.components(found, "rid", "root")
    member = roots.join(rows.select(F.col("rid").alias("node"), "id"), "node")
    least = member.groupBy("root").agg(F.min("id").alias("component_id"))
    classes = roots.join(least, "root").select(F.col("node").alias("rid"), "component_id")
    own = F.coalesce("component_id", "id")
    return (
        rows.select("rid", "id").join(links, "rid", "left").join(classes, "rid", "left")
        .select(
            F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"),
        )
    )


def _dealt(usable: DataFrame, dims: int) -> DataFrame:
    """(task, side, piece, rid, vector): every two chunks of a label, and each with itself, meet
    in one task, whose own chunk is on side 0; a piece is a chunk in a task."""
    most = max(1, min(CHUNK, MOST_NUMBERS // dims))
    least = max(1, min(most, LEAST_NUMBERS // dims))
    size = F.least(F.greatest(F.ceil(F.col("_n") / CHUNKS), F.lit(least)), F.lit(most))
    labels = usable.groupBy("label").agg(F.count("*").alias("_n")).where("_n > 1")
    chunks = labels.select("label", F.ceil(F.col("_n") / size).cast("int").alias("_h"))
    rows = attach(usable, chunks, ["label"], ["rid"])
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("rid"), F.col("_h")).cast("int"))
    # the chunk stays in its own task and goes to those of the chunks before it on the
    # circle; of two that face each other the first one holds, the other goes
    back = F.when(F.col("_h") > 1, F.sequence(F.lit(1), F.floor(F.col("_h") / 2).cast("int")))
    guest = F.filter(
        F.coalesce(back, F.array().cast("array<int>")),
        lambda d: (2 * d < F.col("_h")) | (F.pmod(F.col("_own") - d, F.col("_h")) < d),
    )
    goes = F.concat(F.array(F.lit(0)), guest)
    return rows.withColumn("_back", F.explode(goes)).select(
        F.xxhash64("label", F.pmod(F.col("_own") - F.col("_back"), F.col("_h"))).alias("task"),
        F.least("_back", F.lit(1)).alias("side"), F.col("_own").alias("piece"), "rid", "vector",
    ).withColumn("piece", F.xxhash64("task", "piece"))


def _links(usable: DataFrame, dims: int, threshold: float, blocks: int) -> DataFrame:
    n = int(usable.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = _dealt(usable, dims).repartition(n, "task").sortWithinPartitions("task", "side", "piece")
    return tasks.mapInArrow(
        _verifier(dims, threshold, blocks), "rid long, root long, links long"
    )


def op5_rows(vectors: DataFrame) -> DataFrame:
    return linked_vectors(vectors)
