"""Similar columns of different tables of one schema."""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablequill import constants as K
from tablequill.functions.scale import salted_join
from tablequill.functions.text import one_of
from tablequill.operators.similarity import similar_terms
from tablequill.session import settle


def name_parts(name: Column) -> Column:
    """Parts of a column name that carry meaning; all parts if none does."""
    parts = F.split(F.lower(F.translate(name, " ", "_")), "_")
    meaning = F.filter(parts, lambda p: (p != "") & ~one_of(p, K.WEAK_WORDS))
    return F.when(F.size(meaning) > 0, meaning).otherwise(parts)


def _named(columns: DataFrame) -> DataFrame:
    parts = name_parts(F.col("col_name"))
    return columns.select(
        "schema_id",
        "table_name",
        F.struct("table_ord", "col_ord").alias("place"),
        F.concat_ws(".", "table_name", "col_name").alias("full_name"),
        parts.alias("parts"),
    ).withColumn("n", F.size("parts"))


def similar_parts(named: DataFrame, term_vectors: DataFrame, threshold: float) -> DataFrame:
    """(schema_id, s_part, t_part, similarity) of the similar parts of names of a schema, stored."""
    parts = named.select("schema_id", F.explode("parts").alias("term")).distinct()
    # a part that most schemas have is one hot key
    vectors = salted_join(parts, term_vectors.select("term", "vector"), ["term"], ["schema_id"])
    return settle(
        similar_terms(vectors, vectors, ["schema_id"], threshold, cosine=True), "similar"
    ).toDF("schema_id", "s_part", "t_part", "similarity")


def _side(df: DataFrame, side: str, cols: list[str]) -> DataFrame:
    return df.select("schema_id", *[F.col(c).alias(f"{side}_{c}") for c in cols])


def similar_columns(
    columns: DataFrame,
    fks: DataFrame,
    term_vectors: DataFrame,
    threshold: float = K.VECTOR_THRESHOLD,
) -> DataFrame:
    """(schema_id, source, target, score, source_place, target_place).

    Names of one part compare directly; one part against many takes the best
    part; many against many needs both the first and the last parts to match
    and scores their mean. Pairs joined by a foreign key are left out. Only
    part pairs that reach the threshold are ever joined to columns.
    """
    named = _named(columns)
    similar = similar_parts(named, term_vectors, threshold)
    keep = ["place", "table_name", "full_name", "n"]
    entries = named.select("schema_id", *keep, F.explode(F.array_distinct("parts")).alias("part"))
    # One side has a single part; pairs of two composite names never meet here.
    met = (
        _side(entries.where("n = 1"), "s", [*keep, "part"])
        .join(similar, ["schema_id", "s_part"])
        .join(_side(entries, "t", [*keep, "part"]), ["schema_id", "t_part"])
        .where(F.col("s_table_name") != F.col("t_table_name"))
        .where((F.col("t_n") > 1) | (F.col("s_place") < F.col("t_place")))
    )
    turned = F.col("s_place") > F.col("t_place")

    def oriented(name: str, first: str, second: str) -> Column:
        return F.when(turned, F.col(f"{second}_{name}")).otherwise(F.col(f"{first}_{name}"))

    one_sided = (
        met.select(
            "schema_id",
            oriented("place", "s", "t").alias("s_place"),
            oriented("place", "t", "s").alias("t_place"),
            oriented("full_name", "s", "t").alias("s_full_name"),
            oriented("full_name", "t", "s").alias("t_full_name"),
            "similarity",
        )
        .groupBy("schema_id", "s_place", "t_place", "s_full_name", "t_full_name")
        .agg(F.max("similarity").alias("score"))
    )
    ordered = (F.col("s_place") < F.col("t_place")) & (F.col("s_table_name") != F.col("t_table_name"))
    ends = named.where(F.col("n") > 1).select(
        "schema_id", *keep,
        F.element_at("parts", 1).alias("first"), F.element_at("parts", -1).alias("last"),
    )
    first = similar.toDF("schema_id", "s_first", "t_first", "first_score")
    last = similar.toDF("schema_id", "s_last", "t_last", "last_score")
    both = (
        _side(ends, "s", [*keep, "first", "last"])
        .join(first, ["schema_id", "s_first"])
        .join(last, ["schema_id", "s_last"])
        .join(_side(ends, "t", [*keep, "first", "last"]), ["schema_id", "t_first", "t_last"])
        .where(ordered)
        .withColumn("score", (F.col("first_score") + F.col("last_score")) / 2)
    )
    out = ["schema_id", "s_place", "t_place", "s_full_name", "t_full_name", "score"]
    pairs = one_sided.select(*out).unionByName(both.select(*out))

    source = F.concat_ws(".", "from_table", "from_column")
    target = F.concat_ws(".", "to_table", "to_column")
    one_way = fks.select("schema_id", source.alias("s_full_name"), target.alias("t_full_name"))
    other = fks.select("schema_id", target.alias("s_full_name"), source.alias("t_full_name"))
    linked = one_way.unionByName(other)
    return (
        pairs.join(linked, ["schema_id", "s_full_name", "t_full_name"], "left_anti")
        .select(
            "schema_id",
            F.col("s_full_name").alias("source"),
            F.col("t_full_name").alias("target"),
            "score",
            F.col("s_place").alias("source_place"),
            F.col("t_place").alias("target_place"),
        )
    )


def top_links(pairs: DataFrame, n: int = K.SEMANTIC_LINKS_PER_SCHEMA) -> DataFrame:
    """The ``n`` best pairs of every schema, in ``rank`` order.

    Spark limits the groups before the shuffle, see ``row_number() <= n``.
    """
    order = Window.partitionBy("schema_id").orderBy(
        F.desc("score"), "source_place", "target_place"
    )
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


# --- the best pairs without all pairs -------------------------------------------


def _best_first(n: int, digits: int):
    """Function from a schema's columns and similar parts to its ``n`` best pairs.

    Similar parts are opened in the order of their similarity. The columns under
    a pair of parts are sorted by place and paired lazily, the earliest pairs
    first, until ``n`` new pairs were seen; the search ends when the next bound
    lies below the n-th best score. It refers to nothing of this package, so that
    Python workers need no copy of the package on their path.
    """
    unit = Decimal(1).scaleb(-digits)

    def rounded(score: float) -> float:
        return float(Decimal(repr(score)).quantize(unit, ROUND_HALF_UP))

    def in_order(left: list[int], right: list[int], directed: bool) -> Iterator[tuple[int, int]]:
        """Pairs (s, t), s before t, one of each list; ``directed``: s of the left one."""
        if directed or left is right:
            for s in left:
                for t in right[bisect_right(right, s) :]:
                    yield s, t
            return
        ours, others = set(left), set(right)
        for s in heapq.merge(left, right):
            after = []
            if s in ours:
                after.append(iter(right[bisect_right(right, s) :]))
            if s in others:
                after.append(iter(left[bisect_right(left, s) :]))
            for t in heapq.merge(*after):
                yield s, t

    def best(columns: pa.Table, links: pa.Table) -> pa.Table:
        rows = sorted(columns.to_pylist(), key=lambda r: (r["table_ord"], r["col_ord"]))
        names, tables = [r["full_name"] for r in rows], [r["table_name"] for r in rows]
        single, whole, ends = defaultdict(list), defaultdict(list), defaultdict(lambda: defaultdict(list))
        for i, r in enumerate(rows):
            for part in dict.fromkeys(r["parts"]):
                whole[part].append(i)
            if len(r["parts"]) == 1:
                single[r["parts"][0]].append(i)
            else:
                ends[r["parts"][0]][r["parts"][-1]].append(i)
        linked, similar, near = set(), [], defaultdict(list)
        for r in links.to_pylist():
            if r["similarity"] is None:
                linked |= {(r["left"], r["right"]), (r["right"], r["left"])}
            else:
                similar.append((r["similarity"], r["left"], r["right"]))
                near[r["left"]].append((r["similarity"], r["right"]))
        similar.sort(key=lambda x: (-x[0], x[1], x[2]))
        most = similar[0][0] if similar else 0.0
        top: list[tuple[float, int, int]] = []
        seen: set[tuple[int, int]] = set()

        def below(score: float) -> bool:
            return len(top) == n and -rounded(score) > top[-1][0]

        def take(score: float, left: list[int], right: list[int], directed: bool) -> None:
            new, value = 0, -rounded(score)
            for s, t in in_order(left, right, directed):
                if tables[s] == tables[t] or (s, t) in seen or (names[s], names[t]) in linked:
                    continue
                seen.add((s, t))
                insort(top, (value, s, t))
                del top[n:]
                new += 1
                if new == n:
                    return

        for score, one, other in similar:
            if below(score):
                break
            if one in single and other in whole:
                take(score, single[one], whole[other], False)
        for first, one, other in similar:
            # whatever the last parts are, the mean is not above this
            if below((first + most) / 2):
                break
            if one in ends and other in ends:
                found = [
                    ((first + last) / 2, ends[one][a], ends[other][b])
                    for a in ends[one] for last, b in near[a] if b in ends[other]
                ]
                for score, left, right in sorted(found, key=lambda x: -x[0]):
                    if below(score):
                        break
                    take(score, left, right, True)
        schema_id = columns["schema_id"][0].as_py() if len(columns) else None
        return pa.table({
            "schema_id": pa.array([schema_id] * len(top), pa.string()),
            "source": pa.array([names[s] for _, s, _ in top], pa.string()),
            "target": pa.array([names[t] for _, _, t in top], pa.string()),
            "score": pa.array([-v for v, _, _ in top], pa.float64()),
            "rank": pa.array(range(1, len(top) + 1), pa.int32()),
        })

    return best


def best_links(
    columns: DataFrame, fks: DataFrame, term_vectors: DataFrame, threshold: float = K.VECTOR_THRESHOLD,
    n: int = K.SEMANTIC_LINKS_PER_SCHEMA, digits: int = 6,
) -> DataFrame:
    """(schema_id, source, target, score, rank): the ``n`` best pairs of ``similar_columns``.

    The rows of ``top_links`` of scores rounded to ``digits``, without the pairs
    that are not among them: what meets per schema are its columns and its
    similar name parts.
    """
    named = _named(columns)
    similar = similar_parts(named, term_vectors, threshold).select(
        "schema_id", F.col("s_part").alias("left"), F.col("t_part").alias("right"), "similarity"
    )
    linked = fks.select(
        "schema_id", F.concat_ws(".", "from_table", "from_column").alias("left"),
        F.concat_ws(".", "to_table", "to_column").alias("right"), F.lit(None).cast("double").alias("similarity"),
    )
    entries = named.select(
        "schema_id", "table_name", "full_name", "parts", F.col("place.table_ord").alias("table_ord"),
        F.col("place.col_ord").alias("col_ord"),
    )
    out = "schema_id string, source string, target string, score double, rank int"
    return (
        entries.groupBy("schema_id").cogroup(similar.unionByName(linked).groupBy("schema_id"))
        .applyInArrow(_best_first(n, digits), out)
    )
