"""Similar pairs of vectors within a group, as products of bounded blocks.

In a group of more than one block the vectors are laid out by their nearest of a
few pivots and their angle to it, so that a block holds vectors of one
direction. A block knows the range of its angles to every pivot and its longest
vector: two blocks meet in a product only if these ranges leave room for a pair
that reaches the threshold (triangle inequality of angles). No pair is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablequill.functions.scale import bucket_offsets, first_rows, null_safe_join, salted_join
from tablequill.session import settle

# Vectors per block: bounds a task's memory whatever the size of a group.
BLOCK = 512
# Directions that the vectors of a large group are measured against.
PIVOTS = 8
# Steps of the angle to the nearest pivot by which vectors are laid out.
ANGLE_STEPS = 1024
# Allowance for rounding in angles and norms.
SLACK = 1e-6
# Groups with more than one pair of blocks.
LARGE = "left_blocks > 1 OR right_blocks > 1"


def _sizes(left: DataFrame, right: DataFrame, group: list[str]) -> DataFrame:
    """Blocks of each side and cells of the grid they meet in, per group."""

    def count(side: DataFrame, name: str) -> DataFrame:
        blocks = F.ceil(F.count("*") / BLOCK).cast("int")
        return side.groupBy(*group).agg(
            blocks.alias(f"{name}_blocks"), F.ceil(F.sqrt(blocks)).cast("int").alias(f"{name}_cells")
        )

    return count(left, "left").join(count(right, "right"), group)


def _norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x * x))


def _measurable(norm: Column) -> Column:
    return (norm > 0) & (norm < float("inf"))


def _pivots(vectors: DataFrame, sizes: DataFrame, group: list[str]) -> DataFrame:
    """(group, pivots): up to PIVOTS unit vectors of each large group, picked by hash."""
    large = sizes.where(LARGE).select(*group)
    vector = F.col("vector").cast("array<double>")
    candidates = (
        vectors.join(large, group)
        .select(*group, vector.alias("vector"), F.xxhash64("term").alias("_pick"))
        .withColumn("_norm", _norm(F.col("vector")))
        .where(_measurable(F.col("_norm")))
    )
    unit = F.transform("vector", lambda x: x / F.col("_norm"))
    picked = first_rows(candidates, group, "_pick", PIVOTS)
    return picked.groupBy(*group).agg(F.collect_list(unit).alias("pivots"))


def _laid_out(sized: DataFrame, pivots: DataFrame, group: list[str]) -> DataFrame:
    """Vectors of large groups with their block, norm and ranges of angles to the pivots.

    The place of a vector comes from counts per pivot and step of the angle;
    within a step from its hash, so equal directions fill several blocks too.
    Vectors without a usable norm get the whole range: they meet every block.
    """
    def angle(pivot: Column) -> Column:
        dot = F.aggregate(
            F.zip_with(pivot, "vector", lambda a, b: a * b), F.lit(0.0), lambda total, x: total + x
        )
        return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / F.col("_norm"))))

    known = _measurable(F.col("_norm")) & F.col("pivots").isNotNull()
    measured = (
        salted_join(sized, pivots, group, ["term"], "left")
        .withColumn("_norm", _norm(F.col("vector")))
        .withColumn("_angles", F.when(known, F.transform("pivots", angle)))
        .drop("pivots")
        .withColumn("_least", F.array_min("_angles"))
    )
    nearest = F.array_position("_angles", F.col("_least")).cast("int")
    step = F.floor(F.col("_least") / math.pi * (ANGLE_STEPS - 1)).cast("int")
    stepped = settle(
        measured.withColumn("_step", F.coalesce(nearest * ANGLE_STEPS + step, F.lit(0))), "angles"
    )
    before = bucket_offsets(stepped, group, ["_step"], {"_n": F.count("*")})
    place = F.col("_n_before") + F.pmod(F.xxhash64("term"), F.col("_n"))
    return (
        null_safe_join(stepped, before, [*group, "_step"])
        .withColumn("_block", F.floor(place / BLOCK))
        .withColumn("_low", F.coalesce("_angles", F.array_repeat(F.lit(0.0), PIVOTS)))
        .withColumn("_high", F.coalesce("_angles", F.array_repeat(F.lit(math.pi), PIVOTS)))
    )


def _blocks(
    vectors: DataFrame, sizes: DataFrame, pivots: DataFrame | None, group: list[str], side: str, other: str
) -> DataFrame:
    """Vectors in blocks of about BLOCK, each repeated for the cells of the other side.

    A group of n blocks becomes a grid of about sqrt(n) x sqrt(n) cells: a block
    is sent sqrt(n) times instead of n times, and every cell is its own task.
    """
    sized = salted_join(vectors, sizes, group, ["term"]).withColumn(
        "vector", F.col("vector").cast("array<double>")
    )
    none = F.lit(None).cast("array<double>")
    rows = (
        sized.where(f"NOT ({LARGE})").withColumn("_block", F.lit(0).cast("long"))
        .withColumn("_norm", F.lit(None).cast("double"))
        .withColumn("_low", none).withColumn("_high", none)
    )
    kept = [*group, "term", "vector", f"{side}_cells", f"{other}_cells", "_block", "_norm", "_low", "_high"]
    rows = rows.select(*kept)
    if pivots is not None:
        rows = rows.unionByName(_laid_out(sized.where(LARGE), pivots, group).select(*kept))
    packed = rows.groupBy(*group, f"{side}_cells", f"{other}_cells", "_block").agg(
        F.collect_list(F.struct("term", "vector")).alias(side),
        F.max("_norm").alias(f"{side}_norm"),
        F.array(*[F.min(F.get("_low", F.lit(j))) for j in range(PIVOTS)]).alias(f"{side}_low"),
        F.array(*[F.max(F.get("_high", F.lit(j))) for j in range(PIVOTS)]).alias(f"{side}_high"),
    )
    return packed.select(
        *group,
        side, f"{side}_norm", f"{side}_low", f"{side}_high",
        (F.col("_block") % F.col(f"{side}_cells")).cast("int").alias(f"{side}_cell"),
        F.explode(F.sequence(F.lit(0), F.col(f"{other}_cells") - 1)).alias(f"{other}_cell"),
    )


def _within_reach(threshold: float, cosine: bool) -> Column:
    """Whether two blocks can hold a pair that reaches the threshold; NULL bounds say yes.

    A pivot that only some vectors have is NULL or left out by ``array_max``.
    """
    def apart(low: str, high: str) -> Column:
        return F.zip_with(low, high, lambda a, b: a - b)

    gaps = F.zip_with(
        apart("left_low", "right_high"), apart("right_low", "left_high"), lambda a, b: F.greatest(a, b)
    )
    gap = F.greatest(F.array_max(gaps) - SLACK, F.lit(0.0))
    norms = F.lit(1.0) if cosine else F.col("left_norm") * F.col("right_norm")
    bound = norms * (1 + SLACK) * F.cos(gap)
    return F.coalesce(bound >= threshold, F.lit(True))


def block_pairs(
    left: DataFrame, right: DataFrame, group: list[str], threshold: float, cosine: bool
) -> DataFrame:
    """(group, left, right): the pairs of blocks whose product is taken."""
    # Counted, measured and then packed: each side is computed once.
    same = left is right
    left = settle(left, "vectors")
    right = left if same else settle(right, "vectors")
    sizes = settle(_sizes(left, right, group), "sizes")
    one_block = sizes.where(LARGE).isEmpty()
    pivots = None if one_block else settle(_pivots(right, sizes, group), "pivots")
    return (
        _blocks(left, sizes, pivots, group, "left", "right")
        .join(
            _blocks(right, sizes, pivots, group, "right", "left"),
            [*group, "left_cell", "right_cell"],
        )
        .where(_within_reach(threshold, cosine))
        .select(*group, "left", "right")
    )


def _multiplier(group: list[str], threshold: float, cosine: bool):
    """Function from batches of block pairs to batches of similar terms.

    It refers to nothing of this package, so that Python workers need no copy
    of the package on their path.
    """

    def matrix(block: pa.StructArray) -> tuple[pa.Array, np.ndarray]:
        terms = pc.struct_field(block, "term")
        flat = pc.list_flatten(pc.struct_field(block, "vector")).to_numpy(zero_copy_only=False)
        rows = flat.reshape(len(block), -1)
        if cosine:
            norms = np.linalg.norm(rows, axis=1, keepdims=True)
            rows = np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)
        return terms, rows

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lefts, rights = batch.column("left"), batch.column("right")
            for i in range(batch.num_rows):
                lterms, lrows = matrix(lefts[i].values)
                rterms, rrows = matrix(rights[i].values)
                sims = lrows @ rrows.T
                at_left, at_right = np.nonzero(sims >= threshold)
                arrays = [
                    pa.array([batch.column(g)[i].as_py()] * len(at_left), batch.column(g).type)
                    for g in group
                ]
                arrays += [lterms.take(pa.array(at_left)), rterms.take(pa.array(at_right))]
                arrays.append(pa.array(sims[at_left, at_right]))
                yield pa.RecordBatch.from_arrays(
                    arrays, names=[*group, "left_term", "right_term", "similarity"]
                )

    return multiply


def similar_terms(
    left: DataFrame, right: DataFrame, group: list[str], threshold: float, cosine: bool
) -> DataFrame:
    """(group, left_term, right_term, similarity) of pairs that reach the threshold.

    Both inputs are ``(group, term, vector)`` with distinct terms per group.
    Each pair of blocks is one matrix product; only pairs that reach the
    threshold leave it. ``cosine=False`` takes the plain dot product.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be positive")
    spread = block_pairs(left, right, group, threshold, cosine)
    schema = spread.select(*group).schema.add("left_term", "string").add("right_term", "string")
    schema = schema.add("similarity", "double")
    return spread.mapInArrow(_multiplier(group, threshold, cosine), schema)
