"""Connected components of links, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tablequill.session import settle


def _pairs(u, v) -> list:
    return [F.greatest(u, v).alias("u"), F.least(u, v).alias("v")]


def _stored(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The distinct edges, stored, and a fingerprint of their set."""
    seen = Observation()
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("digest")
    rows = edges.where("u <> v").distinct().observe(seen, F.count("*").alias("n"), digest)
    return settle(rows, "edges"), seen


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node that links lead to, for nodes with a link to another node.

    Large-star and small-star steps alternate until no edge changes: all
    neighbours of a node move to the smallest among them. The number of rounds
    grows with the logarithm of the longest path; every round is stored, so a
    lost executor costs one round at most. Only aggregates and equi-joins touch
    the edges, none collects a node's neighbours.
    """
    now, seen = _stored(edges.select(*_pairs(F.col(a), F.col(b))))
    before = None
    while True:
        state = (seen.get["n"], seen.get["digest"])
        if state == before or not state[0]:
            break
        before = state
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(*_pairs(F.col("v"), F.col("m")))
        large = large.where("u <> v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(smallest, "u").select(*_pairs(F.col("v"), F.col("m")))
        now, seen = _stored(
            moved.unionByName(smallest.select(F.col("u"), F.col("m").alias("v")))
        )
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
