"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources get targets in words; a target above a cap is cut and the rest shared
again by weight. Of a source, complete epochs are taken first; the remainder is
a weighted sample without replacement: documents in the order of exponential
keys -ln(u) / weight, from a hash u of the id and the text and the quality weight, are
taken until the words reach the budget. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablequill.llm.rows import boxed, unboxed
from tablequill.session import settle

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = 11
# Buckets per unit of ln(key): none holds more than about 1/2700 of a source,
# whatever the weights, so no task sorts more of a source than that.
BUCKETS = 1024

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Between 0.05 and 1: less the more symbols and repeated marks a text has.

    Exact in every engine: a quotient of two counts of characters.
    """
    marked = F.length(text) - F.length(F.translate(text, "#*$%&|<>!", ""))
    share = F.coalesce(marked, F.lit(0)) / F.greatest(F.coalesce(F.length(text), F.lit(0)), F.lit(1))
    return F.greatest(F.lit(0.05), 1 - 4 * share)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, NULL last, weigh ``weights`` in turn and share
    ``share`` of all sizes. A target stops at ``cap`` times the source's size:
    with the sources in the order of cap / weight, those that stop come first
    and leave a higher level (words per weight) to the rest; the first source
    that does not stop fixes the level. One row per source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(place, F.lit(len(weights))) + 1)
    caps = F.col("source_size") * F.lit(cap)
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("_place"))
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = sources.withColumn("_place", place).withColumn("_weight", weight.cast("long")).withColumn("_cap", caps)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    rows = rows.withColumn("_total", total).withColumn("_weights", F.sum("_weight").over(everything))
    left = F.col("_total") - F.coalesce(F.sum("_cap").over(earlier), F.lit(0))
    rest = F.col("_weights") - F.coalesce(F.sum("_weight").over(earlier), F.lit(0))
    rows = rows.withColumn("_level", left / rest)
    below = F.col("_level") * F.col("_weight") <= F.col("_cap")
    level = F.min_by(F.when(below, F.col("_level")), F.when(below, F.struct(F.col("_cap") / F.col("_weight"), "_place"))).over(everything)
    reached = F.least(F.col("_cap").cast("double"), F.coalesce(level * F.col("_weight"), F.col("_cap").cast("double")))
    return rows.select("source", "source_size", reached.alias("target"))


def _uniform(key: Column, text: Column, seed: int) -> Column:
    """In (0, 1), from the first 13 hexadecimal digits of an MD5 hash of the id and the text's hash."""
    id_text, none = key.cast("string"), F.lit("")
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_text, none), F.lit(":"), text)), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))


def _sizes(docs: DataFrame, id_col: str, text: str, source: str, weight: Column | None, seed: int) -> DataFrame:
    weight = quality_weight(F.col(text)) if weight is None else weight
    return docs.select(
        F.col(id_col).alias("_id"), F.col(source).alias("_source"),
        n_words(F.col(text)).alias("_size"), F.coalesce(F.md5(F.col(text)), F.lit("")).alias("_hash"),
        weight.alias("_weight"),
    ).withColumn(
        "_key", -F.ln(_uniform(F.col("_id"), F.col("_hash"), seed)) / F.col("_weight")
    ).withColumn("_bucket", F.floor(F.ln("_key") * BUCKETS)).drop("_weight")


def _taken(rows: DataFrame, shares: dict) -> DataFrame:
    """Adds _source_size, _target, _epochs and _part to stored rows of ``_sizes``."""
    # sums per source and bucket; neither they nor their windows see a document
    sums = rows.groupBy("_source", "_bucket").agg(F.sum("_size").alias("n"))
    sources = sums.groupBy(F.col("_source").alias("source")).agg(F.sum("n").alias("source_size"))
    goals = targets(sources, **shares)
    earlier = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(
        F.col("_source").alias("_s"), F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"),
    )
    # the targets ride on the buckets: one small table meets the documents
    before = before.join(goals, F.col("_s").eqNullSafe(goals["source"])).select(
        "_s", "_b", "_before", F.col("source_size").alias("_source_size"), F.col("target").alias("_target")
    )
    inside = (
        Window.partitionBy("_source", "_bucket").orderBy("_key", "_id", "_hash", "_size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ranked = rows.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    placed = ranked.join(before, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    epochs = F.floor(F.col("_target") / F.greatest("_source_size", F.lit(1)))
    rest = F.floor("_target") - F.col("_epochs") * F.col("_source_size")
    part = F.least(F.col("_size"), rest - F.col("_before") - F.col("_inside"))
    return placed.withColumn("_epochs", epochs).withColumn("_part", F.greatest(F.lit(0), part))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
        weight: Column | None = None, seed: int = SEED, **shares) -> DataFrame:
    """(id, size, source_size, target, taken), one row per row of ``docs``.

    ``taken`` words: complete epochs of the source, then documents in the order
    of the sample while their sizes fit the rest of the target; the last one is
    taken in part, so a source's words add up to its target rounded down. NULL
    and empty texts have size 0 and take 0. A NULL source is a source, a NULL id is
    an id. Rows with equal ids are ordered by their texts, so that reruns agree in
    whatever order the rows are stored; only rows that are equal in both share a key.
    """
    rows = _taken(settle(_sizes(docs, id_col, text, source, weight, seed), "sizes"), shares)
    return rows.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_epochs") * F.col("_size") + F.col("_part")).cast("long").alias("taken"),
    )


def repeat_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                     source: str = "source", weight: Column | None = None, seed: int = SEED,
                     **shares) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, as often as the mix takes them.

    Documents stay whole: the one that the budget would cut is taken once more
    if at least half of it fits. Documents of size 0 are not taken. Rows with
    the same id and size are taken equally often, the most that one of them is.
    """
    mixed = mix(docs, id_col, text, source, weight, seed, **shares)
    times = F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5).cast("int")
    whole = mixed.select(F.col(id_col).alias("_id"), F.col("size").alias("_size"), times.alias("_times"))
    numbered = whole.groupBy("_id", "_size").agg(F.max("_times").alias("_times")).where("_times > 0")
    rows = boxed(docs, F.col(f"`{id_col}`").alias("own_id"), n_words(F.col(text)).alias("words"))
    same = F.col("own_id").eqNullSafe(F.col("_id")) & (F.col("words") == F.col("_size"))
    copies = rows.join(numbered, same).select("row", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return unboxed(copies)


def op6_rows(docs: DataFrame) -> DataFrame:
    return mix(docs)
