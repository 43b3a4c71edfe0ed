"""Joins, ranks and cuts that hold when one key has a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablequill.session import settle, settle_sized

# A key is hot if it holds more than one row in HOT_SHARE, and more than HOT_ROWS rows.
HOT_SHARE = 1000
HOT_ROWS = 100_000
# Values per bucket of an integer key; also the most values one task sorts.
BUCKET_WIDTH = 65536
# Up to so many rows per group ``first_rows`` ranks what the tasks have left over.
RANKED_ROWS = 256
# A settled table of at most this size (bytes of JSON) may be broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on columns of the same name in which NULL equals NULL; keeps the left keys."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(
        Column.__and__, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    )
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def hot_keys(many: DataFrame, keys: list[str]) -> DataFrame:
    """Hot keys with the number of salts each needs.

    Fewer than HOT_SHARE keys can hold more than one row in HOT_SHARE, so the
    result may be broadcast whatever the size of ``many``. NULL is a key.
    """
    counts = many.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    limit = F.greatest(F.floor(total / F.lit(HOT_SHARE)), F.lit(HOT_ROWS))
    return counts.where(F.col("_n") > limit).select(
        *keys, F.ceil(F.col("_n") / limit).cast("int").alias("_salts")
    )


def salted_join(
    many: DataFrame, few: DataFrame, keys: list[str], spread: list[str], how: str = "inner",
    null_safe: bool = False,
) -> DataFrame:
    """Join where single keys may hold a large share of ``many``.

    Rows of a hot key spread over sub-keys by the columns ``spread`` until no
    sub-key holds more than about one row in HOT_SHARE; only the rows of
    ``few`` with a hot key are repeated. Rows with a NULL key spread as well.
    """
    hot = F.broadcast(hot_keys(many, keys))
    salt = F.pmod(F.xxhash64(*spread), F.coalesce("_salts", F.lit(1))).cast("int")
    left = null_safe_join(many, hot, keys, "left").withColumn("_salt", salt).drop("_salts")
    last = F.coalesce("_salts", F.lit(1)) - 1
    right = (
        null_safe_join(few, hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), last)))
        .drop("_salts")
    )
    if null_safe:
        return null_safe_join(left, right, keys + ["_salt"], how).drop("_salt")
    return left.join(right, keys + ["_salt"], how).drop("_salt")


def attach(
    many: DataFrame, few: DataFrame, keys: list[str], spread: list[str], how: str = "inner",
    null_safe: bool = False,
) -> DataFrame:
    """Join with a table that is small compared to ``many``.

    ``few`` is stored first and measured while it is written: below the bound
    it is broadcast and ``many`` stays where it is, beyond it the join is salted.
    With ``null_safe`` a NULL key matches a NULL key.
    """
    few, size = settle_sized(few, "few")
    if size > BROADCAST_BYTES:
        return salted_join(many, few, keys, spread, how, null_safe)
    if null_safe:
        return null_safe_join(many, F.broadcast(few), keys, how)
    return many.join(F.broadcast(few), keys, how)


def key_bucket(key: str) -> Column:
    """Bucket of an integer key; holds at most BUCKET_WIDTH different keys.

    The key should be an ordinal without large gaps, such as a row number or
    ``readers.with_ordinal``: the number of buckets is the key range / BUCKET_WIDTH.
    """
    return F.expr(f"(`{key}` - pmod(`{key}`, {BUCKET_WIDTH}L)) div {BUCKET_WIDTH}")


def hash_order(seed: int, key: Column) -> Column:
    """Reproducible pseudo-random order key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_bucket(order_key: Column, digits: int = 3) -> Column:
    """One of 16 ** digits buckets in the order of ``hash_order``."""
    return F.substring(order_key, 1, digits)


def hash_digits(rows: int) -> int:
    """Digits for ``hash_bucket`` with which a bucket has at most about BUCKET_WIDTH of ``rows``."""
    digits = 3
    while 16**digits * BUCKET_WIDTH < rows:
        digits += 1
    return digits


def bucket_offsets(df: DataFrame, partition: list[str], bucket: list[str], sums: dict) -> DataFrame:
    """Per bucket: totals of ``sums`` and the totals of all earlier buckets.

    Only the pre-aggregated buckets reach the window, never the rows.
    """
    totals = df.groupBy(*partition, *bucket).agg(*[e.alias(n) for n, e in sums.items()])
    earlier = (
        Window.partitionBy(*[F.col(c) for c in partition])
        .orderBy(*[F.col(c) for c in bucket])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return totals.select(
        "*", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_before") for n in sums]
    )


def bucketed_row_number(
    df: DataFrame, partition: list[str], bucket: list[str], order: list[Column], name: str
) -> DataFrame:
    """``row_number()`` per partition without sorting a partition in one task.

    ``bucket`` must be columns whose ascending order agrees with ``order``.
    """
    offsets = bucket_offsets(df, partition, bucket, {"_n": F.count("*")})
    inside = Window.partitionBy(*partition, *bucket).orderBy(*order)
    keys = partition + bucket
    return (
        null_safe_join(df, offsets.select(*keys, "_n_before"), keys)
        .withColumn(name, F.row_number().over(inside) + F.col("_n_before"))
        .drop("_n_before")
    )


def range_row_number(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``row_number()`` over all rows: ranges of the order are dealt out and stored, the
    counts of the ranges summed up, and every range is sorted by itself."""
    part = f"_{name}_part"
    stored = settle(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    # one row per range reaches this window
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = stored.groupBy(part).agg(F.count("*").alias("_n")).select(
        part, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(part).orderBy(*order)
    return (
        stored.join(before, part)
        .withColumn(name, F.row_number().over(inside) + F.col("_before"))
        .drop(part, "_before")
    )


def first_cutoffs(df: DataFrame, partition: list[str], key: str, quota: Column) -> DataFrame:
    """(partition, cutoff, at_cutoff): where the first ``quota`` rows by ``key`` end.

    ``cutoff`` is the key of the last of them, ``at_cutoff`` how many rows with
    this key belong to them. ``key`` is an integer, ``quota`` an expression over
    ``total``. Counts per key bucket find the bucket the quota ends in; only the
    counts of its keys are sorted.
    """
    keys = df.select(*partition, key, key_bucket(key).alias("_bucket"))
    sizes = bucket_offsets(keys, partition, ["_bucket"], {"_n": F.count("*")})
    everything = Window.partitionBy(*[F.col(c) for c in partition])
    last = (
        sizes.withColumn("total", F.sum("_n").over(everything))
        .withColumn("_quota", F.least(quota, F.col("total")).cast("long"))
        .where((F.col("_n_before") < F.col("_quota")))
        .where(F.col("_n_before") + F.col("_n") >= F.col("_quota"))
        .select(*partition, "_bucket", (F.col("_quota") - F.col("_n_before")).alias("_k"))
    )
    upto = (
        Window.partitionBy(*[F.col(c) for c in partition])
        .orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        null_safe_join(keys, last, partition + ["_bucket"])
        .groupBy(*partition, "_k", key).agg(F.count("*").alias("_n"))
        .withColumn("_upto", F.sum("_n").over(upto))
        .where((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_n") < F.col("_k")))
        .select(*partition, F.col(key).alias("cutoff"),
                (F.col("_k") - F.col("_upto") + F.col("_n")).alias("at_cutoff"))
    )


def before_cutoff(df: DataFrame, cut: DataFrame, partition: list[str], key: str, name: str) -> DataFrame:
    """Adds the flag ``name``: the row is among the rows that ``first_cutoffs`` counts.

    Wide rows are compared with the cut where they are. Only if a cut divides
    rows with the same key, those rows are numbered, in the order of a hash of
    all their columns.
    """
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    rows = attach(df.withColumn("_tie", spread), cut, partition, ["_tie"], "left", null_safe=True)
    inside = F.coalesce(F.col(key) < F.col("cutoff"), F.lit(False))
    at = F.coalesce(F.col(key) == F.col("cutoff"), F.lit(False))
    order = Window.partitionBy(*[F.col(c) for c in partition], key).orderBy("_tie")
    extra = ["_tie", "cutoff", "at_cutoff"]
    clear = rows.where(~at).withColumn(name, inside).drop(*extra)
    edge = rows.where(at).withColumn(name, F.row_number().over(order) <= F.col("at_cutoff")).drop(*extra)
    return clear.unionByName(edge)


def first_rows(df: DataFrame, partition: list[str], key: str, n: int) -> DataFrame:
    """The first ``n`` rows by ``key`` of every partition; NULL is a partition like any other.

    Rows with the same key come in the order of a hash of all their columns.
    For a small ``n`` every task keeps its own first rows of each group and only
    those are shuffled and ranked; beyond that counts find the cut first.
    """
    if n <= RANKED_ROWS:
        tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
        order = Window.partitionBy(*[F.col(c) for c in partition]).orderBy(F.col(key), tie)
        ranked = df.where(F.col(key).isNotNull()).withColumn("_first", F.row_number().over(order))
        return ranked.where(F.col("_first") <= n).drop("_first")
    cut = first_cutoffs(df, partition, key, F.lit(n))
    return before_cutoff(df, cut, partition, key, "_first").where("_first").drop("_first")
