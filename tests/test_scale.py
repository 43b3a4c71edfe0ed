"""The distributed helpers give what the plain window or join would give."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablequill.functions import scale


@pytest.fixture()
def narrow(monkeypatch):
    """Buckets of four keys."""
    monkeypatch.setattr(scale, "BUCKET_WIDTH", 4)


@pytest.fixture()
def rows(spark):
    """One partition holds most rows; keys have gaps and start below zero."""
    return spark.range(-7, 90).selectExpr(
        "id * 3 AS k", "CASE WHEN id % 7 = 0 THEN 'a' WHEN id = 11 THEN 'b' ELSE 'hot' END AS p"
    ).repartition(5)


@pytest.mark.parametrize("n", [1, 5, 12, 13, 100])
def test_first_rows(rows, narrow, n):
    got = scale.first_rows(rows, ["p"], "k", n)
    rank = F.row_number().over(Window.partitionBy("p").orderBy("k"))
    want = rows.withColumn("r", rank).where(F.col("r") <= n).drop("r")
    assert sorted(got.select("p", "k").collect()) == sorted(want.select("p", "k").collect())


def test_cutoff_of_an_empty_quota(rows, narrow):
    cut = scale.first_cutoffs(rows, ["p"], "k", F.expr("total * 9 div 10"))
    assert {r.p for r in cut.collect()} == {"a", "hot"}  # nine tenths of one row are none


def test_bucketed_row_number(rows, narrow):
    got = scale.bucketed_row_number(
        rows.withColumn("b", scale.key_bucket("k")), ["p"], ["b"], [F.col("k")], "n"
    )
    rank = F.row_number().over(Window.partitionBy("p").orderBy("k"))
    want = rows.withColumn("n", rank)
    cols = ["p", "k", "n"]
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())


def test_hash_order_buckets_agree_with_the_order(spark):
    df = spark.range(500).withColumn("h", scale.hash_order(42, F.col("id")))
    df = df.withColumn("b", scale.hash_bucket(F.col("h")))
    got = scale.bucketed_row_number(df, [], ["b"], [F.col("h"), F.col("id")], "n")
    want = df.withColumn("n", F.row_number().over(Window.orderBy("h", "id")))
    assert sorted(got.select("id", "n").collect()) == sorted(want.select("id", "n").collect())


def key(r):
    return tuple(map(str, r))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join(spark, rows, how, monkeypatch):
    monkeypatch.setattr(scale, "HOT_ROWS", 9)
    few = spark.createDataFrame([("hot", 1), ("hot", 4), ("b", 2), ("none", 3)], "p string, v int")
    hot = {r.p: r._salts for r in scale.hot_keys(rows, ["p"]).collect()}
    assert hot == {"hot": 10, "a": 2}
    got = scale.salted_join(rows, few, ["p"], ["k"], how)
    want = rows.join(few, "p", how)
    cols = ["p", "k", "v"]
    assert sorted(got.select(*cols).collect(), key=key) == sorted(
        want.select(*cols).collect(), key=key
    )


def test_salts_leave_no_large_sub_key(spark, monkeypatch):
    """One key has a third of all rows; no sub-key has much more than one in HOT_SHARE."""
    monkeypatch.setattr(scale, "HOT_ROWS", 10)
    monkeypatch.setattr(scale, "HOT_SHARE", 50)
    many = spark.range(30_000).selectExpr("id AS k", "if(id % 3 = 0, -1, id) AS p")
    salts = scale.hot_keys(many, ["p"]).collect()
    assert [(r.p, r._salts) for r in salts] == [(-1, 17)]
    sub = many.where("p = -1").groupBy(F.pmod(F.xxhash64("k"), F.lit(17))).count()
    assert sub.agg(F.max("count")).first()[0] < 30_000 / 50 * 1.3


@pytest.mark.parametrize("limit", [0, 10_000])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_attach_above_and_below_the_bound(spark, rows, monkeypatch, limit, how):
    monkeypatch.setattr(scale, "BROADCAST_BYTES", limit)
    few = spark.createDataFrame([("hot", 1), ("b", 2)], "p string, v int")
    got = scale.attach(rows, few, ["p"], ["k"], how)
    assert got.count() == rows.join(few, "p", how).count()
    assert got.where("v = 1").count() == rows.where("p = 'hot'").count()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("_salt" in plan) == (limit == 0)


@pytest.mark.parametrize("n", [1, 999, 1000, 1001])
def test_first_rows_with_null_groups_and_repeated_keys(spark, n):
    df = spark.range(3000).selectExpr("id div 7 AS k", "if(id % 2 = 0, NULL, 'p') AS p", "id AS other")
    got = scale.first_rows(df, ["p"], "k", n).collect()
    assert sorted(str(r.p) for r in got) == ["None"] * n + ["p"] * n
    assert len({r.other for r in got}) == 2 * n
    last = {p: max(r.k for r in got if r.p == p) for p in (None, "p")}
    left_out = {r.k for r in df.collect() if r.other not in {g.other for g in got} and r.p is None}
    assert min(left_out) >= last[None]


def test_null_keys_match_and_spread(spark, monkeypatch):
    monkeypatch.setattr(scale, "HOT_ROWS", 5)
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 0)
    many = spark.range(40).selectExpr("id AS k", "if(id < 30, NULL, 'a') AS p")
    few = spark.createDataFrame([(None, 1), ("a", 2)], "p string, v int")
    got = scale.attach(many, few, ["p"], ["k"], null_safe=True)
    assert sorted((r.k, r.v) for r in got.collect()) == [(i, 1 if i < 30 else 2) for i in range(40)]
    assert scale.salted_join(many, few, ["p"], ["k"], "left").where("v is null").count() == 30


def test_range_row_number(spark):
    df = spark.range(1000).selectExpr("id % 3 AS a", "cast(id AS string) AS b")
    got = scale.range_row_number(df, [F.col("a").desc(), F.col("b").asc()], "n")
    want = df.withColumn("n", F.row_number().over(Window.orderBy(F.desc("a"), "b")))
    assert sorted(got.select("b", "n").collect()) == sorted(want.select("b", "n").collect())


@pytest.mark.parametrize("n", [1, 3, 7])
def test_first_rows_both_ways(spark, monkeypatch, n):
    """Ranked and counted cuts agree, with NULL groups and equal keys."""
    rows = [(g, k, f"v{k}{j}") for g in ("a", "b", None) for k in range(4) for j in range(3)]
    frame = spark.createDataFrame(rows, "g string, k long, v string").repartition(5)
    ranked = sorted(scale.first_rows(frame, ["g"], "k", n).collect(), key=str)
    monkeypatch.setattr(scale, "RANKED_ROWS", 0)
    assert sorted(scale.first_rows(frame, ["g"], "k", n).collect(), key=str) == ranked
    assert len(ranked) == 3 * n
