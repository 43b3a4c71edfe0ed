import pytest
from pyspark.sql import functions as F

from tablequill import constants as K
from tablequill.functions import scale
from tablequill.operators import candidates, evaluate, runs


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(expr).first()[0]


@pytest.mark.parametrize(
    "sql, normal",
    [
        ('SELECT  a\n FROM\tt WHERE b = "X"', "select a from t where b = 'x'"),
        (" select 1　", "select 1"),
        ("a;", "a;"),
        ("", ""),
        ("\x1f a\x85b ", "a b"),
    ],
)
def test_normal_form(spark, sql, normal):
    assert one(spark, evaluate.normal_form(F.col("s")), s=sql) == normal


def test_normal_form_matches_python_split(spark):
    """Every character that str.split() takes for white space, and none else."""
    texts = [f"a{chr(c)}b" for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = df.select("s", evaluate.collapse(F.col("s")).alias("c")).collect()
    assert all(r.c == " ".join(r.s.split()) for r in got)


def pairs(spark, *rows):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "example_id long, gold_sql string, pred_sql string, gold_ran boolean, pred_ran boolean,"
        " same_result boolean",
    )


def test_verdicts(spark):
    df = pairs(
        spark,
        ("A", "a", False, False, False),   # equal text: execution does not matter
        ("A", "b", True, True, True),
        ("A", "b", True, True, False),
        ("A", "b", False, False, True),    # neither ran
        ("A", "b", True, False, True),     # one ran
    )
    got = [
        (r.exact_match, r.execution_match, r.exec_error)
        for r in evaluate.verdicts(df).orderBy("example_id").collect()
    ]
    assert got == [
        (True, True, False), (False, True, False), (False, False, False),
        (False, False, True), (False, False, False),
    ]
    egd = evaluate.verdicts(df, start_from_exact=False).orderBy("example_id").collect()
    assert [r.execution_match for r in egd] == [False, True, False, False, False]


def test_result_sets(spark):
    rows = spark.createDataFrame(
        [
            (1, "gold", ["a", "1"]), (1, "pred", ["a", "1"]), (1, "pred", ["a", "1"]),
            (2, "gold", ["a"]), (2, "pred", ["a"]), (2, "pred", ["b"]),
            (3, "gold", ["a", "b"]), (3, "pred", ["b", "a"]),
            (4, "gold", [None]), (4, "pred", [None]),
            (6, "gold", ["x"]), (6, "pred", ["x"]),
        ],
        "example_id long, side string, row array<string>",
    )
    ran = spark.createDataFrame(
        [(i, True, i != 6) for i in range(1, 7)], "example_id long, gold_ran boolean, pred_ran boolean"
    )
    got = {r.example_id: r.same_result for r in evaluate.same_result_sets(rows, ran).collect()}
    # 5 has no row on either side: two empty results are equal; 6 did not run
    assert got == {1: True, 2: False, 3: False, 4: True, 5: True, 6: False}


@pytest.mark.parametrize(
    "sql, expected",
    [
        ("select count(*) from t group by a having count(*) > 1",
         {"has_group_by", "has_having", "has_aggregation"}),
        ("SELECT a FROM t JOIN u WHERE x IN (SELECT y FROM v) ORDER BY a LIMIT 1",
         {"has_join", "has_where", "has_subquery", "has_order_by", "has_limit"}),
        ("SELECT DISTINCT a FROM t EXCEPT SELECT b FROM u", {"has_distinct", "has_union", "has_subquery"}),
        ("SELECT count (a) FROM t", set()),
    ],
)
def test_operations(spark, sql, expected):
    flags = evaluate.operation_flags(F.col("s"))
    assert len(flags) == 10
    row = spark.createDataFrame([(sql,)], "s string").select(
        *[f.alias(n) for n, f in flags.items()]
    ).first()
    assert {n for n in flags if row[n]} == expected


def test_table_estimate(spark):
    def n(sql):
        return one(spark, evaluate.table_estimate(F.col("s")), s=sql)

    assert n("SELECT 1") == 1
    assert n("select a from t join u on 1 = 1 where b in (select c from v)") == 3
    assert n("SELECT a FROM t\nJOIN u") == 1


@pytest.mark.parametrize(
    "tables, joins, sql, place",
    [
        (1, False, "SELECT a FROM (SELECT b FROM t)", 0),
        (1, True, "SELECT a", 1),
        (2, False, "SELECT a", 1),
        (2, False, "SELECT a FROM (SELECT b FROM t)", 3),
        (4, True, "SELECT a", 2),
        (5, True, "SELECT a", 3),
        (None, None, "SELECT a", 0),
    ],
)
def test_complexity(spark, tables, joins, sql, place):
    df = spark.createDataFrame([(tables, joins, sql)], "t int, j boolean, s string")
    got = df.select(evaluate.complexity_class(F.col("t"), F.col("j"), F.col("s"))).first()[0]
    assert got == K.COMPLEXITY_LABELS[place]


@pytest.fixture()
def scored(spark):
    rows = [
        (i, None if i % 5 == 4 else f"db{i % 5}", "SELECT a FROM t WHERE b" if i % 2 else "SELECT a",
         "x", 1, False, i % 3 == 0, i % 3 != 1, i % 10 == 1)
        for i in range(40)
    ]
    return spark.createDataFrame(
        rows,
        "example_id long, db_id string, gold_sql string, pred_sql string, num_tables int,"
        " has_join boolean, exact_match boolean, execution_match boolean, exec_error boolean",
    )


@pytest.fixture()
def train(spark):
    return spark.createDataFrame([("db0",), ("db0",), (None,)], "db_id string")


def test_overall(scored):
    r = evaluate.overall(scored).first()
    assert (r.total, r.em_correct, r.ex_correct, r.ex_only, r.execution_errors) == (40, 14, 27, 13, 4)
    assert (r.em_accuracy, r.ex_accuracy) == (35.0, 67.5)
    empty = evaluate.overall(scored.where("false")).first()
    assert (empty.total, empty.em_accuracy, empty.ex_accuracy) == (0, 0.0, 0.0)


def test_by_database(scored, train):
    got = evaluate.by_database(scored, train).collect()
    assert [(r.em_accuracy, r.db_id) for r in got] == sorted((r.em_accuracy, r.db_id) for r in got)
    assert {r.db_id: (r.eval_samples, r.train_samples) for r in got} == {
        "db0": (8, 2), "db1": (8, 0), "db2": (8, 0), "db3": (8, 0), "unknown": (8, 1),
    }


def test_worst(scored):
    got = evaluate.worst(scored, 1).collect()
    assert {r.kind: r.name for r in got} == {"database": "db2", "operation": "has_where"}


def test_filters(scored):
    def ids(df):
        return {r.db_id or "unknown" for r in df.collect()}

    assert evaluate.filter_databases(scored).count() == 40
    assert ids(evaluate.filter_databases(scored, include=["db1"], exclude=["db1"])) == {"db1"}
    assert ids(evaluate.filter_databases(scored, exclude=["unknown", "db9"])) == {"db0", "db1", "db2", "db3"}
    assert evaluate.removed_by_database(scored, include=["db1"]).count() == 4
    assert evaluate.removed_by_database(scored).count() == 0


def test_distribution(scored):
    got = evaluate.database_distribution(scored, 2).collect()
    assert [(r.db_id, r.samples, r.share, r.databases_left) for r in got] == [
        ("db0", 8, 20.0, 3), ("db1", 8, 20.0, 3),
    ]


def test_capped_by_database(spark, scored, train):
    train = train.union(spark.createDataFrame([("elsewhere",)], "db_id string"))
    got = {r.db_id: r for r in evaluate.by_database_capped(scored, "example_id", 2, train).collect()}
    assert got["db0"].total == 2 and got[None].total == 10 and got[None].train_samples == 4
    assert got[None].em_correct == sum(r.em_correct for d, r in got.items() if d)


def test_alignment(spark):
    gold = spark.createDataFrame([(1, "a"), (2, "b")], "example_id long, gold_sql string")
    pred = spark.createDataFrame([(2, "b"), (3, "c")], "example_id long, pred_sql string")
    got = sorted(tuple(r) for r in evaluate.unmatched_predictions(gold, pred).collect())
    assert got == [(1, "prediction"), (3, "gold")]


def test_show_examples(scored):
    got = evaluate.show_examples(scored, "example_id", 2, 3).collect()
    assert sorted((r.exact_match, r.example_id) for r in got) == [
        (False, 1), (False, 2), (False, 4), (True, 0), (True, 3),
    ]


def test_running_accuracy_over_buckets(scored, monkeypatch):
    monkeypatch.setattr(scale, "BUCKET_WIDTH", 7)
    df = scored.withColumn("example_id", F.col("example_id") * 3).withColumn("run_id", F.lit("r"))
    got = evaluate.running_accuracy(df, ["run_id"], "example_id").orderBy("rows_seen").collect()
    em = [sum(i % 3 == 0 for i in range(n)) for n in (10, 20, 30, 40)]
    assert [(r.rows_seen, r.em_correct) for r in got] == list(zip((10, 20, 30, 40), em))
    assert got[1].em_accuracy == 100 * em[1] / 20


def summary(spark, *rows):
    return spark.createDataFrame(
        rows, "run_id string, step string, em_accuracy double, ex_accuracy double, error string"
    )


def test_rank_and_best_run(spark):
    df = summary(
        spark,
        ("checkpoint-200", "200", 50.0, 60.0, None),
        ("checkpoint-1000", "1000", 55.0, 60.0, None),
        ("checkpoint-300", "300", 55.0, 60.0, None),
        ("final", "final", 90.0, 10.0, None),
        ("checkpoint-400", "400", 0.0, 0.0, "failed"),
    )
    got = runs.rank_runs(df).collect()
    assert [r.run_id for r in got] == [
        "checkpoint-300", "checkpoint-1000", "checkpoint-200", "final", "checkpoint-400",
    ]
    assert [r.run_id for r in got if r.best_em] == ["final"]
    assert [r.run_id for r in got if r.best_ex] == ["checkpoint-300"]
    # name order decides between equal runs, and the final run does not count
    assert runs.best_run(df, "em_accuracy").first().run_id == "checkpoint-1000"
    only = df.where("run_id = 'final'")
    assert runs.best_run(only).first().run_id == "final"
    assert runs.best_run(df.where("run_id IN ('final', 'checkpoint-400')")).count() == 0


def test_run_without_predictions(spark):
    listed = spark.createDataFrame([("checkpoint-5",), ("final",)], "run_id string")
    scored = spark.createDataFrame(
        [("final", True, True)], "run_id string, exact_match boolean, execution_match boolean"
    )
    got = {r.run_id: r for r in runs.run_summary(listed, scored).collect()}
    assert got["checkpoint-5"].error == runs.NO_PREDICTIONS and got["checkpoint-5"].step == "5"
    assert (got["final"].step, got["final"].em_accuracy, got["final"].error) == ("final", 100.0, None)


# --- candidates -------------------------------------------------------------------------


def offered(spark, *rows):
    return spark.createDataFrame(rows, "example_id long, ord int, sql string, executed boolean")


def test_scores_and_duplicates(spark):
    df = offered(
        spark, (1, 0, "SELECT 1", True), (1, 1, "select  1", True), (1, 2, "SELECT 2", True),
        (1, 3, "SELECT 3", True),
    )
    got = candidates.distinct_candidates(df).orderBy("ord").collect()
    assert [(r.sql, round(r.score, 6)) for r in got] == [
        ("SELECT 1", 1.0), ("SELECT 2", 0.9), ("SELECT 3", 0.8),
    ]


@pytest.mark.parametrize(
    "sql, error",
    [
        ("", K.ERROR_EMPTY), ("SHOW t", K.ERROR_NO_SELECT), ("SELECT 1", K.ERROR_NO_FROM),
        ("select count(1)", ""), ("select a from t", ""),
    ],
)
def test_syntax_gate(spark, sql, error):
    assert one(spark, candidates.syntax_error(F.col("s")), s=sql) == error


def test_selection(spark):
    ok, no_from = "SELECT a FROM t", "SELECT a"
    df = offered(
        spark,
        (1, 0, ok, True), (1, 2, ok + "1", True),
        (2, 0, ok, False), (2, 2, ok + "1", True),
        (3, 0, no_from, False), (3, 2, ok, False), (3, 3, ok + "1", True),
        (4, 0, no_from, True), (4, 2, ok, False), (4, 3, ok + "1", False),
        (5, 0, no_from, True), (5, 1, "x", True),
    )
    examples = spark.range(1, 7).toDF("example_id")
    chosen = candidates.select_candidate(examples, candidates.distinct_candidates(df))
    assert [(r.sql, r.method) for r in chosen.orderBy("example_id").collect()] == [
        (ok, "first_valid"), (ok, "first_syntax_valid"), (ok + "1", "executed"),
        (ok, "syntax_valid"), (no_from, "highest_score"), ("", "none"),
    ]
    rates = {r.method: r.share for r in candidates.method_rates(chosen).collect()}
    assert rates["executed"] == 100 / 6 and len(rates) == 6


@pytest.mark.parametrize("gold,pred,same", [
    ("1", "1.0D", True), ("1", "cast(1 as decimal(20,5))", True), ("1", "'1'", False), ("1", "true", True),
    ("0", "false", True), ("-0.0D", "0", True), ("0.1D", "0.1BD", True), ("1.5BD", "1.50BD", True),
    ("1e300D", "1e300D", True), ("1e-300D", "0", False), ("9223372036854775807", "9223372036854775806", False),
    ("cast('NaN' as double)", "cast('NaN' as double)", False), ("cast(null as int)", "cast(null as string)", True),
    ("cast(null as int)", "''", False), ("array(1, 2)", "array(1, 2)", True), ("array(1, 2)", "array(2, 1)", False),
    ("named_struct('b', 1, 'a', 2)", "named_struct('a', 2, 'b', 1)", True), ("X'41'", "'A'", False),
    ("date'2020-01-01'", "date'2020-01-01'", True), ("date'2020-01-01'", "'2020-01-01'", False),
    ("cast('Infinity' as double)", "cast('Infinity' as double)", True),
])
def test_typed_rows(spark, gold, pred, same):
    def variant(x):
        nested = x.startswith(("named_struct",))
        return f"to_variant_object({x})" if nested else f"cast({x} as variant)"

    rows = spark.sql(
        f"select 1L as example_id, 'gold' as side, array({variant(gold)}) as row"
        f" union all select 1L, 'pred', array({variant(pred)})"
    )
    runs = spark.createDataFrame([(1, True, True)], "example_id long, gold_ran boolean, pred_ran boolean")
    assert evaluate.same_typed_result_sets(rows, runs).first()["same_result"] is same


def test_typed_rows_are_sets(spark):
    rows = spark.sql("""
      select 1L as example_id, side, array(cast(v as variant), cast(null as variant)) as row
      from values ('gold', 1), ('gold', 1), ('gold', 2), ('pred', 2), ('pred', 1) t(side, v)""")
    runs = spark.createDataFrame(
        [(1, True, True), (2, True, True), (3, True, False)],
        "example_id long, gold_ran boolean, pred_ran boolean",
    )
    found = evaluate.same_typed_result_sets(rows, runs).collect()
    assert {r["example_id"]: r["same_result"] for r in found} == {1: True, 2: True, 3: False}
