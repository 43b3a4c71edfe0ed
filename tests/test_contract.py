"""Every registered query against its SQL on the smallest tables."""

import ast
import os
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import oracle_check
from tablequill.plans.oracles import ORACLES
from tablequill.plans.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return oracle_check.connect(SF_DIR)


def test_names_agree():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["operation", "total", "em_correct", "ex_correct", "em_accuracy", "ex_accuracy"]
    assert df.count() == 10


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    rows, problems = oracle_check.compare(df, duck, entry.oracle_sql()[name])
    assert problems == [] and rows > 0


def test_no_name_is_defined_twice():
    """A second definition silently replaces the first one for all callers."""
    package = Path(entry.__file__).parent / "tablequill"
    twice = {}
    for file in package.rglob("*.py"):
        kinds = (ast.FunctionDef, ast.ClassDef)
        names = Counter(n.name for n in ast.parse(file.read_text()).body if isinstance(n, kinds) and n.name != "_")
        twice |= {f"{file.name}:{name}": n for name, n in names.items() if n > 1}
    assert twice == {}


def test_whole_preparation_is_not_cut(spark):
    from tablequill.plans.queries import FIRST_N

    for name in ("job_prepare_all", "job_prepare"):
        rows = entry.queries()[name](spark, SF_DIR)
        counts = rows.select("records") if "records" in rows.columns else rows.groupBy("dataset", "split").count().select("count")
        assert max(r[0] for r in counts.collect()) > FIRST_N


def test_preparation_returns_the_records_of_every_format(spark):
    """As many rows as the preparation has, in each format, with their texts."""
    rows = entry.queries()["job_prepare"](spark, SF_DIR)
    whole = entry.queries()["job_prepare_all"](spark, SF_DIR).count()
    filled = rows.groupBy("format").agg(F.count("input").alias("inputs"), F.count("output").alias("outputs"))
    assert {(r.format, r.inputs, r.outputs) for r in filled.collect()} == {
        (name, whole, whole) for name in ("lines", "instruction", "chat")
    }


LARGE = [
    "split_positional", "limit_first_n", "lf_balanced_sample", "corpus_shuffle_order", "corpus_ddl",
    "corpus_catalog", "link_table_partial", "link_column_word", "link_column_vector",
    "link_value_columns", "sem_top5", "seq_vocab", "seq_encode", "eval_running", "eval_by_db_capped",
]


@pytest.mark.parametrize("name", LARGE)
def test_query_without_small_data_shortcuts(spark, duck, name, monkeypatch):
    """Nothing is small enough to broadcast, keys are hot early, blocks and chunks are tiny."""
    from tablequill.functions import scale
    from tablequill.operators import linking, sequences, similarity
    from tablequill.plans import fixtures

    # tables that the tests above stored are built again, under the changed limits
    monkeypatch.setattr(fixtures, "_settled", {})

    for module, constant, value in [
        (scale, "BROADCAST_BYTES", 0), (scale, "HOT_ROWS", 5), (scale, "BUCKET_WIDTH", 17),
        (similarity, "BLOCK", 20), (linking, "CHUNK_TABLES", 3),
        (linking, "CHUNK_COLUMNS", 2), (sequences, "HOT_WORDS", 50),
    ]:
        monkeypatch.setattr(module, constant, value)
    sizes = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for conf in sizes:
        spark.conf.set(conf, "-1")
    try:
        df = entry.queries()[name](spark, SF_DIR)
        rows, problems = oracle_check.compare(df, duck, entry.oracle_sql()[name])
    finally:
        for conf in sizes:
            spark.conf.unset(conf)
    assert problems == [] and rows > 0
