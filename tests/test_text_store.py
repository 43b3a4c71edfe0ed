from pathlib import Path

import pytest

from tablequill.operators import catalog as C
from tablequill.operators import corpora, text_store
from tablequill.plans import jobs

ONE = "CREATE TABLE a (id INT);"
TWO = "CREATE TABLE a (id INT); CREATE TABLE b (a_id INT);"
NEW = "CREATE TABLE c (n TEXT);"


def corpus(spark, *ddls):
    rows = [(i, "x", "train", f"q{i}", "SELECT 1", d) for i, d in enumerate(ddls)]
    return spark.createDataFrame(
        rows, "example_id long, dataset string, split string, question string, sql string, ddl string")


@pytest.fixture
def parsed(monkeypatch):
    """The DDL texts that each parse was asked for."""
    seen, parse = [], C.catalog_from_ddl

    def record(ddls, strict=False):
        seen.append(sorted(r.ddl for r in ddls.collect()))
        return parse(ddls, strict)

    monkeypatch.setattr(C, "catalog_from_ddl", record)
    return seen


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_only_unseen_texts_are_parsed(spark, tmp_path, parsed):
    store = str(tmp_path / "texts")
    first = corpus(spark, ONE, TWO, ONE, "none", None)
    assert rows(corpora.from_ddl(first, known=text_store.ddl_texts(first, store), drop_empty=[])) == rows(
        corpora.from_ddl(first, catalog=C.catalog_from_ddl(first.selectExpr("sha2(ddl, 256) AS schema_id", "ddl").where("ddl IS NOT NULL").distinct()), drop_empty=[])
    )
    assert parsed[0] == sorted([ONE, TWO, "none"])
    second = corpus(spark, NEW, TWO, "none", TWO)
    got = text_store.ddl_texts(second, store)
    assert parsed[2:] == [[NEW]]
    # only what the corpus asks for, one row each
    assert got.count() == 3
    assert rows(got.select("num_tables")) == [(0,), (1,), (2,)]
    text_store.ddl_texts(second, store)
    assert len(parsed) == 3
    text_store.ddl_texts(second.limit(0), store)
    assert len(parsed) == 3
    # another style is another text
    basic = text_store.ddl_texts(corpus(spark, NEW), store, "basic")
    assert basic.first().schema == "Schema Graph:\nTable: c(n)" and parsed[3:] == [[NEW]]
    with pytest.raises(ValueError):
        text_store.ddl_texts(second, store, "fancy")


def test_compaction_keeps_every_text_once(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "texts")
    text_store.compact(spark, store)  # nothing there
    df = corpus(spark, ONE, TWO)
    want = rows(text_store.ddl_texts(df, store))
    # a run at the same time did not see them yet
    with monkeypatch.context() as m:
        none = spark.createDataFrame([], "schema_id string, schema string, num_tables int")
        m.setattr(text_store, "stored_texts", lambda *_: none)
        text_store.ddl_texts(df, store)
    assert text_store.stored_texts(spark, store, "structured").count() == 4
    assert rows(text_store.ddl_texts(df, store)) == want
    text_store.compact(spark, store)
    assert rows(text_store.stored_texts(spark, store, "structured")) == want
    # an attempt that broke off is not read
    Path(f"{store}/generation-000002").mkdir()
    assert rows(text_store.ddl_texts(df, store)) == want
    text_store.compact(spark, store)
    assert rows(text_store.stored_texts(spark, store, "structured")) == want
    assert sorted(p.name for p in Path(store).iterdir()) == ["generation-000001", "generation-000002"]


def test_second_preparation_reads_the_store(spark, tmp_path, parsed):
    df = corpus(spark, ONE, TWO, "none", ONE)
    plain = jobs.Options(formats=("lines",))
    kept = jobs.Options(formats=("lines",), text_store=str(tmp_path / "texts"))

    def written(name, options):
        jobs.prepare(str(tmp_path / name), options, ddl_corpus=df)
        return rows(spark.read.text(f"{tmp_path / name}/records/format=lines"))

    want = written("plain", plain)
    assert written("first", kept) == want and len(parsed) == 2
    assert written("second", kept) == want and len(parsed) == 2
