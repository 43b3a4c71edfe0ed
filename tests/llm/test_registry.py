"""The registered queries: names, columns and, where there is SQL, equal rows in DuckDB."""

import pytest

import __spark_entry__ as entry
import oracle_check
from tablequill.llm import queries

SF_DIR = "/root/testdata/sf0.001"

COLUMNS = {
    "op2_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op3_token_records": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op5_subspace_join": ["vec_id", "n_links", "component_id", "kept"],
    "op6_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op7_jump_shards": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op8_rule_ledger": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        "base_failed", "kept"],
    "op9_best_two_fit": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op10_gam_quality": ["doc_id", "held_out", "score", "predicted"],
    "op12_bloom_lines": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
}


def test_all_are_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(queries.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_rows_equal_sql(spark, name):
    df = entry.queries()[name](spark, SF_DIR)
    rows, problems = oracle_check.compare(df, oracle_check.connect(SF_DIR), entry.oracle_sql()[name])
    assert problems == [] and rows > 0


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_and_rows(spark, name):
    df = entry.queries()[name](spark, SF_DIR)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    table = "embeddings" if name.startswith("op5") else "documents"
    ids = spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()
    assert df.select(df.columns[0]).distinct().count() == ids
