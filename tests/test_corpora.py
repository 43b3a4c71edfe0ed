from collections import Counter
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tablequill import constants as K
from tablequill.functions import scale
from tablequill.operators import catalog as C
from tablequill.operators import corpora, logical_form, prompts, sequences
from tablequill.sources import readers, writers

CONDS = "array<struct<col:int,op:int,value:string,is_str:boolean>>"


def logical(spark, rows):
    return spark.createDataFrame(rows, f"example_id long, sel int, agg int, conds {CONDS}")


def test_render(spark):
    header = F.array(F.lit("Player"), F.lit("No."))
    df = logical(
        spark,
        [
            (1, 0, 0, []),
            (2, 1, 3, [(0, 0, "O'Neal", True)]),
            (3, 5, 5, [(1, 9, "2.5", False), (7, 3, "x", True)]),
        ],
    )
    sql = logical_form.render_sql(header, F.col("sel"), F.col("agg"), F.col("conds"))
    assert [r[0] for r in df.orderBy("example_id").select(sql).collect()] == [
        'SELECT "Player" FROM "table"',
        'SELECT COUNT("No.") FROM "table" WHERE "Player" = \'O\'Neal\'',
        'SELECT AVG("?") FROM "table" WHERE "No." = 2.5 AND "?" >= \'x\'',
    ]


def test_unknown_aggregate(spark):
    df = logical(spark, [(1, 0, 6, [])])
    assert logical_form.with_pattern(df).first().pattern == "select_only"
    with pytest.raises(PySparkException):
        df.select(
            logical_form.render_sql(F.array(F.lit("a")), F.col("sel"), F.col("agg"), F.col("conds"))
        ).collect()


def test_patterns(spark):
    one = [(0, 0, "x", True)]
    df = logical(spark, [(i, 0, i, one) for i in range(6)] + [(6, 0, None, [])])
    got = [r.pattern for r in logical_form.with_pattern(df).orderBy("example_id").collect()]
    assert got == ["where_only", "max", "min", "count", "sum", "avg", "select_only"]


def test_quotas_count_places_of_empty_patterns(spark):
    """10 over 4 patterns: 2 each, the rest of 2 goes to places 0 and 1 only."""
    sizes = spark.createDataFrame(
        [("select_only", 100), ("count", 100), ("max", 1), ("min", 100)],
        "pattern string, available long",
    )
    got = {r.pattern: r.quota for r in logical_form.quotas(sizes, 10).collect()}
    assert got == {"select_only": 3, "count": 2, "max": 1, "min": 2}


def test_balanced_sample_is_a_prefix_in_hash_order(spark):
    df = spark.range(3000).selectExpr(
        "id AS example_id", "0 AS sel", "int(if(id % 10 = 0, 3, 0)) AS agg", f"cast(array() AS {CONDS}) AS conds"
    )
    got = logical_form.balanced_sample(df, 401, seed=5).select("example_id", "pattern").collect()
    rows = df.select(
        "example_id", "agg", scale.hash_order(5, F.col("example_id")).alias("h")
    ).orderBy("h").collect()
    plain = [r.example_id for r in rows if r.agg == 0][:201]
    count = [r.example_id for r in rows if r.agg == 3][:200]
    assert sorted(r.example_id for r in got if r.pattern == "select_only") == sorted(plain)
    assert sorted(r.example_id for r in got if r.pattern == "count") == sorted(count)
    assert logical_form.dev_quota(5000) == 1000 and logical_form.dev_quota(99) == 19


def instructions(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "example_id long, instruction string")
    got = corpora.split_instruction(df).orderBy("example_id").collect()
    return [(r.ddl, r.question) for r in got]


def test_split_instruction(spark):
    t = "CREATE TABLE a (x INT)"
    assert instructions(
        spark,
        t,
        "no table",
        f"{t}\n\nHow many?",
        f"{t}\n\n \n\ncreate table b (y INT)\n\n-- How many?\n\n{t}",
        f"{t}\n\n",
        f"How many?\n\n{t}",
    ) == [
        (t, "Generate SQL query"),
        ("no table", "Generate SQL query"),
        (t, "How many?"),
        (f"{t}\n\n \n\ncreate table b (y INT)", f"How many?\n\n{t}"),
        (f"{t}\n\n", "Generate SQL query"),
        ("", f"How many?\n\n{t}"),
    ]


def test_positional_split_cuts_each_dataset(spark, monkeypatch):
    monkeypatch.setattr(scale, "BUCKET_WIDTH", 8)
    df = spark.range(101).selectExpr("id * 5 AS k", "if(id < 91, 'big', 'small') AS dataset")
    split = corpora.positional_split(df, ["dataset"], "k")
    counts = {(r.dataset, r.split): r["count"] for r in split.groupBy("dataset", "split").count().collect()}
    assert counts == {("big", "train"): 81, ("big", "dev"): 10, ("small", "train"): 9, ("small", "dev"): 1}
    dev = split.where("split = 'dev' AND dataset = 'big'").agg(F.min("k")).first()[0]
    assert dev == 81 * 5


def corpus(spark, *ddls):
    rows = [
        (i, d, "train", f"q{i}", "select 1 Join 2", None, None, ddl) for i, (d, ddl) in enumerate(ddls)
    ]
    return spark.createDataFrame(
        rows,
        "example_id long, dataset string, split string, question string, sql string,"
        " complexity string, source string, ddl string",
    )


def test_examples_from_ddl(spark):
    two = "CREATE TABLE a (id INT); CREATE TABLE b (a_id INT);"
    df = corpus(spark, ("x", two), ("x", "none"), ("instruction", "none"), ("instruction", two))
    got = {r.example_id: r for r in corpora.from_ddl(df, "basic", ["instruction"]).collect()}
    assert sorted(got) == [0, 1, 3]
    assert got[0].schema == "Schema Graph:\nTable: a(id)\nTable: b(a_id)\nForeign Key: b.a_id -> a.id"
    assert (got[0].num_tables, got[0].has_join) == (2, True)
    assert (got[1].schema, got[1].num_tables) == ("Schema Graph:", 0)
    assert got[0].schema_id == got[3].schema_id


@pytest.mark.parametrize("style", list(corpora.EMPTY_SCHEMA))
def test_empty_schema_texts(spark, style):
    got = corpora.from_ddl(corpus(spark, ("x", "none")), style, []).first().schema
    # what a schema with one table starts with
    one = corpora.from_ddl(corpus(spark, ("x", "CREATE TABLE t (a INT)")), style, []).first().schema
    assert one.startswith(got)


def test_examples_from_catalog_skip_unknown(spark, university):
    cat = C.catalog_from_records(university)
    rows = [(1, "university"), (2, "nowhere")]
    df = spark.createDataFrame(rows, "example_id long, schema_id string").selectExpr(
        "*", "'c' AS dataset", "'dev' AS split", "'q' AS question", "'SELECT 1' AS sql"
    )
    got = corpora.from_catalog(df, cat).collect()
    assert [(r.example_id, r.num_tables, r.has_join) for r in got] == [(1, 3, False)]
    assert got[0].schema.startswith("[DATABASE]\nuniversity\n\n[TABLES]\n")
    assert [r.example_id for r in corpora.without_catalog(df, cat).collect()] == [2]


def test_examples_from_logical_form(spark):
    tables = spark.createDataFrame(
        [("t1", "A b", ["x", "y"], ["text", "real"])],
        "id string, page_title string, header array<string>, types array<string>",
    )
    queries = spark.createDataFrame(
        [(1, "w", "train", "t1", "q", 1, 0, []), (2, "w", "train", "t9", "q", 0, 0, [])],
        f"example_id long, dataset string, split string, table_id string, question string,"
        f" sel int, agg int, conds {CONDS}",
    )
    got = corpora.from_logical_form(queries, tables).collect()
    assert [(r.example_id, r.sql, r.schema) for r in got] == [
        (1, 'SELECT "y" FROM "table"', "[TABLES]\nA_b:\n    x (PK)\n    y")
    ]


def test_summary_counts_missing_values_as_plain(spark):
    df = spark.createDataFrame(
        [("a", "train", 2, True), ("a", "train", None, None), ("b", "train", 1, False), ("a", "dev", 5, True)],
        "dataset string, split string, num_tables int, has_join boolean",
    )
    got = {r.dataset: tuple(r)[1:] for r in corpora.summary(df).collect()}
    assert got == {"a": (2, 1, 1, 50.0, 50.0), "b": (1, 0, 0, 0.0, 0.0), None: (3, 1, 1, 100 / 3, 100 / 3)}


# --- prompts ------------------------------------------------------------------------


def example(spark, **values):
    cols = {"example_id": 1, "schema": "S", "question": "Q", "sql": "SELECT 1", **values}
    return spark.createDataFrame([tuple(cols.values())], list(cols))


def test_user_prompt(spark):
    df = example(spark, links="[SCHEMA LINKS]\nx", none="")

    def text(**extra):
        return df.select(
            prompts.user_prompt(F.lit("I"), F.col("schema"), F.col("question"), **extra)
        ).first()[0]

    assert text() == "I\n[SCHEMA]\nS\n\n[QUESTION]\nQ"
    assert text(schema_links=F.col("none")) == text()
    assert text(schema_links=F.col("links")) == "I\n[SCHEMA]\nS\n\n[SCHEMA LINKS]\nx\n\n[QUESTION]\nQ"
    assert text(few_shot=F.lit("\n\nE\n\n")) == "I\n\n\nE\n\n\n[SCHEMA]\nS\n\n[QUESTION]\nQ"


def test_few_shot_block(spark):
    df = spark.createDataFrame(
        [("g", i, f"S{i}", f"Q{i}", f"A{i}") for i in (3, 1, 2)],
        "dataset string, k long, schema string, question string, sql string",
    )
    assert prompts.few_shot_blocks(df, "dataset", "k").first().few_shot == (
        "\n\n[EXAMPLES]\n\n"
        "Example 1:\n[SCHEMA]\nS1\n\n[QUESTION]\nQ1\n\n[SQL]\nA1\n\n"
        "Example 2:\n[SCHEMA]\nS2\n\n[QUESTION]\nQ2\n\n[SQL]\nA2\n\n"
        "[END EXAMPLES]\n\n"
    )


def test_simple_and_legacy_records(spark):
    df = example(spark, links_text="L")
    simple = prompts.simple_record(df).first()
    assert simple.input == f"{K.INSTRUCTION}\n\nS\n\nL\n\n[QUESTION]\nQ"
    assert simple.output == "[SQL]\nSELECT 1"
    legacy = prompts.legacy_record(df, include_instruction=False).first()
    assert (legacy.input, legacy.output) == ("S\n\nQuestion: Q", "SELECT 1")
    empty = prompts.simple_record(example(spark, sql="")).first()
    assert empty.output is None and empty.sql is None


def test_chat_markup_and_extraction(spark):
    df = spark.createDataFrame([("U", "[SQL]\nSELECT 1")], "u string, a string")
    text = df.select(prompts.chat_markup(F.col("u"), F.col("a")).alias("t"))
    assert text.first().t == (
        f"<|im_start|>system\n{K.CHATML_SYSTEM}<|im_end|>\n<|im_start|>user\nU<|im_end|>\n"
        "<|im_start|>assistant\nSELECT 1<|im_end|>"
    )
    got = text.select(prompts.extract_sql(F.col("t"), after_assistant=True)).first()[0]
    assert got == "SELECT 1<|im_end|>"
    marked = spark.createDataFrame([("a[SQL]b<|im_end|>[SQL]\n c\t<|im_end|>d",)], "t string")
    assert marked.select(prompts.extract_sql(F.col("t"))).first()[0] == "c"


def test_styles(spark):
    df = spark.createDataFrame([("simple",), ("expert",)], "style string")
    table = prompts.style_table(spark)
    got = {r.style: r.instruction for r in prompts.with_style(df, table).collect()}
    assert got["simple"] == K.INSTRUCTION and got["expert"].startswith(K.INSTRUCTION + "\n")
    bare = prompts.with_style(df, table, include_guidelines=False).collect()
    assert {r.instruction for r in bare} == {K.INSTRUCTION}


def test_sequences(spark, monkeypatch):
    texts = spark.createDataFrame(
        [(1, "b a\u00a0a c"), (2, " a b\n"), (3, "")], "example_id long, text string"
    )
    vocab = sequences.vocabulary(texts)
    assert [tuple(r) for r in vocab.orderBy("word_id").collect()] == [
        ("a", 3, 1), ("b", 2, 2), ("c", 1, 3),
    ]
    for hot in (10_000, 1):  # all words frequent, only the first one
        monkeypatch.setattr(sequences, "HOT_WORDS", hot)
        got = {r.example_id: r for r in sequences.encode(texts, vocab, 3).collect()}
        assert got[1].input_ids == [2, 1, 1] and got[1].attention_mask == [1, 1, 1]
        assert got[2].input_ids == [1, 2, 0] and got[2].attention_mask == [1, 1, 0]
        assert got[3].input_ids == [0, 0, 0] and got[3].labels == [0, 0, 0]


def test_sequences_of_rare_and_unknown_words(spark, monkeypatch):
    known = spark.createDataFrame([(1, "b a b é d d d")], "example_id long, text string")
    vocab = sequences.vocabulary(known)
    ids = {r.word: r.word_id for r in vocab.collect()}
    texts = spark.createDataFrame(
        [(1, "d zz b é zz"), (None, "é d"), (3, None), (4, "d d"), (5, "zz a"), (6, "a " * 9)],
        "example_id long, text string",
    )
    new = len(ids) + 1
    want = {
        None: [ids["é"], ids["d"], 0, 0],
        1: [ids["d"], new, ids["b"], ids["é"]],
        3: [0, 0, 0, 0],
        4: [ids["d"], ids["d"], 0, 0],
        5: [new, ids["a"], 0, 0],
        6: [ids["a"]] * 4,
    }
    for hot in (10_000, 2, 0):
        monkeypatch.setattr(sequences, "HOT_WORDS", hot)
        rows = sequences.encode(texts, vocab, 4).collect()
        assert {r.example_id: r.input_ids for r in rows} == want and len(rows) == len(want)


def test_sequences_split_where_the_vocabulary_does(spark):
    """Every white space character ends a word in both; no text is taken apart into rows of tokens."""
    from tablequill.functions.text import WHITE

    text = "".join(f"w{i}{c}" for i, c in enumerate(WHITE)) + "last\u200b\ufeff rest"
    texts = spark.createDataFrame([(1, text), (1, "last w0")], "example_id long, text string")
    vocab = sequences.vocabulary(texts)
    assert vocab.count() == len(WHITE) + 3
    ids = {r.word: r.word_id for r in vocab.collect()}
    coded = sequences.encode(texts, vocab, 40)
    got = sorted(r.input_ids for r in coded.collect())
    want = [[ids[w] for w in t.split()] for t in (text, "last w0")]
    assert got == sorted(w + [0] * (40 - len(w)) for w in want)
    # the shuffles hold a row per text and per word that is not frequent
    plan = coded._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode(rare") == 1 and plan.count("Generate") == 1


# --- files ------------------------------------------------------------------------------


def test_logical_form_lines(spark, tmp_path):
    path = tmp_path / "lines.jsonl"
    path.write_text(
        '{"phase":1,"table_id":"t","question":"q","sql":{"sel":3,"conds":[[2,0,"x"],[1,1,2.50],[0,2,7]],"agg":0}}\n'
        "\n"
        '{"phase":1,"table_id":"t","question":"é","sql":{"sel":1,"conds":[]}}\n',
        encoding="utf-8",
    )
    got = readers.read_logical_form(spark, str(path)).orderBy("sel").collect()
    assert [(r.sel, r.agg, r.question) for r in got] == [(1, 0, "é"), (3, 0, "q")]
    assert got[0].conds == []
    assert [tuple(c) for c in got[1].conds] == [
        (2, 0, "x", True), (1, 1, "2.5", False), (0, 2, "7", False),
    ]


def test_record_array_file(spark, tmp_path):
    (tmp_path / "tables.json").write_text(
        '[{"db_id":"d","table_names_original":["t"],"column_names_original":[[-1,"*"],[0,"a"]],'
        '"column_types":["text"],"primary_keys":[1],"foreign_keys":[[1,0]]}]'
    )
    records = readers.read_array(
        spark, str(tmp_path / "tables.json"), readers.CATALOG_RECORD_SCHEMA
    )
    cat = C.catalog_from_records(records)
    assert [tuple(r) for r in cat.columns.select("col_name", "dtype", "is_pk", "is_fk").collect()] == [
        ("a", "text", True, False)
    ]
    assert cat.fks.count() == 0
    assert readers.split_path("d", "train", "a.json", "b.json") == "d/a.json"
    assert readers.split_path("d", "test", "a.json", "b.json") == "d/b.json"


def test_written_lines_leave_out_absent_keys(spark, tmp_path):
    df = spark.createDataFrame(
        [("S", "é?", None, "[SQL]\nX"), ("S", "q", "Y", None)],
        "schema string, question string, sql string, output string",
    )
    writers.write_lines(df.coalesce(1), str(tmp_path / "l"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "l")).collect()]
    assert lines == [
        '{"schema":"S","question":"é?","output":"[SQL]\\nX"}',
        '{"schema":"S","question":"q","sql":"Y"}',
    ]
    records = writers.instruction_records(df).collect()
    assert [(r.input, r.output) for r in records] == [
        ("S\n\nQuestion: é?", "[SQL]\nX"), ("S\n\nQuestion: q", "Y"),
    ]
    chat = writers.chat_records(df).first().messages
    assert [m.role for m in chat] == ["system", "user", "assistant"]


def test_last_and_first_per_key(spark):
    df = spark.createDataFrame(
        [("k", 1, "train", "a"), ("k", 2, "train", "b"), ("k", 0, "validation", "c"), ("m", 9, "validation", "d")],
        "db_id string, ord int, split string, v string",
    )
    assert sorted(tuple(r) for r in readers.last_by_key(df, "db_id", "ord").select("db_id", "v").collect()) == [
        ("k", "b"), ("m", "d"),
    ]
    assert sorted(tuple(r) for r in readers.first_schema_per_db(df, ["v"], "ord").collect()) == [
        ("k", "a"), ("m", "d"),
    ]


def test_ordinal_over_files(spark, tmp_path):
    for i, n in enumerate((3, 0, 4)):
        spark.range(i * 10, i * 10 + n).coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
    df = spark.read.parquet(*[str(tmp_path / f"p{i}") for i in range(3)])
    got = [(r.id, r.ord) for r in readers.with_ordinal(df).orderBy("ord").collect()]
    assert got == [(0, 0), (1, 1), (2, 2), (20, 3), (21, 4), (22, 5), (23, 6)]


def test_file_counts_of_a_folder_of_parts(spark, tmp_path):
    """A table in many part files is one file of its name, and so is one without rows."""
    from tablequill.plans.queries import QUERIES

    spark.range(10).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(0).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.file_name: r.rows for r in QUERIES["src_file_counts"](spark, str(tmp_path)).collect()}
    assert got == {"documents.parquet": 10, "conversations.parquet": 0}
    parts = readers.file_counts(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    counts = [r.rows for r in parts.collect()]
    assert len(counts) > 1 and sum(counts) == 10


def test_ordinal_of_lines_over_files_in_blocks(spark, tmp_path):
    for i, n in enumerate((700, 5, 300)):
        text = "".join(f'{{"id": {1000 * i + k}, "pad": "{"x" * (k % 7)}"}}\n\n' for k in range(n))
        (tmp_path / f"f{i}.json").write_text(text)
    want = [1000 * i + k for i, n in enumerate((700, 5, 300)) for k in range(n)]
    conf = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(conf, 2000)
    try:
        rows = readers.read_lines(spark, str(tmp_path), "id long")
        assert rows.rdd.getNumPartitions() > 8
        got = readers.with_line_ordinal(rows).orderBy("ord").collect()
    finally:
        spark.conf.unset(conf)
    assert [(r.id, r.ord) for r in got] == list(zip(want, range(len(want))))


def test_ordinal_of_array_records(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}.json").write_text("[" + ",".join(f'{{"id": {10 * i + k}}}' for k in range(4)) + "]")
    rows = readers.read_array(spark, str(tmp_path), "id long")
    got = [(r.id, r.ord) for r in readers.with_line_ordinal(rows).orderBy("ord").collect()]
    assert got == [(10 * i + k, 4 * i + k) for i in range(3) for k in range(4)]


def test_corpus_is_written_in_hash_order(spark, tmp_path):
    df = spark.range(50).selectExpr(
        "id AS example_id", "'S' AS schema", "concat('q', id) AS question", "'X' AS sql",
        "if(id < 40, 'a', 'b') AS dataset", "if(id % 5 = 0, 'dev', 'train') AS split",
    )
    writers.write_corpus(df, str(tmp_path), ("lines", "chat"), seed=1)

    def back(split):
        rows = readers.read_lines(
            spark, f"{tmp_path}/records/format=lines/split={split}", "example_id long, dataset string")
        return readers.with_line_ordinal(rows).orderBy("ord").collect()

    train = [r.example_id for r in back("train")]
    ordered = writers.in_shuffled_order(df.where("split = 'train'"), seed=1)
    want = [r[0] for r in df.where("split = 'train'").orderBy(
        scale.hash_order(1, F.col("example_id"))).select("example_id").collect()]
    assert [r.example_id for r in ordered.collect()] == train == want != sorted(want)
    dev = back("dev")
    assert [(r.example_id, r.dataset) for r in dev] == [(i, "a" if i < 40 else "b") for i in range(0, 50, 5)]
    assert [r.ord for r in dev] == list(range(10))
    chat = readers.read_lines(spark, f"{tmp_path}/records/format=chat", "messages array<struct<role:string>>")
    assert chat.where("size(messages) = 3").count() == 50
    assert spark.read.parquet(f"{tmp_path}/datasets").groupBy("dataset", "split").count().count() == 4


def test_records_are_packed_and_their_lines_not_sorted(spark, tmp_path):
    """The same lines in the same order as plain files hold, in far fewer bytes; no setting stays."""
    df = spark.range(2000).selectExpr(
        "id AS example_id", "repeat('CREATE TABLE a (b INT); ', 20) AS schema", "concat('q', id) AS question",
        "'X' AS sql", "'a' AS dataset", "if(id % 5 = 0, 'dev', 'train') AS split",
    ).repartition(4)
    formats = ("lines", "instruction", "chat")
    before = spark.conf.get(writers.OPEN_FILES, None)
    writers.write_corpus(df, f"{tmp_path}/packed", formats)
    writers.write_corpus(df, f"{tmp_path}/plain", formats, compression="none")
    assert spark.conf.get(writers.OPEN_FILES, None) == before

    def size(name):
        return sum(f.stat().st_size for f in (tmp_path / name / "records").rglob("part-*"))

    def lines(name, folder):
        rows = spark.read.text(f"{tmp_path}/{name}/records/{folder}")
        return [r.value for r in readers.with_line_ordinal(rows).orderBy("ord").collect()]

    assert size("packed") * 5 < size("plain")
    for folder, n in (("format=lines/split=train", 1600), ("format=chat/split=dev", 400)):
        packed = lines("packed", folder)
        assert len(packed) == n and packed == lines("plain", folder)


def _shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f.name for d in dirs for f in Path(d).rglob("shuffle_*")}


def test_corpus_of_several_rounds_is_in_one_order(spark, tmp_path, monkeypatch):
    """The order over all files, NULL and repeated ids, and columns that are NULL stay as in one round."""
    df = spark.range(600).selectExpr(
        "if(id % 50 = 7, NULL, id div 2) AS example_id", "repeat('CREATE TABLE a (b INT); ', 3) AS schema",
        "concat('q', id) AS question", "if(id % 9 = 0, NULL, 'X') AS sql", "if(id < 400, 'a', NULL) AS dataset",
        "if(id % 5 = 0, 'dev', 'train') AS split",
    ).repartition(4)
    writers.write_corpus(df, f"{tmp_path}/one", seed=3)
    monkeypatch.setattr(writers, "ROUND_BYTES", 0)
    writers.write_corpus(df, f"{tmp_path}/several", seed=3)

    def lines(name, split):
        path = f"{tmp_path}/{name}/records/format=lines/split={split}"
        rows = readers.read_lines(spark, path, "example_id long, dataset string, question string")
        return [(r.example_id, r.dataset, r.question) for r in readers.with_line_ordinal(rows).orderBy("ord").collect()]

    for split in ("train", "dev"):
        one, several = lines("one", split), lines("several", split)
        # rows with the same id come in any order
        assert [r[:2] for r in one] == [r[:2] for r in several] and Counter(one) == Counter(several)
    assert len(lines("several", "train")) == 480 and len({r[0] for r in lines("several", "train")}) > 200
    for name in writers.FORMATS:
        assert spark.read.text(f"{tmp_path}/several/records/format={name}").count() == 600
    parts = list((tmp_path / "several/records/format=lines/split=train").glob("part-*"))
    assert len({p.name.split("-", 2)[2] for p in parts}) == writers.ROUNDS


def test_preparation_leaves_no_shuffle_files(spark, tmp_path):
    """What was shuffled does not stay beside the records; zstd files are well below those of gzip."""
    from tablequill import session
    from tablequill.plans import jobs

    ddl = "CREATE TABLE orders (id INT, city TEXT); CREATE TABLE stores (id INT, town TEXT);"
    corpus = spark.range(3000).selectExpr(
        # sentences that come again further away than gzip looks back
        "id AS example_id", "'x' AS dataset", "concat_ws(' ', transform(sequence(1, 8),"
        " i -> md5(cast(pmod(xxhash64(id, i), 2000) AS string)))) AS question", "'SELECT 1' AS sql",
        "'a' AS complexity", "CAST(NULL AS string) AS source", f"'{ddl}' AS ddl",
    ).repartition(6)
    before, setting = _shuffle_files(spark), spark.conf.get(session.DROP_SHUFFLES)
    jobs.prepare(f"{tmp_path}/zstd", ddl_corpus=corpus)
    assert _shuffle_files(spark) <= before
    assert spark.conf.get(session.DROP_SHUFFLES) == setting
    writers.write_corpus(spark.read.parquet(f"{tmp_path}/zstd/datasets"), f"{tmp_path}/gzip", compression="gzip")

    def size(name):
        return sum(f.stat().st_size for f in (tmp_path / name / "records").rglob("part-*"))

    assert size("zstd") < 0.8 * size("gzip")


def test_jobs(spark, university):
    from tablequill.plans import jobs

    cat = C.store(C.catalog_from_records(university))
    df = spark.createDataFrame([(1, "university", "name of Student")], "example_id long, schema_id string, question string")
    examples = corpora.from_catalog(
        df.selectExpr("*", "'c' AS dataset", "'train' AS split", "'SELECT 1' AS sql"), cat
    )
    plain = jobs.training_records(examples, "simple").first()
    assert plain.input.endswith("grade\n\n[FOREIGN KEYS]\nEnrollment.student_id -> Student.student_id\n"
                                "Enrollment.course_id -> Course.course_id\n\n[QUESTION]\nname of Student")
    linked = jobs.training_records(examples, "expert", link_catalog=cat).first()
    assert '\n\n[SCHEMA LINKS]\nQuestion word "Student" → table: Student (confidence: 1.00)\n' in linked.input
    preds = spark.createDataFrame(
        [(1, "d", "SELECT a FROM t", "select A from T", 1, False, True, True, False)],
        "example_id long, db_id string, gold_sql string, pred_sql string, num_tables int,"
        " has_join boolean, gold_ran boolean, pred_ran boolean, same_result boolean",
    )
    report = jobs.evaluation_report(preds, preds.select("db_id"))
    assert report["overall"].first().em_accuracy == 100.0
    assert report["by_complexity"].first().complexity == K.COMPLEXITY_LABELS[0]


def test_prepare_with_every_option(spark, tmp_path):
    """Complexities before the split, first rows after it, links in texts and prompts, no table left behind."""
    from tablequill.plans import jobs
    from tablequill.session import scratch_dir

    ddl = "CREATE TABLE orders (id INT, city TEXT); CREATE TABLE stores (id INT, town TEXT);"
    rows = [(i, "x", f"which city {i}", "SELECT 1", "a" if i % 2 else "b", None, ddl) for i in range(40)]
    corpus = spark.createDataFrame(
        rows, "example_id long, dataset string, question string, sql string, complexity string,"
        " source string, ddl string")
    vectors = spark.createDataFrame(
        [("city", [1.0, 0.1]), ("town", [1.0, 0.0]), ("orders", [0.0, 1.0])], "term string, vector array<double>")
    before = set(Path(scratch_dir(spark)).iterdir())
    options = jobs.Options(complexities=["a"], first_n=5, semantic_links=True, schema_links=True)
    summary = jobs.prepare(str(tmp_path), options, ddl_corpus=corpus, term_vectors=vectors).collect()
    assert set(Path(scratch_dir(spark)).iterdir()) == before
    assert {r.dataset: (r.examples, r.multi_table) for r in summary} == {"x": (5, 5), None: (5, 5)}
    back = spark.read.json(f"{tmp_path}/records/format=lines")
    got = {(r.example_id, r.split) for r in back.collect()}
    # 20 rows are of the complexity: 18 for training, of which five, and two others
    assert got == {(i, "train") for i in (1, 3, 5, 7, 9)} | {(i, "dev") for i in (37, 39)}
    one = back.where("example_id = 1").first()
    assert "[SEMANTIC LINKS]\norders.city ≈ stores.town" in one.schema
    assert 'Question word "city" → column: orders.city (confidence: 1.00)' in one.input


def test_prepare_samples_logical_forms(spark, tmp_path):
    from tablequill.plans import jobs

    tables = spark.createDataFrame(
        [("t1", "A b", ["x", "y"], ["text", "real"])],
        "id string, page_title string, header array<string>, types array<string>",
    )
    rows = [(i, "w", "dev" if i >= 80 else "train", "t1", "q", 1, i % 2, []) for i in range(120)]
    queries = spark.createDataFrame(
        rows, f"example_id long, dataset string, split string, table_id string, question string,"
        f" sel int, agg int, conds {CONDS}")
    jobs.prepare(str(tmp_path), jobs.Options(quota=20, formats=("chat",)), logical=queries, single_tables=tables)
    counts = spark.read.parquet(f"{tmp_path}/datasets").groupBy("split", F.col("sql").contains("MAX")).count()
    assert sorted(tuple(r) for r in counts.collect()) == [
        ("dev", False, 2), ("dev", True, 2), ("train", False, 10), ("train", True, 10)]
