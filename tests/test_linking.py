import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablequill.operators import catalog as C
from tablequill.operators import linking as L
from tablequill.operators import semantic, similarity


@pytest.fixture(scope="module")
def cat(university):
    return C.store(C.catalog_from_records(university))


def ask(spark, *texts):
    return spark.createDataFrame(
        [(i, "university", t) for i, t in enumerate(texts)],
        "example_id long, schema_id string, question string",
    )


def found(links):
    order = ["example_id", "stage", "o1", "o2", "o3"]
    return [
        (r.question_text, r.schema_element, r.confidence, (r.span_start, r.span_end))
        for r in links.orderBy(*order).collect()
    ]


def test_table_links(spark, cat):
    q = ask(spark, "Which STUDENTs take a course?", "how many enroll", "are stud's here")
    assert found(L.table_links(q, cat.tables)) == [
        ("STUDENT", "Student", 1.0, (6, 13)),
        ("course", "Course", 1.0, (22, 28)),
        ("enroll", "Enrollment", 0.8, (9, 15)),
    ]


def test_partial_table_link_per_word(spark, cat):
    q = ask(spark, "roll enro roll")
    assert found(L.table_links(q, cat.tables)) == [
        ("roll", "Enrollment", 0.8, (0, 4)), ("enro", "Enrollment", 0.8, (5, 9)),
        ("roll", "Enrollment", 0.8, (0, 4)),
    ]


def test_column_links(spark, cat):
    q = ask(spark, "What is the Average age by student?")
    # "age" occurs first inside "Average"; the two student_id columns match by a word
    assert found(L.column_links(q, cat.columns)) == [
        ("student", "Student.student_id", 0.7, (27, 34)),
        ("age", "Student.age", 1.0, (16, 19)),
        ("student", "Enrollment.student_id", 0.7, (27, 34)),
    ]


def test_values(spark, cat):
    q = ask(spark, "Is \"John Doe\" or 'x' older than Mary, Which 12 or \"34\"?")
    values = [r.value for r in L.value_candidates(q).orderBy("value_ord").collect()]
    assert values == ["John Doe", "x", "John", "Doe", "Mary"]
    links = found(L.value_links(q, cat.columns))
    assert [(t, e, c) for t, e, c, _ in links] == [
        ("John Doe", "Student.name", 0.8), ("John", "Student.name", 0.8),
        ("Doe", "Student.name", 0.8), ("Mary", "Student.name", 0.8),
    ]
    low = L.value_links(q, cat.columns, threshold=0.5)
    assert low.where("confidence = 0.5").count() == 5 * 3 - 4


def test_accented_letters_are_word_letters(spark, cat):
    q = ask(spark, "Où Étude Cafés Müller Paris")
    assert [r.value for r in L.value_candidates(q).collect()] == ["Paris"]


def vectors(spark, **terms):
    rows = [(t, [float(x) for x in v]) for t, v in terms.items()]
    return spark.createDataFrame(rows, "term string, vector array<float>")


def test_vector_links_only_without_string_links(spark, cat):
    q = ask(spark, "which pupil pupil sits", "pupil in a course")
    tv = vectors(spark, pupil=[1, 0, 0], student=[0.8, 0.6, 0], course=[0, 0, 1], sits=[0.6, 0.8, 0])
    strings = L.table_links(q, cat.tables)
    got = found(L.table_vector_links(q, cat.tables, strings, tv, 0.75))
    assert [(t, e, round(c, 6), s) for t, e, c, s in got] == [
        ("pupil", "Student", 0.8, (6, 11)), ("sits", "Student", 0.96, (18, 22)),
    ]


def test_column_vectors_take_first_variant_and_skip_linked(spark, cat):
    q = ask(spark, "his grades", "name age title course")
    tv = vectors(spark, grades=[1, 0], grade=[0.8, 0.6], student=[0.9, 0.435889], student_id=[0.72, 0.69397])
    strings = L.column_links(q, cat.columns)
    got = found(L.column_vector_links(q, cat.columns, strings, tv, 0.7))
    # student_id: the full name (0.72) comes before its part (0.9)
    assert [(t, e, round(c, 4)) for t, e, c, _ in got] == [
        ("grades", "Student.student_id", 0.72), ("grades", "Enrollment.student_id", 0.72),
        ("grades", "Enrollment.grade", 0.8),
    ]


def test_best_link_per_span_and_text(spark, cat):
    q = ask(spark, "name of Student", "nothing here")
    links = L.schema_links(q, cat.tables, cat.columns, include_values=True)
    text = {r.example_id: r.links_text for r in L.with_links_text(q.select("example_id"), links).collect()}
    # the span of "Student" goes to the table, not to student_id or the value
    assert text == {
        0: '[SCHEMA LINKS]\nQuestion word "Student" → table: Student (confidence: 1.00)\n'
        'Question word "name" → column: Student.name (confidence: 1.00)',
        1: "",
    }


def test_value_line(spark, cat):
    q = ask(spark, "who is Mary")
    links = L.schema_links(q, cat.tables, cat.columns, include_values=True)
    assert L.with_links_text(q.select("example_id"), links).first().links_text == (
        '[SCHEMA LINKS]\nQuestion word "Mary" → column: Student.name (value, confidence: 0.80)'
    )


def test_chunks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(L, "CHUNK_TABLES", 2)
    monkeypatch.setattr(L, "CHUNK_COLUMNS", 3)
    tables = spark.range(7).selectExpr(
        "'university' AS schema_id", "int(id) AS table_ord", "concat('tab', id) AS table_name"
    )
    columns = tables.withColumn("col_ord", F.explode(F.sequence(F.lit(0), F.lit(6)))).withColumn(
        "col_name", F.concat(F.lit("col"), F.col("col_ord"))
    ).withColumn("dtype", F.lit("text"))
    assert L.column_chunks(columns).agg(F.max(F.size("elements"))).first()[0] <= 6
    q = ask(spark, "tab3 tab6 col5")
    assert [e for _, e, _, _ in found(L.table_links(q, tables).where("confidence = 1"))] == [
        "tab3", "tab6",
    ]
    assert L.column_links(q, columns).where("confidence = 1").count() == 7


def _wide(spark):
    names = ["order", "a", "ab", "", None, "Straße", "x_ord", "customer id", "id_no_of_it", "orders_old"]
    rows = [("university", i // 4, f"tab_{n}", i % 4, n) for i, n in enumerate(names * 2)]
    rows += [("other", 0, "order", 0, "id"), ("other", 1, "line", 0, "order")]
    columns = spark.createDataFrame(
        rows, "schema_id string, table_ord int, table_name string, col_ord int, col_name string"
    ).withColumn("dtype", F.lit("text"))
    tables = columns.selectExpr(
        "schema_id", "table_ord * 4 + col_ord AS table_ord", "col_name AS table_name"
    )
    texts = ["Order of the customer", "straßE 7", "", "border id_no_of_it", "x", "old orders, no", "Order of the customer"]
    asked = [(i, "university", t) for i, t in enumerate(texts)] + [(50, "other", "order"), (51, "none", "order"), (52, None, "a")]
    asked.append((53, "university", None))
    return tables, columns, spark.createDataFrame(asked, "example_id long, schema_id string, question string")


def test_wide_schemas_have_the_links_of_narrow_ones(spark, monkeypatch):
    tables, columns, q = _wide(spark)

    def links():
        return [
            sorted(map(tuple, f.collect()), key=str)
            for f in (L.table_links(q, tables), L.column_links(q, columns))
        ]

    want = links()
    assert min(map(len, want)) > 10
    monkeypatch.setattr(L, "WIDE_SCHEMA", 5)
    assert links() == want


def test_wide_schemas_match_candidates_only(spark):
    columns = spark.range(10_000).selectExpr(
        "'university' AS schema_id", "0 AS table_ord", "'t' AS table_name", "int(id) AS col_ord",
        "concat(char(97 + id % 26), char(97 + id div 26 % 26), char(97 + id div 676 % 26), '_value') AS col_name",
        "'text' AS dtype",
    )
    met = L._meet_wide(ask(spark, "what is abc_"), L.column_elements(columns), L._column_keys(), L._column_probes())
    assert 0 < met.agg(F.sum(F.size("elements"))).first()[0] < 100
    assert L.column_links(ask(spark, "what is abc_value"), columns).where("schema_element = 't.abc_value'").count() == 1


@pytest.mark.parametrize("cosine", [True, False])
def test_similar_terms_against_brute_force(spark, monkeypatch, cosine):
    monkeypatch.setattr(similarity, "BLOCK", 3)
    rng = np.random.default_rng(7)
    data = [("g" if i < 33 else "h", f"t{i}", rng.normal(size=5).tolist()) for i in range(40)]
    df = spark.createDataFrame(data, "schema_id string, term string, vector array<double>")
    got = {
        (r.schema_id, r.left_term, r.right_term): r.similarity
        for r in similarity.similar_terms(df, df, ["schema_id"], 0.5, cosine).collect()
    }
    want = {}
    for g, a, x in data:
        for h, b, y in data:
            s = float(np.dot(x, y))
            if cosine:
                s /= float(np.linalg.norm(x) * np.linalg.norm(y))
            if g == h and s >= 0.5:
                want[g, a, b] = s
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def _clusters(spread, n=120, dims=12, centres=6, seed=11):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims)) * 3
    return middle[np.arange(n) % centres] + rng.normal(size=(n, dims)) * spread


def _terms(spark, rows):
    data = [("g", f"t{i}", [float(x) for x in v]) for i, v in enumerate(rows)]
    return spark.createDataFrame(data, "schema_id string, term string, vector array<double>")


@pytest.mark.parametrize("cosine", [True, False])
@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_pruned_blocks_lose_no_pair(spark, monkeypatch, cosine, spread):
    monkeypatch.setattr(similarity, "BLOCK", 10)
    rows = _clusters(spread)
    rows[7] = 0.0  # no direction
    rows[8] *= 1e-3
    rows[9] = rows[21]  # a tie
    left, right = _terms(spark, rows), _terms(spark, rows[:60])
    threshold = 0.8 if cosine else 20.0
    got = {
        (r.left_term, r.right_term)
        for r in similarity.similar_terms(left, right, ["schema_id"], threshold, cosine).collect()
    }
    products = rows @ rows[:60].T
    if cosine:
        norms = np.linalg.norm(rows, axis=1)
        norms[norms == 0] = 1.0
        products = products / norms[:, None] / norms[None, :60]
    want = {(f"t{i}", f"t{j}") for i, j in zip(*np.nonzero(products >= threshold), strict=True)}
    assert got == want and len(want) > 30


def test_far_blocks_take_no_product(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 10)
    df = _terms(spark, _clusters(0.05))
    assert similarity.block_pairs(df, df, ["schema_id"], 0.95, True).count() < 12 * 12 / 2


def test_vectors_without_a_usable_norm_meet_every_block(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 4)
    odd = np.eye(12)[:1] * 1e200
    rows = np.vstack([_clusters(0.1, n=20), odd])
    df = _terms(spark, rows)
    got = {
        (r.left_term, r.right_term)
        for r in similarity.similar_terms(df, df, ["schema_id"], 1.0, False).collect()
    }
    products = rows @ rows.T
    assert got == {(f"t{i}", f"t{j}") for i, j in zip(*np.nonzero(products >= 1.0), strict=True)}


def test_similar_columns_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 4)
    rng = np.random.default_rng(3)
    terms = {f"w{i}": rng.normal(size=3) for i in range(12)}
    tv = vectors(spark, **terms)
    names = ["w0", "w1_w2", "w3_id", "w4_w5_w6", "id", "w7 w8", "W9", "w10_key", "w11_w0", "w2_w3", "w5", "w6_w1"]
    cols = [("s", i // 3, f"t{i // 3}", i % 3, n) for i, n in enumerate(names)]
    columns = spark.createDataFrame(
        cols, "schema_id string, table_ord int, table_name string, col_ord int, col_name string"
    )
    fks = spark.createDataFrame(
        [("s", "t3", "w5", "t1", "w4_w5_w6")],
        "schema_id string, from_table string, from_column string, to_table string, to_column string",
    )
    weak = {"id", "key"}

    def parts(n):
        p = n.replace(" ", "_").lower().split("_")
        return [x for x in p if x and x not in weak] or p

    def sim(a, b):
        if a not in terms or b not in terms:
            return 0.0
        x, y = (np.float32(terms[t]).astype(float) for t in (a, b))
        return float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y)))

    want = {}
    for i, (_, _, t1, _, c1) in enumerate(cols):
        for _, _, t2, _, c2 in cols[i + 1:]:
            if t1 == t2 or {f"{t1}.{c1}", f"{t2}.{c2}"} == {"t3.w5", "t1.w4_w5_w6"}:
                continue
            p, q = parts(c1), parts(c2)
            if len(p) == 1 or len(q) == 1:
                score = max(sim(a, b) for a in p for b in q)
                ok = score >= 0.4
            else:
                ends = sim(p[0], q[0]), sim(p[-1], q[-1])
                score, ok = sum(ends) / 2, min(ends) >= 0.4
            if ok:
                want[f"{t1}.{c1}", f"{t2}.{c2}"] = score
    pairs = semantic.similar_columns(columns, fks, tv, 0.4)
    got = {(r.source, r.target): r.score for r in pairs.collect()}
    assert got.keys() == want.keys() and len(want) > 5
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    top = [(r.source, r.target) for r in semantic.top_links(pairs).orderBy("rank").collect()]
    best = sorted(want, key=lambda k: -want[k])[:5]
    assert top == best


def test_name_parts(spark):
    df = spark.createDataFrame([("Order Key",), ("ID",), ("__",), ("a_id_b",)], "n string")
    got = [r[0] for r in df.select(semantic.name_parts(F.col("n"))).collect()]
    assert got == [["order"], ["id"], ["", "", ""], ["a", "b"]]


def test_threshold_must_be_positive(spark):
    df = vectors(spark, a=[1]).withColumn("schema_id", F.lit("s"))
    with pytest.raises(ValueError):
        similarity.similar_terms(df, df, ["schema_id"], 0.0, True)


def test_python_workers_do_not_need_the_package(tmp_path):
    """The matrix product runs in workers whose path lacks this repository."""
    repo = str(Path(__file__).resolve().parent.parent)
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import functions as F
from tablequill.operators.similarity import similar_terms
from tablequill.session import local_session
spark = local_session("2")
df = spark.createDataFrame([("s", "a", [1.0, 0.0]), ("s", "b", [0.6, 0.8])], "g string, term string, vector array<double>")
print("pairs", similar_terms(df, df, ["g"], 0.5, True).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180
    )
    assert "pairs 4" in done.stdout, done.stderr[-2000:]


def _wide_schema(spark, seed=3, columns=60):
    """Columns with few different name parts: nearly all pairs are similar."""
    import random

    r = random.Random(seed)
    parts = [f"p{i}" for i in range(8)] + ["id", "code"]
    rows, fks = [], []
    for schema in ("a", "b", "c"):
        for i in range(columns if schema != "c" else 2):
            name = "_".join(r.choice(parts) for _ in range(r.choice((1, 1, 2, 3))))
            rows.append((schema, i % 7, f"t{i % 7}", i // 7, name))
        fks += [(schema, k, *r.choice([x[2:5:2] for x in rows if x[0] == schema]),
                 *r.choice([x[2:5:2] for x in rows if x[0] == schema])) for k in range(12)]
    angle = [(p, [1.0, 0.05 * i, 0.3 * (i % 3)]) for i, p in enumerate(parts[:-1])]
    frame = spark.createDataFrame(rows, "schema_id string, table_ord int, table_name string, col_ord int, col_name string")
    keys = spark.createDataFrame(
        fks, "schema_id string, fk_ord int, from_table string, from_column string, to_table string, to_column string"
    )
    return frame, keys, spark.createDataFrame(angle, "term string, vector array<double>")


@pytest.mark.parametrize("n,threshold", [(5, 0.7), (1, 0.97), (40, 0.9)])
def test_best_links_equal_ranked_pairs(spark, n, threshold):
    from tablequill.operators import semantic

    columns, fks, vectors = _wide_schema(spark)
    pairs = semantic.similar_columns(columns, fks, vectors, threshold).withColumn("score", F.round("score", 6))
    names = ["schema_id", "source", "target", "score", "rank"]
    wanted = sorted(map(tuple, semantic.top_links(pairs, n).select(*names).collect()))
    found = sorted(map(tuple, semantic.best_links(columns, fks, vectors, threshold, n).select(*names).collect()))
    assert found == wanted and len(found) >= n


def test_best_links_open_few_pairs(spark):
    """Ten thousand columns of one name: five pairs are taken, fifty million are never made."""
    import pyarrow as pa

    from tablequill.operators import semantic

    n = 10_000
    columns = pa.table({
        "schema_id": ["s"] * n, "table_name": [f"t{i}" for i in range(n)],
        "full_name": [f"t{i}.name" for i in range(n)], "parts": [["name"]] * n,
        "table_ord": list(range(n)), "col_ord": [0] * n,
    })
    links = pa.table({"left": ["name", "t0.name"], "right": ["name", "t1.name"], "similarity": [1.0, None]})
    found = semantic._best_first(5, 6)(columns, links).to_pylist()
    assert [(r["source"], r["target"]) for r in found] == [("t0.name", f"t{i}.name") for i in range(2, 7)]
