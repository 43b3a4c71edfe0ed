import pytest
from pyspark.sql import functions as F

from tablequill.operators import catalog as C


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_university_graph(university):
    cat = C.catalog_from_records(university)
    assert rows(cat.tables, "table_ord", "table_name") == [
        (0, "Student"), (1, "Course"), (2, "Enrollment"),
    ]
    assert cat.columns.count() == 10
    assert rows(C.primary_keys(cat.columns), "table_name", "col_name") == [
        ("Course", "course_id"), ("Enrollment", "enrollment_id"), ("Student", "student_id"),
    ]
    assert rows(C.foreign_keys(cat.columns), "col_name", "fk_table", "fk_column") == [
        ("course_id", "Course", "course_id"), ("student_id", "Student", "student_id"),
    ]
    edges = C.edges(cat)
    kinds = {r.edge_type: r["count"] for r in edges.groupBy("edge_type").count().collect()}
    assert kinds == {"table_column": 10, "foreign_key": 2, "table_table": 2}
    assert rows(C.summary(cat), "schema_id", "n_tables", "n_edges") == [("university", 3, 14)]


def ddl(spark, *texts):
    return spark.createDataFrame(
        [(f"s{i}", t) for i, t in enumerate(texts)], "schema_id string, ddl string"
    )


def test_ddl_snippet(spark):
    text = (
        "CREATE TABLE department (creation VARCHAR, department_id VARCHAR); "
        "CREATE TABLE management (department_id VARCHAR, head_id VARCHAR);"
    )
    cat = C.catalog_from_ddl(ddl(spark, text))
    assert rows(cat.columns, "table_name", "col_name", "dtype", "is_pk") == [
        ("department", "creation", "text", False),
        ("department", "department_id", "text", False),
        ("management", "department_id", "text", False),
        ("management", "head_id", "text", False),
    ]
    # a table never refers to itself, and there is no table "head"
    assert rows(cat.fks, "from_table", "from_column", "to_table", "to_column") == [
        ("management", "department_id", "department", "department_id")
    ]


def test_ddl_ends_at_first_parenthesis(spark):
    text = "create table t (a INT, b DECIMAL(10,2), c TEXT)"
    cat = C.catalog_from_ddl(ddl(spark, text))
    assert rows(cat.columns, "col_ord", "col_name", "dtype") == [
        (0, "a", "number"), (1, "b", "decimal(10"), (2, "2", "text"),
    ]


def test_ddl_forms_that_do_not_match(spark):
    text = 'CREATE TABLE IF NOT EXISTS a (x INT); CREATE TABLE "b" (x INT); CREATE TABLE s.c (x INT);'
    assert C.catalog_from_ddl(ddl(spark, text)).tables.count() == 0


def test_ddl_key_line_is_a_column(spark):
    cat = C.catalog_from_ddl(ddl(spark, "CREATE TABLE t (id INT, PRIMARY KEY id)"))
    assert rows(cat.columns, "col_name", "dtype", "is_pk") == [
        ("PRIMARY", "key", True), ("id", "number", False),
    ]


def test_ddl_table_defined_twice(spark):
    """The last definition gives the columns, both give containment edges."""
    text = "CREATE TABLE t (a INT, u_id INT); CREATE TABLE u (id INT); CREATE TABLE t (b INT);"
    cat = C.catalog_from_ddl(ddl(spark, text))
    assert rows(cat.tables, "table_ord", "table_name") == [(0, "t"), (1, "u")]
    assert rows(cat.columns, "table_name", "col_name") == [("t", "b"), ("u", "id")]
    assert rows(C.edges(cat), "source", "target", "edge_type") == [
        ("t", "t.a", "table_column"), ("t", "t.b", "table_column"), ("t", "t.u_id", "table_column"),
        ("t", "u", "table_table"), ("t.u_id", "u.id", "foreign_key"), ("u", "u.id", "table_column"),
    ]


def test_reference_goes_to_first_key_else_to_last_name(spark):
    cat = C.catalog_from_ddl(
        ddl(
            spark,
            "CREATE TABLE a (A_ID INT, id INT); CREATE TABLE b (a_id INT);",
            "CREATE TABLE a (x INT PRIMARY KEY, id INT); CREATE TABLE b (a_id INT);",
            "CREATE TABLE A (y INT); CREATE TABLE a (id INT); CREATE TABLE b (a_id INT);",
        )
    )
    assert rows(cat.fks, "schema_id", "to_table", "to_column") == [
        ("s0", "a", "id"), ("s1", "a", "x"),
    ]


def test_later_reference_wins_and_first_column_is_marked(spark):
    columns = spark.createDataFrame(
        [("s", 0, "t", 0, "c", "text", False), ("s", 0, "t", 1, "c", "text", False)],
        "schema_id string, table_ord int, table_name string, col_ord int, col_name string,"
        " dtype string, is_pk boolean",
    )
    fks = spark.createDataFrame(
        [("s", 1, "t", "c", "u", "x"), ("s", 2, "t", "c", "v", "y")],
        "schema_id string, fk_ord int, from_table string, from_column string,"
        " to_table string, to_column string",
    )
    marked = C.mark_foreign_keys(columns, fks)
    assert rows(marked, "col_ord", "is_fk", "fk_table", "fk_column") == [
        (0, True, "v", "y"), (1, False, None, None),
    ]
    keys = spark.createDataFrame(
        [("s", "t", "c")], "schema_id string, table_name string, col_name string"
    )
    assert rows(C.mark_primary_keys(columns, keys), "col_ord", "is_pk") == [(0, True), (1, False)]


@pytest.mark.parametrize(
    "title, name",
    [
        ("Big Ten - 2001 (men's)", "Big_Ten___2001_mens"),
        ("Liste été n°4", "Liste_été_n4"),
        ("", "table"),
        (None, "table"),
    ],
)
def test_clean_title(spark, title, name):
    df = spark.createDataFrame([(title,)], "t string")
    assert df.select(C.clean_title(F.col("t"))).first()[0] == name


def test_single_table_pairs_up_to_the_shorter_list(spark):
    records = spark.createDataFrame(
        [("1", "T", ["a", "b", "c"], ["text", "real"]), ("2", None, ["x"], None)],
        "id string, page_title string, header array<string>, types array<string>",
    )
    columns = C.catalog_from_single_tables(records).columns
    assert rows(columns, "schema_id", "table_name", "col_name", "dtype", "is_pk") == [
        ("1", "T", "a", "text", True), ("1", "T", "b", "real", False),
        ("2", "table", "x", "text", True),
    ]


STRICT = '''-- CREATE TABLE ghost (x int);
CREATE TABLE IF NOT EXISTS "main"."Order ""X""" (
  id INTEGER PRIMARY KEY, name VARCHAR(255) NOT NULL DEFAULT 'a, (b', -- a comment, with (parens
  price DECIMAL(10, 2) CHECK (price > 0 AND (price < 10 OR (price = 11))), "unit price" DOUBLE PRECISION,
  `key` VARCHAR(10), key2, flag, /* x, y ( */ tags TEXT[], cid INT REFERENCES shop.customer (ID),
  CONSTRAINT fk FOREIGN KEY (name, price) REFERENCES [Customer] (nm, pr) ON DELETE CASCADE,
  UNIQUE (name), KEY idx (name(10)), CHECK (a IN ('x','y')) );
create temporary table shop.Customer(Id int, nm text, pr number, key VARCHAR(10), index INT,
  PRIMARY KEY (Id, nm DESC), owner_ref int references Owner, lost int references nowhere (x));
CREATE TABLE Owner (oid INT, order_id INT, PRIMARY KEY(oid)); CREATE TABLE "order" (id int primary key);
CREATE TABLE only_keys (PRIMARY KEY (x)); CREATE TABLE open_end (a int, b varchar(3
'''


def test_strict_ddl(spark):
    frame = spark.createDataFrame(
        [("s", STRICT), ("n", None), ("e", ""), ("z", "select 1; )(,")], "schema_id string, ddl string"
    )
    found = C.catalog_from_ddl(frame, strict=True)
    names = [r["table_name"] for r in found.tables.orderBy("table_ord").collect()]
    assert names == ['Order "X"', "Customer", "Owner", "order", "only_keys", "open_end"]
    columns = found.columns.orderBy("table_ord", "col_ord").collect()
    assert {r["schema_id"] for r in columns} == {"s"}
    assert [(r["table_ord"], r["col_name"], r["dtype"], r["is_pk"]) for r in columns] == [
        (0, "id", "number", True), (0, "name", "text", False), (0, "price", "number", False),
        (0, "unit price", "number", False), (0, "key", "text", False), (0, "key2", "text", False),
        (0, "flag", "text", False), (0, "tags", "text", False), (0, "cid", "number", False),
        (1, "Id", "number", True), (1, "nm", "text", True), (1, "pr", "number", False),
        (1, "key", "text", False), (1, "index", "number", False), (1, "owner_ref", "number", False),
        (1, "lost", "number", False), (2, "oid", "number", True), (2, "order_id", "number", False),
        (3, "id", "number", True), (5, "a", "number", False), (5, "b", "text", False),
    ]
    keys = found.fks.select("from_table", "from_column", "to_table", "to_column").collect()
    assert sorted(map(tuple, keys)) == sorted([
        ('Order "X"', "cid", "Customer", "Id"), ('Order "X"', "name", "Customer", "nm"),
        ('Order "X"', "price", "Customer", "pr"), ("Customer", "owner_ref", "Owner", "oid"),
        # not declared, inferred from the name
        ("Owner", "order_id", "order", "id"),
    ])


def test_strict_ddl_defined_twice(spark):
    text = "CREATE TABLE a (x int); CREATE TABLE b (y int); CREATE TABLE a (z varchar(9), w int)"
    frame = spark.createDataFrame([("s", text)], "schema_id string, ddl string")
    columns = C.catalog_from_ddl(frame, strict=True).columns.orderBy("table_ord", "col_ord").collect()
    assert [(r["table_ord"], r["table_name"], r["col_name"]) for r in columns] == [
        (0, "a", "z"), (0, "a", "w"), (1, "b", "y")
    ]


def test_strict_ddl_of_many_columns(spark):
    """The time grows with the text: no expression is computed again per column."""
    body = ", ".join(f"c{i} DECIMAL(10,{i % 9}) DEFAULT '(,'" for i in range(3000))
    frame = spark.range(1).selectExpr("'s' as schema_id", f"\"CREATE TABLE t ({body})\" as ddl")
    found = C.catalog_from_ddl(frame, strict=True).columns
    assert found.where("dtype = 'number'").count() == 3000
