import pytest

from tablequill.operators import catalog as C
from tablequill.operators import schema_text as S

EXPECTED = {
    "basic": (
        "Schema Graph:\n"
        "Table: Student(student_id, name, age)\n"
        "Table: Course(course_id, title, credits)\n"
        "Table: Enrollment(enrollment_id, student_id, course_id, grade)\n"
        "Foreign Key: Enrollment.student_id -> Student.student_id\n"
        "Foreign Key: Enrollment.course_id -> Course.course_id"
    ),
    "detailed": (
        "Schema:\n"
        "Table: Student\n"
        "  Columns: student_id (number, PK), name (text), age (number)\n"
        "Table: Course\n"
        "  Columns: course_id (number, PK), title (text), credits (number)\n"
        "Table: Enrollment\n"
        "  Columns: enrollment_id (number, PK), student_id (number, FK->Student.student_id),"
        " course_id (number, FK->Course.course_id), grade (text)\n"
        "Relations:\n"
        "  Enrollment.student_id = Student.student_id\n"
        "  Enrollment.course_id = Course.course_id"
    ),
    "typed": (
        "[table] Student\n  [column_primary] student_id\n  [column] name\n  [column] age\n"
        "[table] Course\n  [column_primary] course_id\n  [column] title\n  [column] credits\n"
        "[table] Enrollment\n  [column_primary] enrollment_id\n  [column_foreign] student_id\n"
        "  [column_foreign] course_id\n  [column] grade\n"
        "[foreign_key_edge] Enrollment.student_id -> Student.student_id\n"
        "[foreign_key_edge] Enrollment.course_id -> Course.course_id"
    ),
    "compact": (
        "Tables: Student(student_id*, name, age) | Course(course_id*, title, credits) | "
        "Enrollment(enrollment_id*, student_id^Student.student_id, course_id^Course.course_id, grade)"
    ),
    "structured": (
        "[TABLES]\n"
        "Student:\n    student_id (PK)\n    name\n    age\n"
        "Course:\n    course_id (PK)\n    title\n    credits\n"
        "Enrollment:\n    enrollment_id (PK)\n    student_id (FK)\n    course_id (FK)\n    grade\n"
        "\n[FOREIGN KEYS]\n"
        "Enrollment.student_id -> Student.student_id\n"
        "Enrollment.course_id -> Course.course_id"
    ),
}


@pytest.mark.parametrize("style", S.STYLES)
def test_styles(university, style):
    cat = C.catalog_from_records(university)
    assert S.schema_text(cat, style, include_db_id=False).first().text == EXPECTED[style]


def test_database_id_and_links(spark, university):
    cat = C.catalog_from_records(university)
    links = spark.createDataFrame(
        [("university", "a.x", "b.x", 2), ("university", "a.y", "b.y", 1)],
        "schema_id string, source string, target string, rank int",
    )
    structured = S.schema_text(cat, "structured", True, links).first().text
    assert structured == (
        "[DATABASE]\nuniversity\n\n" + EXPECTED["structured"]
        + "\n\n[SEMANTIC LINKS]\na.y ≈ b.y\na.x ≈ b.x"
    )
    basic = S.schema_text(cat, "basic", True, links).first().text
    assert basic == (
        "Database: university\n" + EXPECTED["basic"]
        + "\nSemantic Link: a.y ≈ b.y\nSemantic Link: a.x ≈ b.x"
    )


def test_unknown_style(university):
    with pytest.raises(ValueError):
        S.schema_text(C.catalog_from_records(university), "pretty")


def test_schema_without_keys_has_no_empty_sections(spark):
    cat = C.catalog_from_ddl(
        spark.createDataFrame([("s", "CREATE TABLE t (a INT)")], "schema_id string, ddl string")
    )
    assert S.schema_text(cat, "structured").first().text == "[DATABASE]\ns\n\n[TABLES]\nt:\n    a"
    assert S.schema_text(cat, "detailed").first().text == "Database: s\nSchema:\nTable: t\n  Columns: a (number)"


def parse(spark, text):
    df = spark.createDataFrame([("s", text)], "schema_id string, schema string")
    found = S.text_to_columns(df).orderBy("line_ord").collect()
    return [(r.table_name, r.col_name) for r in found]


def test_round_trip(spark, university):
    cat = C.catalog_from_records(university)
    text = S.schema_text(cat, "structured").first().text
    expected = [
        (r.table_name, r.col_name) for r in cat.columns.orderBy("table_ord", "col_ord").collect()
    ]
    assert parse(spark, text) == expected


def test_text_rules(spark):
    text = (
        "ignored:\n  x\n[TABLES]\n\"my table\":\n  \"a b\" (PK)\n# comment\n-- comment\n\tc(FK)\n"
        "t:\n  old\nt:\n  new\nempty:\n[OTHER]\nt:\n  outside\n[TABLES]\n  orphan\nlate:\n  z"
    )
    assert parse(spark, text) == [("my table", "a b"), ("my table", "c"), ("t", "new"), ("late", "z")]


def test_opened_again_without_columns_keeps_the_earlier(spark):
    assert parse(spark, "[TABLES]\nt:\n a\nu:\n b\nt:") == [("t", "a"), ("u", "b")]


def test_fallback_lines(spark):
    text = "# x: y\n[a: b]\nt: c (text)\nt: d\na:b:c\nu:\nplain"
    assert parse(spark, text) == [("t", "c"), ("t", "d")]


def test_header_text(spark):
    schema = "id string, page_title string, header array<string>, types array<string>"
    full = spark.createDataFrame(
        [("1", "T", ["a", "b"], ["text", "text"]), ("2", "", ["c", "d"], ["text"]),
         ("3", "T", ["e"], ["text"])], schema,
    )
    cat = C.catalog_from_single_tables(full)
    bare = full.selectExpr("id", "page_title", "if(id = '1', header, null) AS header", "types")
    texts = {r.schema_id: r.text for r in S.header_text(bare, cat).collect()}
    assert texts == {
        "1": "Table columns: a, b", "2": "Table columns: c", "3": "Table columns: (unknown)",
    }
    texts = {r.schema_id: r.text for r in S.header_text_structured(bare, cat).collect()}
    assert texts["1"] == "[TABLES]\ntable:\n    a\n    b"
    assert texts["3"] == "[TABLES]\ntable:\n    (unknown)"
