import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from tablequill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tests")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def university(spark):
    """One catalog record: three tables, three keys, two references."""
    from tablequill.sources.readers import CATALOG_RECORD_SCHEMA

    names = [
        ["-1", "*"], ["0", "student_id"], ["0", "name"], ["0", "age"], ["1", "course_id"],
        ["1", "title"], ["1", "credits"], ["2", "enrollment_id"], ["2", "student_id"],
        ["2", "course_id"], ["2", "grade"],
    ]
    types = ["text", "number", "text", "number", "number", "text", "number", "number", "number",
             "number", "text"]
    row = ("university", ["Student", "Course", "Enrollment"], names, types, [1, 4, 7],
           [[8, 1], [9, 4]])
    return spark.createDataFrame([row], CATALOG_RECORD_SCHEMA)
