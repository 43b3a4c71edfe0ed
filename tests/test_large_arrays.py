"""JSON arrays that many tasks read: cuts inside strings, nested records and escapes."""

import json
import random

import pytest

from tablequill.sources import readers

BITS = ["}", "{", '"', "\\", "]", "[", ",", "a", "é", " ", "\n", '\\"', "}{", "\\}"]
SCHEMA = "id long, text string, nested string, deep struct<x:string,y:array<struct<z:string>>>"


def _records(n):
    rng = random.Random(1)

    def text():
        return "".join(rng.choice(BITS) for _ in range(rng.randrange(9)))

    out = []
    for i in range(n):
        row = {"id": i, "text": text()}
        if i % 2:
            row["nested"] = json.dumps({"a": text(), "b": [text(), {}]})
        else:
            row["deep"] = {"x": text(), "y": [{"z": text()}]}
        out.append(row)
    return out


@pytest.mark.parametrize("indent", [None, 2])
def test_one_file_is_read_by_many_tasks(spark, tmp_path, indent):
    rows = _records(200)
    (tmp_path / "rows.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=False))
    (tmp_path / "none.json").write_text("[]")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        tasks = spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions()
        found = readers.read_large_array(spark, str(tmp_path), SCHEMA).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert tasks > 10

    def plain(row):
        deep = row["deep"] and (row["deep"]["x"], row["deep"]["y"][0]["z"])
        return row["id"], row["text"], row["nested"], deep

    wanted = [plain({"nested": None, "deep": None} | r) for r in rows]
    assert sorted(map(plain, found), key=lambda r: r[0]) == wanted


def test_broken_object_stops(spark, tmp_path):
    (tmp_path / "rows.json").write_text('[{"id": 1}, {"id": x}]')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_large_array(spark, str(tmp_path), "id long").collect()
