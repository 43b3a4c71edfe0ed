"""Run every query in Spark and its SQL in DuckDB and compare rows and types.

python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

from tablequill.plans.fixtures import TABLES  # noqa: E402

TYPES = {
    "string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def compare(df, con, sql: str) -> tuple[int, list[str]]:
    """(rows, problems)"""
    names = sorted(df.columns)
    mine = sorted((tuple(r[n] for n in names) for r in df.collect()), key=_key)
    rel = con.sql(sql)
    problems = []
    if sorted(rel.columns) != names:
        return len(mine), [f"columns {names} != {sorted(rel.columns)}"]
    types = dict(zip(rel.columns, map(str, rel.types)))
    for n, t in df.dtypes:
        if TYPES.get(t) != types[n]:
            problems.append(f"type of {n}: {t} / {types[n]}")
    at = [rel.columns.index(n) for n in names]
    other = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=_key)
    if len(mine) != len(other):
        problems.append(f"rows {len(mine)} != {len(other)}")
    for a, b in zip(mine, other):
        if a != b:
            problems.append(f"first difference\n   spark  {str(a)[:900]}\n   duckdb {str(b)[:900]}")
            break
    return len(mine), problems


def main() -> int:
    import __spark_entry__ as entry
    from tablequill.session import local_session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    wanted = args[1:] or list(entry.queries())
    oracles, bad = entry.oracle_sql(), 0
    for name in wanted:
        start = time.time()
        try:
            df = entry.queries()[name](spark, sf_dir)
            rows, problems = compare(df, con, oracles[name])
        except Exception as e:  # noqa: BLE001
            rows, problems = 0, [f"{type(e).__name__}: {str(e)[:1500]}"]
        took = time.time() - start
        state = "ok  " if not problems and rows else ("EMPTY" if not problems else "BAD ")
        bad += state != "ok  "
        print(f"{state} {name:28s} rows={rows:7d} {took:6.1f}s", *problems, sep="\n     " if problems else "", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} equal")
    return bad


if __name__ == "__main__":
    sys.exit(main())
