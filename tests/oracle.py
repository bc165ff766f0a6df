"""Compare registered queries with their SQL in DuckDB.

Run as a script: ``python tests/oracle.py SF_DIR [name ...]``.
"""

from __future__ import annotations

import math
import sys
import time
from datetime import datetime
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_SAME_TYPE = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'"
        )
    return connection


def _plain(value):
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(df, connection, sql) -> list[str]:
    """What differs between a DataFrame and a SQL result; empty when equal."""
    found = []
    result = connection.execute(sql)
    columns = [c[0] for c in result.description]
    types = {c[0]: str(c[1]) for c in result.description}
    if sorted(df.columns) != sorted(columns):
        return [f"columns {df.columns} / {columns}"]
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if _SAME_TYPE.get(kind) != types[field.name]:
            found.append(f"type of {field.name}: {kind} / {types[field.name]}")
    ours = _rows(df.columns, df.collect())
    theirs = _rows(columns, result.fetchall())
    if len(ours) != len(theirs):
        found.append(f"rows {len(ours)} / {len(theirs)}")
    if ours != theirs:
        left, right = set(ours), set(theirs)
        found.append(f"only ours {sorted(left - right)[:3]}")
        found.append(f"only theirs {sorted(right - left)[:3]}")
    return found


def main(sf_dir: str, names: list[str]) -> int:
    root = Path(__file__).resolve().parent.parent
    sys.path[:0] = [str(root), str(root / "tests")]
    import __spark_entry__ as entry
    from conftest import make_session

    spark = make_session()
    connection = connect(sf_dir)
    sql, bad = entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in sql:
                problems = differences(df, connection, sql[name])
                verdict = "; ".join(problems) or "equal"
            else:
                problems = []
                verdict = f"no SQL, {df.count()} rows"
        except Exception as error:  # report every query
            problems = [str(error)]
            verdict = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problems)
        print(f"{name:28s} {time.time() - start:6.2f}s  {verdict}", flush=True)
    print(f"{bad} queries differ")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
