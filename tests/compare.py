"""Compare registered queries with their SQL counterparts on DuckDB.

    python tests/compare.py <folder> [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "float": "FLOAT",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(v)) for v in row)


def difference(df, relation: duckdb.DuckDBPyRelation) -> str | None:
    """None if columns, types and rows agree, else what differs first."""
    names = sorted(df.columns)
    if names != sorted(relation.columns):
        return f"columns {names} / {sorted(relation.columns)}"
    theirs = dict(zip(relation.columns, map(str, relation.types)))
    for name, kind in df.dtypes:
        if TYPES.get(kind, kind) != theirs[name]:
            return f"type of {name}: {kind} / {theirs[name]}"
    quoted = ", ".join(f'"{n}"' for n in names)
    ours = sorted((tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=_key)
    expected = sorted(relation.project(quoted).fetchall(), key=_key)
    if len(ours) != len(expected):
        return f"rows {len(ours)} / {len(expected)}"
    for mine, other in zip(ours, expected):
        for a, b in zip(mine, other):
            same = a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=0, abs_tol=1e-12))
            if not same:
                return f"row {mine} / {other}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import build_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark, con = build_session(), connect(folder)
    sql, failed = oracle_sql(), 0
    for name, run in queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            df = run(spark, folder)
            if name in sql:
                result = difference(df, con.sql(sql[name])) or "equal"
            else:
                result = f"{len(df.collect())} rows, no SQL"
        except Exception as error:
            result = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        failed += not (result == "equal" or result.endswith("no SQL"))
        print(f"{name:28} {time.time() - started:6.2f}s  {result}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
