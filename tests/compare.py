"""Side-by-side run of a query in Spark and its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return db


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


SPARK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def compare(db, df, sql: str) -> list[str]:
    """Differences in columns, types and rows; empty when equal."""
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    wanted = _rows(names, cursor.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    for name, kind in df.dtypes:
        if SPARK_TYPES.get(kind, kind) != types[name]:
            problems.append(f"type of {name}: {kind} against {types[name]}")
    if len(got) != len(wanted):
        problems.append(f"{len(got)} rows against {len(wanted)}")
    different = [(g, w) for g, w in zip(got, wanted) if g != w]
    if different:
        g, w = different[0]
        problems.append(f"{len(different)} rows differ, first {str(g)[:300]} against {str(w)[:300]}")
    return problems
