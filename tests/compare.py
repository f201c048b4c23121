"""Running a registered query against its SQL, value by value."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def oracle_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    result = con.execute(sql)
    return [d[0] for d in result.description], result.fetchall()


def _key(row: tuple) -> list[tuple]:
    return [(v is not None, str(v)) for v in row]


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    """Rows with columns by name, sorted; -0.0 and NaN kept visible."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=_key)


def differences(spark_df, sql: str, sf_dir: str) -> list[str]:
    got = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    columns, rows = oracle_rows(sql, sf_dir)
    want = canonical(columns, rows)
    found = []
    if sorted(spark_df.columns) != sorted(columns):
        found.append(f"columns {sorted(spark_df.columns)} != {sorted(columns)}")
    if len(got) != len(want):
        found.append(f"{len(got)} rows != {len(want)}")
    for g, w in zip(got, want):
        same = [type(a) is type(b) and (a == b) and _sign(a) == _sign(b) for a, b in zip(g, w)]
        if not all(same):
            found.append(f"{g}\n  != {w}")
    return found[:5]


def _sign(v) -> float:
    return math.copysign(1, v) if isinstance(v, float) else 0
