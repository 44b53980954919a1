"""Run a registered query and its SQL and compare the rows."""

import math

import duckdb

TABLES = """region nation customer supplier part orders lineitem events documents
embeddings pages benchmark labels conversations""".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    rows = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(
        rows, key=lambda r: [(v is not None, str(type(v)), v) for v in r]
    )


def differences(df, con, sql):
    """What differs between a Spark result and the SQL result, as text."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    got = [tuple(r) for r in df.collect()]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(names)}"
    if len(got) != len(expected):
        return f"{len(got)} rows instead of {len(expected)}"
    ordered = sorted(names)
    for a, b in zip(_sorted(df.columns, got), _sorted(names, expected)):
        bad = [
            (n, x, y)
            for n, x, y in zip(ordered, a, b)
            if type(x) is not type(y) or x != y or (
                isinstance(x, float) and math.isnan(x))
        ]
        if bad:
            return f"{bad} in {dict(zip(ordered, a))}"
    return None
