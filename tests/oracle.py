"""Runs a registered query on Spark and its oracle on DuckDB and compares their rows."""

from __future__ import annotations

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def normal(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, sf_dir: str, query, sql: str, con=None) -> str:
    """An empty string where both agree, in names, row count and values."""
    df = query(spark, sf_dir)
    mine = normal(df.columns, [tuple(r) for r in df.collect()])
    cur = (con or duck(sf_dir)).execute(sql)
    theirs = normal([d[0] for d in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} and {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"{len(mine[1])} and {len(theirs[1])} rows"
    for a, b in zip(mine[1], theirs[1], strict=True):
        if a != b:
            return f"{a}\nand {b}"
    return ""
