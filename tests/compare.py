"""Runs registered queries against their SQL on one folder of tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is not None, str(type(x)), x) if x is not None else (False, "", 0) for x in r))


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, query, sql):
    """None where both agree, else what differs."""
    df = query(spark, sf_dir)
    got, cur = [tuple(r) for r in df.collect()], con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a != b:
        bad = next((x for x in zip(a, b) if x[0] != x[1]), None)
        return f"{len(a)} rows against {len(b)}; first difference {bad}"
    return None
