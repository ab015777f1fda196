"""Running checking SQL and comparing its rows with a DataFrame's."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of_sql(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    return [c[0] for c in cur.description], cur.fetchall()


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, float):
        return round(v, 8) + 0.0
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def assert_same(df, sql, sf_dir):
    names, want = rows_of_sql(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    at = {n: i for i, n in enumerate(names)}
    want = sorted((tuple(_plain(r[at[n]]) for n in order) for r in want), key=repr)
    got = sorted((tuple(_plain(r[n]) for n in order) for r in df.collect()), key=repr)
    assert len(got) == len(want)
    assert got == want
