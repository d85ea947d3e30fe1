"""A query's rows against those of its SQL in DuckDB."""

import datetime
import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6) + 0.0
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(df, sf_dir=DATA):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def oracle_rows(sql, sf_dir=DATA):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    names = sorted(cols)
    at = [cols.index(n) for n in names]
    return names, sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)


def same(spark, query, sql, sf_dir=DATA):
    got, want = rows_of(query(spark, sf_dir)), oracle_rows(sql, sf_dir)
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    bad = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    assert not bad, bad[:2]
    return len(got[1])
