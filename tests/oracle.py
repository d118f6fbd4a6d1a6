"""Compares a query's rows with DuckDB's: columns by name, rows in any order."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i].lower())
    return [names[i].lower() for i in order], sorted([tuple(norm(r[i]) for i in order) for r in data], key=repr)


def duck(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    return rows([d[0] for d in cur.description], cur.fetchall())


def check(df, sql, sf_dir):
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), duck(sql, sf_dir)
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    bad = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    assert not bad, bad[:3]
