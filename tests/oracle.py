"""Compares a query with its SQL, as rows without order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(d):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    out = [tuple(f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else repr(v) for v in (r[i] for i in order)) for r in values]
    return sorted(names), sorted(out)


def compare(spark, name, query, sql, d):
    df = query(spark, d)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = duck(d).sql(sql)
    want = rows(rel.columns, rel.fetchall())
    assert got[0] == want[0], (name, got[0], want[0])
    assert len(got[1]) == len(want[1]), (name, len(got[1]), len(want[1]))
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    assert not bad, (name, len(bad), bad[:2])
