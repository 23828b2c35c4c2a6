"""Comparison of a query with its SQL on the same tables."""

import duckdb

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{sf}/{t}.parquet'")
    return c


def same(spark, query, sql, sf="sf0.001"):
    ours, theirs = query(spark, f"{DATA}/{sf}").toPandas(), connect(sf).execute(sql).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(object).where(df[columns].notna(), None).astype(str).values.tolist()))
    assert rows(ours) == rows(theirs)
    return len(ours)
