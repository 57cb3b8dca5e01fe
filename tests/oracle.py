"""Comparison of a query with its SQL."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return canonical(con.execute(sql).df())


def canonical(df):
    df = df[sorted(df.columns)]
    rows = df.astype(object).where(df.notna(), None).values.tolist()
    return list(df.columns), sorted(map(repr, rows))
