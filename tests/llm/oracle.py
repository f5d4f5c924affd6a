"""Runs a query's DuckDB SQL over Parquet files or rows and compares it with Spark's rows."""

import duckdb
import pyarrow as pa

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql, sf_dir=None, **tables):
    con = duckdb.connect()
    for t in TABLES if sf_dir else []:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, table in tables.items():
        con.register(name, table if isinstance(table, pa.Table) else pa.Table.from_pylist(table))
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(row[k] for k in order) for row in cur.fetchall()), key=str)


def rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)
