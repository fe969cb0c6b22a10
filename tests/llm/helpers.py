"""Rows of results in a comparable form."""

import duckdb


def rows_of(df) -> list[tuple]:
    show = lambda x: f"{x:.9g}" if isinstance(x, float) else x
    return sorted((tuple(show(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)


def oracle_rows(folder: str, sql: str, *tables: str) -> list[tuple]:
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    rel = con.sql(sql)
    show = lambda x: f"{x:.9g}" if isinstance(x, float) else x
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    return sorted((tuple(show(r[i]) for i in at) for r in rel.fetchall()), key=str)
