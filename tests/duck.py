"""Runs a query and its SQL side by side."""

import glob
import os

import duckdb


def rows_of(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(names)
    return order, sorted((tuple(r[names.index(c)] for c in order) for r in found.fetchall()), key=str)


def same(df, sql: str, sf_dir: str) -> None:
    names, want = rows_of(sql, sf_dir)
    assert sorted(df.columns) == names
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=str) == want
