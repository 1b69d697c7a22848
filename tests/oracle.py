"""Compares a query with its SQL on DuckDB, row by row."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return None if math.isnan(v) else repr(float(f"{v:.10g}")) if v else "0.0"
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return v


def rows(table, columns):
    return sorted(repr([plain(r[c]) for c in columns]) for r in table.select(columns).to_pylist())


def agree(df, sql, duck):
    columns = sorted(df.columns)
    other = duck.sql(sql).to_arrow_table()
    assert sorted(other.column_names) == columns
    assert rows(df.toArrow(), columns) == rows(other, columns)
