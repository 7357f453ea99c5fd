"""Holds a registered query against its SQL in DuckDB, as sorted rows by sorted column names."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        if isinstance(x, float):
            return f"{x:.9g}"
        return str([plain(y) for y in x]) if isinstance(x, (list, tuple)) else str(x)

    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def same(spark, sf_dir, query, sql):
    got = query(spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(columns)
    assert _rows(map(tuple, got.collect()), got.columns) == _rows(found.fetchall(), columns)
