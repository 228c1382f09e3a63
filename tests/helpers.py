"""Rows of Spark and of DuckDB in one comparable form."""

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(df):
    """Sorted rows, columns by name, as text."""
    names = sorted(df.columns)
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in names))) for r in df.collect())


def duck_rows(sql, sf_dir=SF):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(sql)
    order = [rel.columns.index(c) for c in sorted(rel.columns)]
    return sorted(repr(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order)) for r in rel.fetchall())
