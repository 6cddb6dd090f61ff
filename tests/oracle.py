"""Compare a query with its SQL in DuckDB: sorted columns, sorted rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(d):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return c


def shown(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, bool) or v is None:
        return str(v)
    return repr(v) if not isinstance(v, int) else str(v)


def compare(spark, con, query, sql, d):
    df = query(spark, d)
    cols = sorted(df.columns)
    mine = sorted(tuple(shown(v) for v in r) for r in df.select(*cols).collect())
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols, (sorted(rel.columns), cols)
    theirs = sorted(tuple(shown(v) for v in r) for r in rel.select(*(f'"{c}"' for c in cols)).fetchall())
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    assert not bad, (len(bad), bad[:3])
    return len(mine)
