"""Compare a query's rows with its SQL on another engine, without regard to order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{plain(x)}" for k, x in v.items()) + "}"
    if type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return str(v)


def assert_same(df, con, sql):
    names = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in names) for r in (x.asDict(recursive=True) for x in df.collect()))
    found = con.execute(sql)
    theirs = [c[0] for c in found.description]
    assert sorted(theirs) == names
    rows = [dict(zip(theirs, r, strict=True)) for r in found.fetchall()]
    assert ours == sorted(tuple(plain(r[c]) for c in names) for r in rows)
