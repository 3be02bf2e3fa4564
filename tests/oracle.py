"""Compare a query with its SQL over the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


def same(df, connection, sql):
    columns = sorted(df.columns)
    got = sorted((tuple(map(_plain, r)) for r in df.select(*columns).collect()), key=repr)
    found = connection.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = sorted((tuple(_plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert got == expected
    return len(got)
