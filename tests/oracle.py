"""Compare a registered query with its DuckDB SQL, as sets of rows with columns by name."""

import datetime
import decimal
import glob
import os


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)[:19].removesuffix(" 00:00:00")
    return v


def compare(spark, name, sf_dir, queries, oracles):
    import duckdb

    df = queries[name](spark, sf_dir)
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.execute(oracles[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(df.columns), (sorted(cols), sorted(df.columns))
    order = sorted(cols)
    a = sorted([tuple(norm(r[c]) for c in order) for r in df.collect()], key=repr)
    b = sorted([tuple(norm(r[cols.index(c)]) for c in order) for r in want.fetchall()], key=repr)
    assert len(a) == len(b), (len(a), len(b))
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    assert not diff, (order, diff[:3], len(diff))
    return len(a)
