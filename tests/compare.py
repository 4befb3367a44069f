"""Holds queries against their SQL, as the driver does: names, row counts and values."""

from __future__ import annotations

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return "\0"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def oracle(sql: str, sf_dir: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    c.execute(sql)
    names = [d[0] for d in c.description]
    return names, c.fetchall()


def differences(spark, name: str, f, sql: str, sf_dir: str) -> str | None:
    df = f(spark, sf_dir)
    names, want = oracle(sql, sf_dir)
    if sorted(df.columns) != sorted(names):
        return f"{name}: columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    got = sorted(tuple(norm(r[c]) for c in order) for r in df.collect())
    want = sorted(tuple(norm(r[names.index(c)]) for c in order) for r in want)
    if got != want:
        odd = [(g, w) for g, w in zip(got, want) if g != w][:3]
        return f"{name}: {len(got)} and {len(want)} rows, {order}: {odd}"
    return None
