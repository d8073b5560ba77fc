"""Run a registered query and its SQL over the same tables and compare rows and values."""
from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if (Path(sf_dir) / f"{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(sorted((k, _cell(v)) for k, v in value.asDict().items()))
    return value


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, con, sf_dir, fn, sql):
    """None when equal, otherwise a short account of the difference."""
    got = fn(spark, sf_dir)
    mine = normal([tuple(r) for r in got.collect()], got.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = normal(cur.fetchall(), names)
    if sorted(got.columns) != sorted(names):
        return f"columns {sorted(got.columns)} against {sorted(names)}"
    if mine != want:
        a, b = set(mine), set(want)
        return (f"{len(mine)} rows against {len(want)}; only here "
                f"{sorted(a - b, key=repr)[:3]}; only in SQL {sorted(b - a, key=repr)[:3]}")
    return None
