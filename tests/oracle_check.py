"""Run registered queries and their SQL side by side and compare all values."""

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _canonical(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(round(value, 9))
    if isinstance(value, pd.Timestamp):
        return value.isoformat()
    return str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_canonical(row[i]) for i in order) for row in rows)


def compare(spark, con, query, sql, sf_dir):
    """None if equal, else a short account of the difference."""
    frame = query(spark, sf_dir)
    ours = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    theirs = _rows(names, relation.fetchall())
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    if not theirs:
        return "the SQL gives no rows"
    if ours != theirs:
        extra = [r for r in ours if r not in theirs][:2]
        missing = [r for r in theirs if r not in ours][:2]
        return f"{len(ours)} rows vs {len(theirs)}; only Spark {extra}; only SQL {missing}"
    return None
