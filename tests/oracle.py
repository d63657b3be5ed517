"""Runs a registered query and its SQL on the same tables and compares rows.

``python -m tests.oracle [sf] [key ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
import sys
import time

import duckdb

DATA = "/root/testdata"


def engine(sf: str):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/sf{sf}/*.parquet"):
        name = os.path.basename(path).split(".")[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, (str, bytes)):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return float(f"{value:.9g}")
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def family(name: str) -> str:
    name = str(name).lower()
    if name in ("bigint", "int", "integer", "smallint", "tinyint"):
        return "int"
    if name in ("string", "varchar"):
        return "string"
    if name.startswith("timestamp"):
        return "timestamp"
    if name.startswith("decimal"):
        return "decimal"
    return name


def compare(con, df, sql: str) -> tuple[bool, str]:
    cur = con.execute(sql)
    theirs_cols = [d[0] for d in cur.description]
    types = {d[0]: family(d[1]) for d in cur.description}
    theirs = cur.fetchall()
    if sorted(df.columns) != sorted(theirs_cols):
        return False, f"columns {sorted(df.columns)} vs {sorted(theirs_cols)}"
    mine_types = {n: family(t) for n, t in df.dtypes}
    off = {c: (mine_types[c], types[c]) for c in types if mine_types[c] != types[c] and not mine_types[c].startswith("array")}
    order = sorted(df.columns)
    mine = [tuple(plain(r[c]) for c in order) for r in df.collect()]
    index = {c: i for i, c in enumerate(theirs_cols)}
    other = [tuple(plain(r[index[c]]) for c in order) for r in theirs]
    mine.sort(key=repr)
    other.sort(key=repr)
    note = f"rows={len(mine)}/{len(other)}" + (f" TYPES {off}" if off else "")
    if mine == other:
        return not off, note
    a, b = set(map(repr, mine)), set(map(repr, other))
    only_a, only_b = sorted(a - b)[:2], sorted(b - a)[:2]
    return False, f"{note} cols={order}\n   spark-only({len(a - b)}): {[x[:400] for x in only_a]}\n   sql-only({len(b - a)}): {[x[:400] for x in only_b]}"


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from tests.conftest import make_session

    sf = argv[0] if argv else "0.01"
    spark = make_session()
    con = engine(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, f"{DATA}/sf{sf}")
            if name in oracles:
                ok, note = compare(con, df, oracles[name])
            else:
                ok, note = True, f"no sql, rows={df.count()}"
        except Exception as e:  # report and go on with the other queries
            ok, note = False, f"{type(e).__name__}: {str(e)[:900]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
