"""Compare registered queries with their SQL twins on DuckDB.

    python tests/oracle.py [--sf 0.001] [--sql] [name-part ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

DATA = "/root/testdata"


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}")
    if hasattr(v, "item"):
        return plain(v.item())
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, q, sf_dir):
    t = time.time()
    df = q.run(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t_spark = time.time() - t
    if not got[1]:
        return False, "no rows: such a comparison shows nothing", t_spark
    if not q.sql:
        return True, f"{len(got[1])} rows, no SQL", t_spark
    t = time.time()
    rel = con.execute(q.sql)
    want = rows_of([d[0] for d in rel.description], rel.fetchall())
    t_sql = time.time() - t
    if got == want:
        return True, f"{len(got[1])} rows (sql {t_sql:.1f}s)", t_spark
    msg = f"spark {len(got[1])} rows, sql {len(want[1])} rows; columns {got[0]} / {want[0]}"
    a, b = set(got[1]), set(want[1])
    msg += f"\n   only spark: {sorted(a - b, key=repr)[:4]}\n   only sql:   {sorted(b - a, key=repr)[:4]}"
    return False, msg[:1500], t_spark


def main(argv):
    from helixframe.plans import catalog
    from helixframe.session import local_session
    sf = "0.001"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        del argv[i:i + 2]
    sf_dir = f"{DATA}/sf{sf}"
    only_sql = "--sql" in argv
    argv = [a for a in argv if a != "--sql"]
    spark = local_session()
    con = connect(sf_dir)
    bad = []
    for name, q in catalog.load().items():
        if (argv and not any(a in name for a in argv)) or (only_sql and not q.sql):
            continue
        try:
            ok, msg, sec = compare(spark, con, q, sf_dir)
        except Exception as e:  # report and go on with the next query
            ok, msg, sec = False, f"{type(e).__name__}: {str(e)[:900]}", 0.0
        print(("ok   " if ok else "FAIL ") + f"{name:34s} {sec:6.1f}s  {msg}", flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
