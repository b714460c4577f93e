"""Run catalog queries against their SQL: python tests/check_catalog.py [folder] [name ...]"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(v):
        if v is None:
            return "~"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.6g}" if abs(v) >= 1 else f"{v:.6f}"
        return str(v)

    return sorted(tuple(text(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def compare(spark, con, folder, name, query, sql):
    start = time.time()
    df = query(spark, folder)
    got, got_cols = canonical([tuple(r) for r in df.collect()], df.columns)
    took = time.time() - start
    if sql is None:
        return f"{name}: rows={len(got)} (no SQL) {took:.1f}s", True
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want, want_cols = canonical(cur.fetchall(), columns)
    same = got_cols == want_cols and got == want
    line = f"{name}: {'ok' if same else 'DIFFERENT'} rows={len(got)}/{len(want)} {took:.1f}s"
    if not same:
        diff = [(a, b) for a, b in zip(got, want) if a != b][:4]
        line += f"\n   columns {got_cols} / {want_cols}\n   " + "\n   ".join(map(str, diff))
    return line, same


def main():
    from voxmill.plans.oracle import ORACLE
    from voxmill.plans.queries import CATALOG
    from voxmill.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(CATALOG)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = []
    for name in names:
        try:
            line, same = compare(spark, con, folder, name, CATALOG[name], ORACLE.get(name))
        except Exception as error:  # keep going over the catalog
            line, same = f"{name}: FAILED {type(error).__name__}: {str(error)[:600]}", False
        print(line, flush=True)
        if not same:
            bad.append(name)
    print("bad:", bad)


if __name__ == "__main__":
    main()
