"""Compare registered queries with their SQL oracles: python tests/oracle.py SF_DIR [NAME...]"""

import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[k]) for k in order) for r in rows)


def compare(spark, sf_dir, name, fn, sql):
    """None if equal, else a short description of the difference."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = fn(spark, sf_dir)
    rows = [tuple(r) for r in got.collect()]
    cursor = con.execute(sql)
    want_names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(got.columns) != sorted(want_names):
        return f"columns {sorted(got.columns)} / {sorted(want_names)}"
    a, b = canonical(rows, got.columns), canonical(want, want_names)
    if a == b:
        return None if a else "EMPTY"
    only_a, only_b = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return f"{len(a)} / {len(b)} rows; only Spark {only_a}; only SQL {only_b}"


if __name__ == "__main__":
    sys.path.insert(0, ROOT)
    import __spark_entry__ as entry

    from tracewright.session import build_session

    spark = build_session("oracle", "local[4]", spark__sql__shuffle__partitions="8", spark__driver__memory="4g")
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or oracles:
        began = time.time()
        try:
            said = compare(spark, sys.argv[1], name, queries[name], oracles[name]) or "ok"
        except Exception as e:
            said = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)
    spark.stop()
