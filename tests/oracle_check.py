"""Compare registered Spark queries with their DuckDB twins (row count, schema, values).

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gatelens.sources.tables import TABLES  # noqa: E402

SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
                 "float": "FLOAT", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
                 "date": "DATE", "smallint": "SMALLINT", "tinyint": "TINYINT"}


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if os.environ.get("CHECK_EXACT"):
            return repr(v + 0.0)
        return repr(round(v, 9) + 0.0)
    return repr(v)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    rel = con.sql(sql)
    d_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    d_rows = rel.fetchall()
    problems = []
    if sorted(s_types) != sorted(d_types):
        problems.append(f"columns spark={sorted(s_types)} duck={sorted(d_types)}")
    else:
        bad = {c: (s_types[c], d_types[c]) for c in s_types if s_types[c] != d_types[c]}
        if bad:
            problems.append(f"types {bad}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
    if not problems:
        scols = [f.name for f in sdf.schema.fields]
        order = sorted(scols)
        si = [scols.index(c) for c in order]
        di = [rel.columns.index(c) for c in order]
        a = sorted(tuple(_norm(r[i]) for i in si) for r in s_rows)
        b = sorted(tuple(_norm(r[i]) for i in di) for r in d_rows)
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        if diff:
            problems.append(f"values differ in {len(diff)} rows, e.g. spark={diff[0][0]} duck={diff[0][1]} cols={order}")
    return problems, len(s_rows), t1 - t0


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    from gatelens.session import local_session
    import __spark_entry__ as E
    spark = local_session(8)
    if os.environ.get("CHECK_PARTITIONS"):
        spark.conf.set("spark.sql.shuffle.partitions", os.environ["CHECK_PARTITIONS"])
    if os.environ.get("CHECK_AQE"):
        spark.conf.set("spark.sql.adaptive.enabled", os.environ["CHECK_AQE"])
    if os.environ.get("CHECK_ANSI"):
        spark.conf.set("spark.sql.ansi.enabled", os.environ["CHECK_ANSI"])
    if os.environ.get("CHECK_TZ"):
        spark.conf.set("spark.sql.session.timeZone", os.environ["CHECK_TZ"])
    con = duck(sf_dir)
    qs, os_ = E.queries(), E.oracle_sql()
    names = names or list(qs)
    failed = 0
    for n in names:
        if n not in os_:
            df = qs[n](spark, sf_dir)
            print(f"ROWS-ONLY {n}: {df.count()} rows", flush=True)
            continue
        try:
            probs, nrows, dt = compare(spark, con, n, qs[n], os_[n], sf_dir)
        except Exception as e:  # noqa: BLE001
            probs, nrows, dt = [f"error {type(e).__name__}: {str(e)[:600]}"], -1, 0
        status = "OK  " if not probs else "FAIL"
        failed += bool(probs)
        print(f"{status} {n} rows={nrows} {dt:.1f}s {'; '.join(probs)}", flush=True)
    print(f"{len(names) - failed}/{len(names)} ok")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
