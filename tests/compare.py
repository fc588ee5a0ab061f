"""Run registered queries against their DuckDB check on the given tables."""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return f"{type(v).__name__}:{v}"
    if isinstance(v, float):
        return "float:" + repr(v)
    if isinstance(v, (decimal.Decimal, datetime.date, datetime.datetime)):
        return f"{type(v).__name__}:{v}"
    return f"{type(v).__name__}:{v!r}"


KIND = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
        "date": "DATE", "float": "FLOAT"}


def compare(spark, sf_dir, fn, sql, con):
    """Return a list of differences (empty when equal) and the row count."""
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    rows = sorted(tuple(norm(r[c]) for c in cols) for r in (x.asDict(recursive=True) for x in df.collect()))
    if sql is None:
        return [], len(rows)
    rel = con.sql(sql)
    out = []
    if sorted(rel.columns) != cols:
        return [f"columns {cols} != {sorted(rel.columns)}"], len(rows)
    types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for f in df.schema:
        want = KIND.get(f.dataType.simpleString())
        if want and want != types[f.name]:
            out.append(f"type {f.name}: {f.dataType.simpleString()} != {types[f.name]}")
    pos = [rel.columns.index(c) for c in cols]
    other = sorted(tuple(norm(r[p]) for p in pos) for r in rel.fetchall())
    if len(rows) != len(other):
        out.append(f"rows {len(rows)} != {len(other)}")
    if rows != other:
        left, right = set(rows), set(other)
        a = [r for r in rows if r not in right]
        b = [r for r in other if r not in left]
        out.append(f"values differ: {len(a)}/{len(b)} of {len(rows)}")
        for x, y in list(zip(a, b))[:2]:
            for c, p, q in zip(cols, x, y):
                if p != q:
                    out.append(f"   {c}: spark {p} duckdb {q} | {x[:3]}")
    if not rows:
        out.append("no rows")
    return out, len(rows)


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master(f"local[{cores}]").appName("faultscope-tests")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), connect(sf_dir)
    checks, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        t = time.time()
        try:
            diffs, n = compare(spark, sf_dir, fn, checks.get(name), con)
        except Exception as e:  # noqa: BLE001 - report and go on
            diffs, n = [f"{type(e).__name__}: {str(e)[:700]}"], -1
        bad += bool(diffs)
        print(f"{'FAIL' if diffs else 'ok  '} {name} rows={n} {'sql' if name in checks else 'rows-only'} {time.time() - t:.1f}s",
              flush=True)
        for d in diffs:
            print("     ", d, flush=True)
    print("failed:", bad)
