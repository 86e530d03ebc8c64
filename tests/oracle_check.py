"""Run queries against their SQL: python tests/oracle_check.py [prefix ...]."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(0.0 if v == 0 else round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql):
    """(ok, message) for one query against its SQL."""
    got_names = spark_df.columns
    got = rows_of(got_names, [tuple(r) for r in spark_df.collect()])
    t0 = time.time()
    rel = con.execute(sql)
    want_names = [d[0] for d in rel.description]
    want = rows_of(want_names, rel.fetchall())
    sql_s = time.time() - t0
    if sorted(got_names) != sorted(want_names):
        return False, f"columns {sorted(got_names)} != {sorted(want_names)}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return False, f"{len(bad)}/{len(got)} rows differ, first:\n  cols  {sorted(got_names)}\n  spark {bad[0][0]}\n  sql   {bad[0][1]}"
    return True, f"{len(got)} rows (sql {sql_s:.1f}s)"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    wanted = [q for q in qs if not sys.argv[1:] or any(q.startswith(p) for p in sys.argv[1:])]
    fails = 0
    for name in wanted:
        t0 = time.time()
        try:
            df = qs[name](spark, sf)
            if name in sqls:
                ok, msg = compare(df, con, sqls[name])
            else:
                n = len(df.collect())
                ok, msg = n > 0, f"{n} rows (rows only)"
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {str(e)[:1500]}"
        fails += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t0:.1f}s {msg}", flush=True)
    print(f"{len(wanted) - fails}/{len(wanted)} passed")
