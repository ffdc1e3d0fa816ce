"""Check registered queries against their oracles: ``python -m tests.run_oracles [sf_dir] [name ...]``."""
from __future__ import annotations

import sys
import time

import __spark_entry__ as e
from tallyflow.session import local_session
from tests.oracle import compare, connect

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark, con = local_session(), connect(sf)
    sql, bad = e.oracle_sql(), 0
    for name, fn in e.queries().items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            found = compare(df, con, sql[name]) if name in sql else f"rows only: {df.count()}"
        except Exception as err:  # report and go on with the next query
            found = f"ERROR {type(err).__name__}: {str(err)[:600]}"
        ok = found is None or found.startswith("rows only")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:26s} {time.time() - t0:6.2f}s {found or ''}", flush=True)
    print("failures:", bad)
    spark.stop()
