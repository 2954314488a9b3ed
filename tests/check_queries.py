"""Command line: python -m tests.check_queries [name ...] at $SF_DIR."""

import os
import sys
import traceback

import __spark_entry__ as entry
from pitrank.session import build_session
from tests.compare import compare, duck

if __name__ == "__main__":
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, fns = duck(sf), entry.oracle_sql(), entry.queries()
    bad = 0
    for name in sys.argv[1:] or list(fns):
        try:
            if name in sqls:
                ok, msg = compare(spark, con, sf, name, fns[name], sqls[name])
            else:
                n = len(fns[name](spark, sf).collect())
                ok, msg = True, f"{name}: {n} rows (no SQL)"
        except Exception as e:
            ok, msg = False, f"{name}: {type(e).__name__} {str(e)[:1500]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += not ok
        print("ok  " if ok else "FAIL", msg, flush=True)
    print("failures", bad)
