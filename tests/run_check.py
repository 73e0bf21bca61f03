"""Check queries from the command line: ``python tests/run_check.py [sf] [name ...]``."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
from oracle import check, connect  # noqa: E402
from tidemark.session import local_session  # noqa: E402


def main():
    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    names = args[1:]
    sf = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    con = connect(sf)
    q, o = entry.queries(), entry.oracle_sql()
    bad = 0
    for n, fn in q.items():
        if names and not any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in names):
            continue
        t0 = time.time()
        try:
            if n in o:
                msg, k = check(spark, sf, n, fn, o[n], con)
            else:
                k = len(fn(spark, sf).collect())
                msg = None if k else "no rows"
            tag = "ok  " if msg is None else "FAIL"
            if n not in o:
                tag = "rows"
        except Exception as e:  # noqa: BLE001
            tag, k, msg = "ERR ", 0, str(e).split("JVM stacktrace")[0][:700]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += tag in ("FAIL", "ERR ")
        print(f"{tag} {n:28s} {k:7d} rows {time.time() - t0:6.2f}s (spark {getattr(check, 'spark_sec', 0):5.2f}) {msg or ''}", flush=True)
    print("bad:", bad)


main()
