"""Run every registered query against its SQL oracle and print a table.

usage: python check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "tests"))

from oracle import compare, duck  # noqa: E402

from notewise.plans.catalog import load_all  # noqa: E402
from notewise.session import build_session  # noqa: E402


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(sf)
    reg = load_all()
    fails = 0
    for name, e in reg.items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            df = e.fn(spark, sf)
            if e.sql is None:
                n = df.count()
                print(f"{name:32s} ROWS  {n:8d}  {time.time() - t:6.2f}s", flush=True)
                continue
            problems, ns, nd = compare(df, e.sql, con)
            status = "OK  " if not problems else "FAIL"
            fails += bool(problems)
            print(f"{name:32s} {status}  {ns:8d}  {time.time() - t:6.2f}s  {'; '.join(problems)[:400]}", flush=True)
        except Exception as ex:  # report and go on
            fails += 1
            print(f"{name:32s} ERROR {type(ex).__name__}: {str(ex)[:400]}", flush=True)
    print(f"failures: {fails}")
    return 1 if fails else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
