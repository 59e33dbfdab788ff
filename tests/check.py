"""Run queries against their SQL from the command line: check.py [sf] [name …]."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry
from oracle import compare, connect

from shelfspark.session import local_session

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    only = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        try:
            rows, took, diff = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            rows, took, diff = 0, 0.0, f"{type(e).__name__}: {str(e)[:900]}"
        bad += diff is not None
        print(f"{'BAD ' if diff else 'ok  '} {name:28s} {rows:8d} {took:6.1f}s {'' if name in sqls else '(rows only)'} {diff or ''}", flush=True)
    print("failed:", bad)
    spark.stop()
