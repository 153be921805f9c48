"""Compare registered queries with their SQL: python tests/check.py [folder] [name part ...]"""

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parent.parent)]

import oracle  # noqa: E402

from saleslens import catalog  # noqa: E402
from saleslens.session import local_session  # noqa: E402

if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(folder)
    good = bad = 0
    for name, fn in catalog.QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            problems = oracle.compare(df, con, catalog.SQL[name]) if name in catalog.SQL else []
            note = "" if name in catalog.SQL else f"(rows only: {df.count()})"
        except Exception as e:  # noqa: BLE001
            problems, note = [f"{type(e).__name__}: {str(e)[:600]}"], ""
        good, bad = good + (not problems), bad + bool(problems)
        print(f"{'ok ' if not problems else 'BAD'} {time.time() - start:6.2f}s {name} {note} {problems or ''}", flush=True)
    print(f"{good} good, {bad} bad")
