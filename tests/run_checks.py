"""Command line: python tests/run_checks.py [sf] [name ...] — compare named queries with their SQL."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import compare  # noqa: E402

from broadsheet.plans import catalog  # noqa: E402
from broadsheet.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    names = sys.argv[2:] or list(catalog.PLANS)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in catalog.CHECKS:
                problems, rows = compare(spark, f"/root/testdata/sf{sf}", catalog.PLANS[name], catalog.CHECKS[name])
            else:
                problems, rows = [], len(catalog.PLANS[name](spark, f"/root/testdata/sf{sf}").collect())
        except Exception as exc:  # noqa: BLE001
            problems, rows = [f"{type(exc).__name__}: {str(exc)[:600]}"], -1
        bad += bool(problems)
        mark = "FAIL" if problems else ("ok  " if name in catalog.CHECKS else "rows")
        print(f"{mark} {name} rows={rows} {time.time() - start:.1f}s {' '.join(problems)[:1500]}", flush=True)
    print("failed:", bad)
