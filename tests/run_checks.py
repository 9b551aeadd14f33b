"""Check named queries against their SQL: ``python tests/run_checks.py [sf] [name ...]``."""

import os
import sys
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from newsflow.plans.catalog import QUERIES  # noqa: E402
from newsflow.session import local_session  # noqa: E402
from tests.compare import compare, connect  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(QUERIES)
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    con = connect(sf_dir)
    bad = 0
    for name in names:
        q = QUERIES[name]
        try:
            if q.sql is None:
                print(f"rows {name}: {q.build(spark, sf_dir).count()}", flush=True)
                continue
            r = compare(spark, sf_dir, q.build, q.sql, con)
            ok = not r["problems"]
            print(("ok   " if ok else "BAD  ") + f"{name}: {r['rows']} rows, spark {r['spark']}s, sql {r['sql']}s", flush=True)
        except Exception as e:  # noqa: BLE001
            ok, r = False, {"problems": [str(e)[:1500]]}
            print(f"FAIL {name}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
        if not ok:
            bad += 1
            for p in r["problems"]:
                print("      ", p, flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
