"""Compare every registered query with its SQL: ``python tests/check_queries.py [sf_dir] [name ...]``."""

import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

import __spark_entry__ as entry  # noqa: E402
from oracle import connect, difference  # noqa: E402

from crivo.session import local_session  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles, failed = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            if name in oracles:
                found = difference(spark, con, fn, oracles[name], sf_dir)
            else:
                found = None if fn(spark, sf_dir).count() >= 0 else "no rows"
        except Exception as error:  # noqa: BLE001
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += found is not None
        note = "" if name in oracles else " (rows only)"
        print(f"{'ok  ' if found is None else 'FAIL'} {name}{note} {time.time() - start:.1f}s {found or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
