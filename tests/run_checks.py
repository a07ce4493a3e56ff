"""Run named queries against their check SQL: python tests/run_checks.py FOLDER [name ...]."""

from __future__ import annotations

import os
import sys
import time
import traceback

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from compare import database, difference  # noqa: E402
from talkmill.session import local_session  # noqa: E402


def main() -> None:
    folder, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session(os.environ.get("BENCH_CPUS", "8")), database(folder)
    checks, failed = oracle_sql(), []
    for name, run in queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            df = run(spark, folder)
            problem = difference(df, con, checks[name]) if name in checks else f"no SQL, {df.count()} rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
            traceback.print_exc(limit=3) if names else None
        good = problem == "" or problem.startswith("no SQL")
        failed += [] if good else [name]
        print(f"{'ok  ' if good else 'FAIL'} {time.time() - started:6.2f}s {name} {problem[:1500]}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
