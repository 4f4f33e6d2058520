"""Command line: python tests/run_oracle.py [sf] [name part ...] runs the matching queries against SQL."""

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle import compare, duck  # noqa: E402

from panelspark.queries import all_queries, all_sql  # noqa: E402
from panelspark.queries import registry  # noqa: E402
from panelspark.session import local_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    registry.MODULES[:] = [m for m in registry.MODULES if (Path(registry.__file__).parent / f"{m}.py").exists()]
    spark, sf_dir = local_session(), f"/root/testdata/sf{sf}"
    con = duck(sf_dir)
    sqls, failed, n = all_sql(), [], 0
    for name, fn in all_queries().items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        n += 1
        start = time.time()
        try:
            if name in sqls:
                bad = compare(spark, con, sf_dir, fn, sqls[name])
            else:
                bad = None if fn(spark, sf_dir).count() else "no rows"
        except Exception as e:  # report and go on
            bad = f"{type(e).__name__}: {str(e)[:600]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        if bad:
            failed.append(name)
        kind = "sql " if name in sqls else "rows"
        print(f"{'FAIL' if bad else 'ok  '} {kind} {time.time() - start:6.2f}s {name}" + (f": {bad}" if bad else ""), flush=True)
    print(f"{n} queries, {len(failed)} failed: {failed}")


main()
