"""Runs registered queries against their SQL: check_queries.py [sf_dir] [name ...]"""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

import __spark_entry__ as entry  # noqa: E402
from compare import difference, duck, spark_rows  # noqa: E402

from crewmetrics.session import build_session  # noqa: E402


def main(sf_dir: str, names: list[str]) -> int:
    spark = build_session(
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": "/tmp/checkpoints/check_queries",
            "spark.log.level": "ERROR",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    con, failed = duck(sf_dir), 0
    oracles = entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        begin = time.time()
        try:
            df = query(spark, sf_dir)
            problem = difference(df, con, oracles[name]) if name in oracles else None
            rows = len(spark_rows(df)[1])
        except Exception as error:  # report and go on with the next query
            problem, rows = f"{type(error).__name__}: {str(error)[:600]}", -1
            if names:
                traceback.print_exc()
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} rows={rows} {time.time() - begin:.1f}s", flush=True)
        if problem:
            print("     ", problem[:900], flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    sys.exit(1 if main(sf, args) else 0)
