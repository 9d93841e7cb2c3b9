"""Command line: python tests/check_queries.py [sf folder] [query ...] [@module ...]"""
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
from clustrum.session import build_session  # noqa: E402
from oracle import connect, differences  # noqa: E402


def main(sf: str, wanted: list[str]) -> int:
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    connection, bad = connect(sf), 0
    for name, query in queries.items():
        module = query.__module__.rsplit(".", 1)[-1]
        if wanted and name not in wanted and f"@{module}" not in wanted:
            continue
        start = time.time()
        try:
            df = query(spark, sf)
            problems = differences(df, oracles[name], connection) if name in oracles else []
            note = "ok" if name in oracles else f"rows only: {df.count()}"
        except Exception as error:  # noqa: BLE001
            problems = [traceback.format_exc(limit=-3) if os.environ.get("TRACE") else str(error)[:600]]
        seconds = time.time() - start
        bad += bool(problems)
        print(f"{'FAIL' if problems else note:>10} {seconds:6.1f}s {name} {' | '.join(problems)[:900]}", flush=True)
    print("failed:", bad, "unknown oracles:", sorted(set(oracles) - set(queries)))
    return bad


if __name__ == "__main__":
    arguments = sys.argv[1:]
    folder = arguments.pop(0) if arguments and arguments[0].startswith("/") else "/root/testdata/sf0.01"
    sys.exit(1 if main(folder, arguments) else 0)
