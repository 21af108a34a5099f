"""Compare registered Spark queries with their DuckDB statements, value by value.

usage: check_oracle.py [--sf sf0.01] [name-prefix ...]
"""

from __future__ import annotations

import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

from shelfsight.plans.catalogue import QUERIES
from shelfsight.session import build_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def plain(value):
    if isinstance(value, Decimal):
        return ("decimal", str(value))
    if isinstance(value, bool) or value is None:
        return (type(value).__name__, value)
    return (type(value).__name__, value if not isinstance(value, list) else tuple(value))


def main(argv: list[str]) -> int:
    sf = "sf0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    folder = f"/root/testdata/{sf}"
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                                                   "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")

    def connect():
        """A connection of its own for every statement: an internal error of one ends all that share it."""
        duck = duckdb.connect()
        for table in TABLES:
            duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
        return duck

    failed = []
    for name, q in QUERIES.items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        try:
            started = time.time()
            df = q(spark, folder)
            columns = sorted(df.columns)
            got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
            spark_s = time.time() - started
            if q.sql is None:
                print(f"rows {name}: {len(got)} rows {spark_s:.2f}s", flush=True)
                continue
            started = time.time()
            cursor = connect().execute(q.sql)
            names = [c[0] for c in cursor.description]
            rows = cursor.fetchall()
            duck_s = time.time() - started
            if sorted(names) != columns:
                raise AssertionError(f"columns {columns} vs {sorted(names)}")
            order = [names.index(c) for c in columns]
            want = [tuple(plain(r[i]) for i in order) for r in rows]
            got.sort(key=repr), want.sort(key=repr)
            if got != want:
                has, needs = set(got), set(want)
                missing = [w for w in want if w not in has][:2]
                extra = [g for g in got if g not in needs][:2]
                raise AssertionError(f"{len(got)} vs {len(want)} rows\n   columns {columns}\n   spark {extra}\n   duck  {missing}")
            print(f"ok   {name}: {len(got)} rows spark {spark_s:.2f}s duck {duck_s:.2f}s", flush=True)
        except Exception as error:  # noqa: BLE001 - a report, every failure is listed
            failed.append(name)
            print(f"FAIL {name}: {str(error)[:1500]}", flush=True)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
