"""List plan properties that would not hold at scale: product joins, Python rows, single-partition windows.

usage: check_plans.py [name-prefix ...]
"""

from __future__ import annotations

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from shelfsight.plans.catalogue import QUERIES
from shelfsight.session import build_session

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas")


def findings(plan: str) -> list[str]:
    found = [node for node in FORBIDDEN if node in plan]
    lonely = [w for w in re.findall(r"Window \[.*", plan) if re.search(r"windowspecdefinition\((?!\S*#\d+L?, )", w)]
    return found + (["global window"] if lonely else [])


def main(prefixes: list[str]) -> int:
    spark = build_session("plans", "local[4]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    for name, q in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        plan = q(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        shuffles, sorts = plan.count("Exchange hashpartitioning"), plan.count("SortAggregate")
        limited = plan.count("WindowGroupLimit")
        print(f"{name}: shuffles {shuffles} sort-aggregates {sorts} group-limits {limited} {findings(plan)}", flush=True)
    return 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
