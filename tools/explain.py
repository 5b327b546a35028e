"""Print ``explain("formatted")`` of registered queries.

Usage: python tools/explain.py [sf_dir] name [name ...]
Also prints a one-line census per query: exchanges, sort-based and object
aggregates, broadcasts, Python evaluation nodes, and the columns each scan reads.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def census(plan: str) -> dict:
    return {
        "exchanges": plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning"),
        "broadcasts": plan.count("BroadcastExchange"),
        "sort_aggregates": plan.count("SortAggregate"),
        "object_aggregates": plan.count("ObjectHashAggregate"),
        "python": plan.count("EvalPython") + plan.count("InPandas"),
        "scans": re.findall(r"ReadSchema: (\S+)", plan),
    }


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    from estimark.plans.catalog import QUERIES
    from estimark.session import get_session
    spark = get_session()
    for n in names:
        df = QUERIES[n](spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"== {n}: {census(plan)}")
        df.explain("formatted")


if __name__ == "__main__":
    main()
