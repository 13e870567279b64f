"""Summarise the physical plan of every registered query as a markdown table.

usage: python scripts/plan_report.py [SF_DIR] > PLANS.md
Counts come from the executed (adaptive) plan after running the query once,
so they show what AQE actually chose.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tokenloom.catalog import QUERIES  # noqa: E402
from tokenloom.session import build_session  # noqa: E402


def summarise(plan: str) -> dict:
    return {
        "shuffle": len(re.findall(r"(?<!Broadcast)Exchange (hashpartitioning|rangepartitioning|"
                                  r"RoundRobinPartitioning|SinglePartition)", plan)),
        "broadcast": len(re.findall(r"BroadcastExchange|BroadcastQueryStage", plan)),
        "bhj": plan.count("BroadcastHashJoin"),
        "smj": plan.count("SortMergeJoin"),
        "python": len(re.findall(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapCoGroupsInPandas|"
                                 r"FlatMapGroupsInPandas", plan)),
        "pushed": "yes" if re.search(r"PushedFilters: \[[^\]]+\]", plan) else "",
        "partition_filters": "yes" if re.search(r"PartitionFilters: \[[^\]]+\]", plan) else "",
        "window": plan.count("Window ["),
        "sort_agg": plan.count("SortAggregate"),
    }


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 8)
    print(f"# Physical plans of the registered queries ({os.path.basename(sf)}, local[8], AQE on)\n")
    print("Generated by `scripts/plan_report.py` from the executed adaptive plan of each key. "
          "`shuffle` counts exchanges (hash, range, round-robin, single); `python` counts Arrow/pandas operators. "
          "Plans of streaming keys show the read-back of their sink.\n")
    print("| key | shuffle | broadcast | BHJ | SMJ | window | python | pushed filters | partition filters |")
    print("|---|---|---|---|---|---|---|---|---|")
    for key in sorted(QUERIES):
        df = QUERIES[key](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarise(plan)
        print(f"| `{key}` | {s['shuffle']} | {s['broadcast']} | {s['bhj']} | {s['smj']} | {s['window']} | "
              f"{s['python']} | {s['pushed']} | {s['partition_filters']} |", flush=True)


if __name__ == "__main__":
    main()
