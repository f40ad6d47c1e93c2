"""Physical-plan summary of every registered query of the reference part (writes PLANS.md).

Usage: python tests/plan_report.py [sf_dir]
Spark's event log gives the final (adaptive) plan of every job that a query runs, landed parts included.
"""
from __future__ import annotations

import json
import os
import re
import sys
import tempfile
from collections import Counter
from pathlib import Path

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KINDS = {
    "exchanges": r"^Exchange$", "single": r"^Exchange SinglePartition", "broadcasts": r"^BroadcastExchange", "sort-merge joins": r"^SortMergeJoin",
    "broadcast joins": r"^BroadcastHashJoin", "windows": r"^Window$", "window group limits": r"^WindowGroupLimit", "python stages": r"Python|Pandas|Arrow",
}


def nodes(plan: dict):
    name = plan["nodeName"].split(" (")[0]
    yield name
    if name == "Exchange" and "SinglePartition" in plan["simpleString"]:
        yield "Exchange SinglePartition"
    for child in plan["children"]:
        yield from nodes(child)


class PlanLog:
    """The final plans of the SQL executions since the last look into the event log."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder, self.seen = spark, folder, set()

    def take(self) -> list[dict]:
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found: dict[int, dict] = {}
        for path in Path(self.folder).iterdir():
            for line in path.open(errors="replace"):
                if '"sparkPlanInfo"' in line and line.endswith("\n"):
                    e = json.loads(line)
                    found[e["executionId"]] = e["sparkPlanInfo"]
        new = {k: v for k, v in found.items() if k not in self.seen}
        self.seen |= set(found)
        return list(new.values())


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from pyspark.sql import SparkSession

    from weft.plans import catalog
    from weft.session import local_session

    folder = tempfile.mkdtemp(prefix="weft-events-")
    conf = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{folder}", "spark.eventLog.buffer.kb": "1k",
            "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    spark = local_session(8, 8)
    spark.sparkContext.setLogLevel("ERROR")
    log = PlanLog(spark, folder)
    lines = ["# Physical plans of the registered queries", "",
             f"Generated by `python tests/plan_report.py {os.path.basename(sf_dir.rstrip('/'))}` (local[8], 8 shuffle partitions, AQE on) from Spark's event log: for each",
             "query the sum over all the jobs that it runs, those included whose results are landed and read back (model answers,",
             "state, written inputs). `single` counts exchanges to one partition: only global aggregates and small tables of",
             "counts have them.", "", "| query | jobs | " + " | ".join(KINDS) + " |", "|---" * (len(KINDS) + 2) + "|"]
    for name, fn in catalog.QUERIES.items():
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        plans = log.take()
        count = Counter(n for p in plans for n in nodes(p))
        sums = [sum(v for k, v in count.items() if re.search(kind, k)) for kind in KINDS.values()]
        lines.append(f"| `{name}` | {len(plans)} | " + " | ".join(str(x or "") for x in sums) + " |")
    out = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    Path(out).write_text("\n".join(lines) + "\n")
    print(f"wrote {len(lines)} lines")


if __name__ == "__main__":
    main()
