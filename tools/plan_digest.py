"""Summarise what each catalogue query executed into PLANS.md.

Plans come from Spark's event log (a scratch folder): the last plan of every
SQL execution, which is the adaptive final one, materialised parts included.
For each query: executions (1 plus one per materialised table), shuffles, reused
exchanges, join strategies, windows, Python passes, and the scans of each driver
table with the columns they read.

Usage: python tools/plan_digest.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
from collections import Counter, defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _nodes(info: dict) -> list[tuple[str, str]]:
    """(name, text) of every node of a logged plan."""
    out = [(info["nodeName"], info["simpleString"])]
    for child in info["children"]:
        out += _nodes(child)
    return out


def read_plans(log_dir: str) -> dict[str, list[list[tuple[str, str]]]]:
    """Job description -> nodes of the final plan of each of its executions."""
    label, plans = {}, {}
    for root, _, files in os.walk(log_dir):
        for f in files:
            if f.startswith((".", "appstatus")):
                continue
            with open(os.path.join(root, f)) as log:
                for line in log:
                    e = json.loads(line)
                    if e["Event"].endswith("SparkListenerSQLExecutionStart"):
                        label[e["executionId"]] = e.get("description", "")
                    if "sparkPlanInfo" in e:  # at the start, and at every adaptive change
                        plans[e["executionId"]] = _nodes(e["sparkPlanInfo"])
    out = defaultdict(list)
    for k in sorted(plans):
        out[label.get(k, "")].append(plans[k])
    return out


def digest(executions: list[list[tuple[str, str]]]) -> str:
    """One table row's cells."""
    names: Counter = Counter()
    scans = defaultdict(list)
    for nodes in executions:
        for name, text in nodes:
            names[re.sub(r" \(\d+\)| parquet.*", "", name).strip()] += 1
            m = re.search(r"FileScan parquet \[([^\]]*)\].*Location: \w+(?:\(\d+ paths\))?\[[^\],]*/(\w+)\.parquet", text)
            if m:
                scans[m[2]].append(sorted(c.split("#")[0] for c in m[1].split(",") if c))
    python = sum(n for k, n in names.items() if re.search("Pandas|Arrow|Python", k))
    read = "; ".join(f"{t} x{len(c)}: {', '.join(sorted(set().union(*c)))}" for t, c in sorted(scans.items()))
    return (f"{len(executions)} | {names['Exchange']} ({names['ReusedExchange']}) | {names['BroadcastHashJoin']} | {names['SortMergeJoin']} "
            f"| {names['Window']} ({names['WindowGroupLimit']}) | {names['SortAggregate']} | {python} | {read}")


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    log_dir = tempfile.mkdtemp(prefix="vitaplate-eventlog-")
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").appName("vitaplate-plans").config("spark.sql.shuffle.partitions", "8")
        .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
        .config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false")
        .config("spark.sql.maxMetadataStringLength", "4000").config("spark.sql.debug.maxToStringFields", "500")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from vitaplate.plans import catalogue

    queries = catalogue.queries()
    for name, q in queries.items():
        spark.sparkContext.setJobDescription(name)
        q(spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.stop()
    plans = read_plans(log_dir)
    print("# Plan digest\n")
    print(f"What every catalogue query executed on `{os.path.basename(sf_dir)}` (local[8], 8 shuffle partitions), from the event log by")
    print("`tools/plan_digest.py`: the final adaptive plans of all its executions (each materialised table is one).")
    print("Scans of the driver tables are counted; a reused exchange spares its scan.\n")
    print("| query | executions | shuffles (reused) | broadcast joins | sort-merge joins | windows (group-limited) | sort aggregates | Python passes | scans |")
    print("|---|---|---|---|---|---|---|---|---|")
    for name in queries:
        print(f"| {name} | {digest(plans[name])} |")


if __name__ == "__main__":
    main()
