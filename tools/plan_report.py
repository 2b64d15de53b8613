"""Physical-plan summary of every registered query.

    python tools/plan_report.py [sf_dir] [--no-broadcast] > PLANS.md

For each query: the operator tree (formatted explain, tree part only), the
number of shuffles, broadcasts and sort-merge joins, and each scan's read
schema and pushed filters. ``--no-broadcast`` sets
``spark.sql.autoBroadcastJoinThreshold=-1`` so the joins plan as they would
on inputs too large to broadcast.
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def summarize(name: str, plan: str) -> str:
    tree = plan.split("\n\n")[0].replace("== Physical Plan ==\n", "")
    exchanges = len(re.findall(r"^\(\d+\) Exchange", plan, re.M))
    broadcasts = len(re.findall(r"^\(\d+\) BroadcastExchange", plan, re.M))
    smj = len(re.findall(r"^\(\d+\) SortMergeJoin", plan, re.M))
    scans = re.findall(
        r"^\(\d+\) Scan (\w+) \n(?:.*\n)*?Location: \w+ \[([^\]]*)\]\n(?:PushedFilters: (.*)\n)?ReadSchema: (.*)$",
        plan, re.M)
    lines = [f"### {name}", "", f"shuffles: {exchanges}, broadcasts: {broadcasts}, sort-merge joins: {smj}", "",
             "```", tree.rstrip(), "```", ""]
    for fmt, loc, pushed, schema in scans:
        lines.append(f"- scan `{os.path.basename(loc)}`: pushed `{pushed or '[]'}`, read `{schema}`")
    return "\n".join(lines) + "\n"


def main(argv: list[str]) -> None:
    from pyspark.sql import SparkSession

    no_bc = "--no-broadcast" in argv
    args = [a for a in argv if not a.startswith("--")]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    builder = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
               .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false"))
    if no_bc:
        builder = builder.config("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from postlens.plans import catalog

    mode = "broadcast disabled (large-input join strategy)" if no_bc else "default thresholds"
    print(f"# Physical plans ({os.path.basename(sf_dir)}, {mode})\n")
    for name, q in catalog.queries().items():
        df = q(spark, sf_dir)
        plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        print(summarize(name, plan))


if __name__ == "__main__":
    main(sys.argv[1:])
