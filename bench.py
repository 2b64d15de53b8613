"""Times every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is fully executed through the ``noop`` sink (the whole plan runs,
nothing is collected to the driver). Training the classifier is timed as
``nb_train`` (the queries then share one trained model). Training and each
query run once cold, then $BENCH_RUNS times (default 3): ``queries`` holds
the warm medians (their sum is ``value``), ``cold`` the first runs. Prints
one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("postlens-bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from postlens.operators import classifier
    from postlens.plans import catalog
    from postlens.sources.testdata import training_words

    def measure(run) -> tuple[float, float]:
        """(first run, median of the next ``runs`` runs)."""
        samples = []
        for _ in range(runs + 1):
            t = time.perf_counter()
            run()
            samples.append(time.perf_counter() - t)
        return round(samples[0], 3), round(statistics.median(samples[1:]), 3)

    cold, timings = {}, {}
    cold["nb_train"], timings["nb_train"] = measure(
        lambda: classifier.train_words(training_words(spark, sf_dir))
    )
    queries = catalog.queries()  # these share one trained model

    errors = {}
    for name, query in queries.items():
        if only and name not in only:
            continue
        try:
            cold[name], timings[name] = measure(
                lambda: query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            )
        except Exception as e:  # keep timing the others; report the failure
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "sum_of_query_medians",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "cold": cold,
                "cold_total": round(sum(cold.values()), 3),
                **({"errors": errors} if errors else {}),
                "sf": float(m.group(1)) if m else sf_dir,
                "cpus": cpus,
                "runs": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
