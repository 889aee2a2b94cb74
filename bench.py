"""Benchmark the catalogue queries.

Runs every catalogue query (the reference's own operators) on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]``: one warm-up pass over the
whole catalogue, then ``$BENCH_REPEATS`` (default 3) timed runs per query,
reporting the median.  Each run executes the full plan into Spark's ``noop``
sink (nothing is collected to the driver).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from pyspark.sql import SparkSession

    from vitaplate.session import ensure_checkpoint_dir

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("vitaplate-bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("VITAPLATE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)

    from vitaplate.functions.ranking import release_materialised
    from vitaplate.plans import catalogue

    qs = catalogue.queries()
    names = [n for n in qs if not only or n in only]

    def run(name: str) -> float:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - t0
        release_materialised(spark)
        return took

    for name in names:  # warm-up: JIT, file listing caches, Python imports
        run(name)
    medians = {}
    for name in names:
        medians[name] = round(statistics.median(run(name) for _ in range(repeats)), 3)
    total = round(sum(medians.values()), 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "catalogue_total_median_sec",
        "value": total,
        "unit": "sec",
        "queries": medians,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": int(cpus),
        "repeats": repeats,
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
