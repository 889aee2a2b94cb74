"""Skew check: operators on inputs where one key holds a third of all rows.

Inputs are derived from the driver tables (lineitem, events) by sending every
third row to one hot key.  Each operator runs once with Spark's event log
written to a fresh scratch folder; for every stage that reads shuffle data the
report gives the largest and the median number of records a task read, and
the hot key's share of the input.  Usage:

    python tools/skew_report.py [sf_dir]
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def _read_log(log_dir: str) -> tuple[dict[int, str], dict[int, list[int]]]:
    """(stage -> job description, stage -> shuffle records read per task) from an event log."""
    stage_case: dict[int, str] = {}
    reads: dict[int, list[int]] = {}
    for root, _, files in os.walk(log_dir):
        for f in files:
            if f.startswith(".") or f.startswith("appstatus"):
                continue
            with open(os.path.join(root, f)) as fh:
                for line in fh:
                    ev = json.loads(line)
                    kind = ev.get("Event")
                    if kind == "SparkListenerJobStart":
                        desc = (ev.get("Properties") or {}).get("spark.job.description")
                        if desc:
                            for sid in ev.get("Stage IDs", []):
                                stage_case[sid] = desc
                    elif kind == "SparkListenerTaskEnd":
                        m = (ev.get("Task Metrics") or {}).get("Shuffle Read Metrics") or {}
                        reads.setdefault(ev["Stage ID"], []).append(m.get("Total Records Read", 0))
    return stage_case, reads


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="vitaplate-eventlog-")
    spark = (
        SparkSession.builder.master("local[8]").appName("vitaplate-skew")
        .config("spark.sql.shuffle.partitions", "16")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keep task counts comparable
        .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
        .config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from vitaplate.functions.ranking import sequence_index
    from vitaplate.operators import clean as C
    from vitaplate.operators import compare as M
    from vitaplate.operators import wells as W
    from vitaplate.plans import surrogates as S

    objects = S.objects(spark, sf_dir)
    hot = F.col("object_no") % 3 == 0  # every third object goes to the hot key
    hot_wells = objects.withColumns({"patient": F.when(hot, "HOT").otherwise(F.col("patient")),
                                     "plate_row": F.when(hot, F.lit(0)).otherwise(F.col("plate_row")),
                                     "plate_col": F.when(hot, F.lit(1)).otherwise(F.col("plate_col")),
                                     "exp_id": F.when(hot, "E0").otherwise(F.col("exp_id")),
                                     "day": F.when(hot, F.lit(1)).otherwise(F.col("day")),
                                     "compound": F.when(hot, "Media").otherwise(F.col("compound"))})
    vd = S.vd_side(spark, sf_dir)
    hot_uid = vd.withColumn("uid", F.when(F.col("quantity") <= 17, F.lit("HOT")).otherwise(F.col("uid")))
    long = objects.select(F.when(hot, "HOT").otherwise(F.col("patient")).alias("g"), F.col("region_intensity").alias("v"))
    votes = objects.select(F.lit("q").alias("variable"),
                           F.when(hot, "HOT").otherwise(F.col("object_no").cast("string")).alias("value"))

    cases = {
        "well_measurements (objects -> wells)": lambda: W.well_measurements(W.with_well_key(hot_wells)),
        "unique_by (F9 on a repeated key)": lambda: C.unique_by(hot_uid, "uid")[0],
        "majority_long (A7 mode)": lambda: M.majority_long(votes),
        "sequence_index (range path)": lambda: sequence_index(long, ["v"], groups=["g"], name="i"),
        "contrast: row_number() window per group": lambda: long.withColumn(
            "i", F.row_number().over(Window.partitionBy("g").orderBy("v"))),
    }
    share = {
        "well_measurements (objects -> wells)": hot_wells.select(F.avg((F.col("patient") == "HOT").cast("int"))).first()[0],
        "unique_by (F9 on a repeated key)": hot_uid.select(F.avg((F.col("uid") == "HOT").cast("int"))).first()[0],
        "majority_long (A7 mode)": votes.select(F.avg((F.col("value") == "HOT").cast("int"))).first()[0],
        "sequence_index (range path)": long.select(F.avg((F.col("g") == "HOT").cast("int"))).first()[0],
    }
    share["contrast: row_number() window per group"] = share["sequence_index (range path)"]
    for name, make in cases.items():
        spark.sparkContext.setJobDescription(name)
        make().write.format("noop").mode("overwrite").save()
    spark.sparkContext.setJobDescription(None)
    spark.stop()
    stage_case, reads = _read_log(log_dir)
    results = []
    for sid in sorted(reads):
        r = reads[sid]
        if sid in stage_case and sum(r) > 0:
            results.append((stage_case[sid], sid, len(r), sum(r), max(r), statistics.median(r)))
    print("| operator | hot key share | stage | tasks | records read | busiest task | median task |")
    print("|---|---|---|---|---|---|---|")
    for name, s, n, tot, mx, med in results:
        print(f"| {name} | {share[name]:.2f} | {s} | {n} | {tot} | {mx} | {med:.0f} |")


if __name__ == "__main__":
    main()
