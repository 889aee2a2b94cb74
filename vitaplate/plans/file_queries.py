"""Queries that start from files: each exports driver tables in a raw form and reads them with the library's sources.

The exports go to new folders under the shared checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaplate.operators import transitions as TR
from vitaplate.plans import surrogates as S
from vitaplate.plans.output import rounded
from vitaplate.plans.workflows import objects_from_exports
from vitaplate.session import ensure_checkpoint_dir
from vitaplate.sources import files


def _folder(spark: SparkSession, label: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/export-{label}-{uuid.uuid4().hex}"


def export_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1-S5 + U2 + P1-P6: objects exported as sheets of three layouts, read back cleaned and typed."""
    root = _folder(spark, "sheets")
    for sheets in S.raw_sheets(spark, sf_dir):
        files.write_experiments(sheets, root)
    return rounded(objects_from_exports(spark, root, all_types=True))


def tracked_file_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 + P9-P12 + P14 + T3 + T1: transition links from a raw Latin-1 table of tracked objects."""
    path = _folder(spark, "tracked")
    S.tracked_raw(spark, sf_dir).write.option("header", True).option("encoding", "ISO-8859-1").option("nullValue", files.MISSING).csv(path)
    return TR.link_table(TR.tracked_cohort(TR.prepare_tracked(files.read_tracked(spark, path))))


def plate_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four plate layout files of four blocks each to one typed row per well."""
    root = _folder(spark, "plates")
    lines = S.plate_lines(spark, sf_dir).repartition("plate").sortWithinPartitions("plate", "ln").select("plate", "value")
    lines.write.partitionBy("plate").text(root)
    wells = files.read_plate_files(spark, f"{root}/*/*.txt", blocks=("Compound", "Concentration", "Signal", "Vectors"))
    plate = F.regexp_extract("file", r"plate=(\d+)", 1).cast("int").alias("plate")
    return rounded(wells.select(plate, "well", *[F.col(c).alias(c.lower()) for c in ("Compound", "Concentration", "Signal", "Vectors")]))


def partitioned_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plates written by plate and day, one plate written again; the others stay, and a filter reads its folders only."""
    path = _folder(spark, "partitioned")
    plates = S.plates(spark, sf_dir).select("plate", "day", "compound", "signal")
    files.write_partitioned(plates, path, by=("plate", "day"))
    again = plates.where(F.col("plate") == "F3").withColumn("signal", F.col("signal") * 2)
    files.write_partitioned(again, path, by=("plate", "day"))
    read = spark.read.parquet(path).where(F.col("plate").isin("F3", "O1"))
    return rounded(read.groupBy("plate", "day").agg(F.count(F.lit(1)).alias("n"), F.avg("signal").alias("mean_signal")))


QUERIES = {
    "export_objects": export_objects,
    "tracked_file_links": tracked_file_links,
    "plate_layouts": plate_layouts,
    "partitioned_replace": partitioned_replace,
}
