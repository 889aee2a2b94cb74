"""File sources and sinks: experiment folders (S1-S5), survey CSV (S6), tracked-object CSV (S7),
plate grids (S8) and the partitioned Parquet sink (S9).

Workbooks are read from their CSV (or Parquet) export: one folder per
experiment named like the workbook, one file per sheet named
``D<day>_<Live|Dead>``; a sheet may also be a folder of that name with part
files in it, as Spark writes them, and folders may be called ``<column>=<name>``.
File listing goes through Hadoop's FileSystem; headers and rows are read by Spark.
"""

from __future__ import annotations

import csv
from functools import reduce
from typing import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaplate.functions.names import quoted, strip_call_words, strip_leading_dash, survey_header, syntactic_name, unique_names
from vitaplate.operators.clean import infer_numeric, missing_text

# Spark's error classes of schemas that do not merge.
UNMERGEABLE = ("CANNOT_MERGE", "INCOMPATIBLE_DATA_TYPE")
# Text that the readers take for a missing value.
MISSING = "NA"

# Sheet name layout "D<day>_<call>".
SHEET_PATTERN = r"^D(\d+)_([^_/]+)$"


def file_path() -> Column:
    """The scanned file's path, decoded (Spark reports it URI-encoded: a space is "%20").

    A literal "+" is escaped first, since URL decoding would read it as a space.
    """
    return F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Glob through Hadoop's FileSystem (works for local, HDFS and object stores)."""
    fs, p = _fs(spark, pattern)
    statuses = fs.globStatus(p) or []
    return sorted(str(s.getPath().toString()) for s in statuses if s.isFile())


def first_line(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    """The header line of one text file."""
    jvm = spark.sparkContext._jvm
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, encoding))
        line = reader.readLine()
    finally:
        stream.close()
    return (line or "").lstrip("﻿")


def sheet_layouts(spark: SparkSession, files: list[str], encoding: str = "UTF-8") -> dict[str, list[str]]:
    """Header line to the files that have it, read in tasks.

    The first line of a file is that of its first block; the least row number of
    the block is a partial aggregate, and files are grouped by header before
    anything comes to the driver: one row per layout, with its part of the listing.
    """
    lines = spark.read.option("encoding", encoding).text(files)
    heads = lines.where(F.col("_metadata.file_block_start") == 0).select(file_path().alias("path"), "value", F.monotonically_increasing_id().alias("at"))
    first = heads.groupBy("path").agg(F.min_by("value", "at").alias("header"))
    layouts = first.groupBy(F.ltrim(F.col("header"), F.lit("\ufeff")).alias("header")).agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return {r.header: r.paths for r in layouts.orderBy("header").collect()}


def header_names(line: str) -> list[str]:
    """The cells of a CSV header line."""
    return next(csv.reader([line]), [])


def _normalise_headers(df: DataFrame) -> DataFrame:
    """Drop Live/Dead words and a leading "- " from every header."""
    return df.toDF(*[strip_leading_dash(strip_call_words(c)) for c in df.columns])


def read_experiments(spark: SparkSession, root: str, fmt: str = "csv") -> DataFrame:
    """Every sheet of every experiment as one table of text columns, plus ExpID, Day and LD.

    Files whose header differs are read separately (a CSV reader maps columns
    by position), then bound by name with missing columns as NULL.  CSV columns
    stay text (S4); type them with :func:`vitaplate.operators.clean.infer_numeric`.
    """
    files = list_files(spark, f"{root.rstrip('/')}/*/*.{fmt}") + list_files(spark, f"{root.rstrip('/')}/*/*/*.{fmt}")
    if not files:
        raise FileNotFoundError(f"no {fmt} sheets under {root}")
    if fmt == "csv":
        parts = []
        for header, fs in sheet_layouts(spark, files).items():
            names = unique_names(header_names(header))
            schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
            one = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("nullValue", MISSING).csv(fs)
            parts.append(_normalise_headers(one).withColumn("_path", file_path()))
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    else:
        try:
            df = _normalise_headers(spark.read.option("mergeSchema", True).parquet(*files))
            df.schema  # noqa: B018 - forces the schema merge now
            df = df.withColumn("_path", file_path())
        except (PySparkException, Py4JJavaError) as e:
            # a column that is all-missing (null type) or text in one sheet; anything else is an error
            if not any(w in str(e) for w in UNMERGEABLE):
                raise
            by_schema: dict[str, list[str]] = {}
            for f in files:
                by_schema.setdefault(spark.read.parquet(f).schema.json(), []).append(f)
            parts = []
            for fs in by_schema.values():  # text (S4) bound by name, one branch per layout
                one = _normalise_headers(spark.read.parquet(*fs))
                parts.append(one.select(*[quoted(c).cast("string").alias(c) for c in one.columns]).withColumn("_path", file_path()))
            df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    # a sheet is a file, or the folder a part file is in; its experiment is the folder above
    steps = F.split(F.regexp_replace("_path", r"\.[^./]+$", ""), "/")
    step = lambda i: F.regexp_replace(F.try_element_at(steps, F.lit(i)), "^[^=]*=", "")
    in_folder = step(-2).rlike(SHEET_PATTERN)
    sheet = F.when(in_folder, step(-2)).otherwise(step(-1))
    return df.withColumns({
        "ExpID": F.when(in_folder, step(-3)).otherwise(step(-2)),                  # S2
        "Day": F.regexp_extract(sheet, SHEET_PATTERN, 1).try_cast(T.IntegerType()),  # S3
        "LD": F.regexp_extract(sheet, SHEET_PATTERN, 2),
    }).drop("_path")


def write_experiments(df: DataFrame, root: str, experiment: str = "ExpID", day: str = "Day", ld: str = "LD") -> None:
    """The inverse of S1-S4: one folder per experiment, in it one folder ``D<day>_<call>`` of CSV parts per sheet.

    Missing cells print "NA".  Sheets are appended, so tables of other layouts can join the same experiments.
    Rows are brought together by sheet in tasks of even size, so a large sheet has several parts.
    """
    sheet = F.concat(F.lit("D"), quoted(day).cast("string"), F.lit("_"), quoted(ld))
    rows = df.withColumns({"ExpID": quoted(experiment), "sheet": sheet}).drop(*{experiment, day, ld} - {"ExpID"})
    rows.hint("rebalance", F.col("ExpID"), F.col("sheet")).write.mode("append").partitionBy("ExpID", "sheet").option("header", True).option("nullValue", MISSING).csv(root)


def _read_typed(spark: SparkSession, path: str, encoding: str, schema: T.StructType | None, rename) -> DataFrame:
    """A CSV table with "NA" missing; the header's names pass through ``rename`` by position.

    Types are inferred by a pass over the data unless ``schema`` gives them.
    """
    reader = spark.read.option("header", True).option("nullValue", MISSING).option("encoding", encoding)
    if schema is not None:
        return reader.schema(schema).csv(path)
    found = list_files(spark, path) or list_files(spark, f"{path.rstrip('/')}/*.csv")
    return reader.option("inferSchema", True).csv(path).toDF(*rename(header_names(first_line(spark, found[0], encoding))))


def read_survey(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """S6 + P9: survey CSV with inferred types; headers made syntactic and unique, then shortened."""
    return _read_typed(spark, path, "UTF-8", schema, lambda names: unique_names(
        [survey_header(n) for n in unique_names([syntactic_name(n) for n in names])]))


def read_tracked(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Latin-1 CSV with inferred types and syntactic, unique headers (non-name characters -> dots)."""
    return _read_typed(spark, path, "ISO-8859-1", schema, lambda names: unique_names([syntactic_name(n) for n in names]))


def well_id(row: Column, number: Column) -> Column:
    """Row label and column number of two digits at least ("A01", "A120")."""
    text = number.cast("string")
    return F.concat(row.cast("string"), F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text))


def plate_wells(grid: DataFrame, row: str, value: str = "value", columns: Sequence[str] | None = None) -> DataFrame:
    """A wide plate grid (one row per plate row, one column per plate column) to one row per well.

    Well id = row label + two-digit column ("A01").  Blank cells stay as NULL values.
    """
    cols = list(columns) if columns is not None else [c for c in grid.columns if c != row]
    long = grid.select(row, *[quoted(c).cast("double").alias(c) for c in cols]).unpivot(
        [row], cols, "_col", value)
    col_no = F.col("_col").cast("int")
    return long.select(
        well_id(F.col(row), col_no).alias("well"),
        F.col(row).alias("plate_row"),
        col_no.alias("plate_col"),
        F.col(value),
    )


def read_plate_files(spark: SparkSession, path: str, blocks: Sequence[str] | None = None, typed: bool = True) -> DataFrame:
    """S8 for plate-layout CSV files: blocks "<name>,1,2,..." followed by lettered rows.

    Each file is tiny (one plate), so a file is read whole and split into lines;
    lines are numbered per file, blocks found by their header lines, cells
    exploded with their column number and the blocks joined on the well id.
    Blank cells and "NA" are missing.  Returns (file, well, <one column per
    block>); a block whose cells all parse is numeric unless ``typed`` is off.
    ``blocks`` names the blocks, which spares the job that looks for them.
    """
    raw = spark.read.option("wholetext", True).text(path).select(
        file_path().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("ln", "line"))
    cells = raw.withColumn("cells", F.split("line", ","))
    is_header = (F.size("cells") > 1) & (F.trim(F.col("cells")[1]) == "1")
    w = Window.partitionBy("file").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    lines = cells.withColumn("_hdr", F.when(is_header, F.trim(F.col("cells")[0])))
    lines = lines.withColumn("block", F.last("_hdr", ignorenulls=True).over(w))
    data = lines.where(~is_header & (F.trim(F.col("line")) != "") & F.col("block").isNotNull())
    wells = data.select(
        "file", "block", F.trim(F.col("cells")[0]).alias("_row"),
        F.posexplode(F.slice("cells", F.lit(2), F.greatest(F.size("cells") - 1, F.lit(0)))).alias("_c", "_v"),
    ).select(
        "file", "block",
        well_id(F.col("_row"), F.col("_c") + 1).alias("well"),
        missing_text(F.col("_v")).alias("_v"),
    )
    by = wells.groupBy("file", "well")
    out = (by.pivot("block", list(blocks)) if blocks is not None else by.pivot("block")).agg(F.first("_v"))
    return infer_numeric(out, [c for c in out.columns if c not in ("file", "well")]) if typed else out


def write_partitioned(df: DataFrame, path: str, by: Sequence[str] = ("exp_id", "day"), mode: str = "overwrite", whole: bool = False) -> None:
    """Parquet sink partitioned so experiment/day filters prune whole folders.

    "overwrite" replaces the folders that ``df`` has rows for and leaves the
    others, unless ``whole`` asks for a new table.  Rows are brought together by
    folder before the write, in tasks of even size (a large folder takes several).
    """
    dealt = df.hint("rebalance", *[F.col(c) for c in by])
    dealt.write.mode(mode).option("partitionOverwriteMode", "static" if whole else "dynamic").partitionBy(*by).parquet(path)
