"""Incremental form of the experiment directory scan.

The reference has no streaming; its only input step is "read every sheet of
every experiment".  When exports keep arriving, the same step is a Structured
Streaming file source: each new sheet file is read once, tagged with its
experiment, day and call from the path, and appended to the partitioned
Parquet sink (S9).  Exactly-once bookkeeping lives in the checkpoint location,
which defaults to a folder under the cluster's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import csv
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from vitaplate.functions.names import strip_call_words, strip_leading_dash
from vitaplate.session import ensure_checkpoint_dir
from vitaplate.sources.files import SHEET_PATTERN, file_path, first_line, header_names, list_files


def sheet_stream(spark: SparkSession, root: str, columns: list[str] | None = None,
                 max_files_per_trigger: int = 1000) -> DataFrame:
    """Stream of sheet rows: the (raw) header columns as text, plus ExpID, Day and LD.

    All sheets of one stream share one layout (columns are matched by
    position, as a CSV reader does); layouts that differ belong in separate
    streams or in the batch reader.  Without ``columns`` the layout is taken
    from the header of a sheet already present.
    """
    if columns is None:
        files = list_files(spark, f"{root.rstrip('/')}/*/*.csv")
        if not files:
            raise FileNotFoundError(f"no sheet under {root} to take the layout from; pass columns")
        columns = header_names(first_line(spark, files[0]))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .csv(f"{root.rstrip('/')}/*/*.csv")
    )
    df = raw.toDF(*[strip_leading_dash(strip_call_words(c)) for c in columns])
    path = file_path()
    sheet = F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)
    return df.withColumns({
        "ExpID": F.regexp_extract(path, r"([^/]+)/[^/]+$", 1),
        "Day": F.regexp_extract(sheet, SHEET_PATTERN, 1).try_cast(T.IntegerType()),
        "LD": F.regexp_extract(sheet, SHEET_PATTERN, 2),
    })


def ingest(stream: DataFrame, sink: str, name: str = "sheets", checkpoint: str | None = None,
           partition_by: tuple[str, ...] = ("ExpID", "Day")) -> StreamingQuery:
    """Append the stream to a partitioned Parquet folder, processing what is available now."""
    if checkpoint is None:
        checkpoint = os.path.join(ensure_checkpoint_dir(stream.sparkSession), f"stream-{name}")
    return (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .partitionBy(*partition_by)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(sink)
    )
