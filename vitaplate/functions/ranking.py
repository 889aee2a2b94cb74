"""Ordinal numbering: a plain window for dimension-sized tables, slices for the rest.

``row_number()`` over a window with no partition (or over a hot group) moves
every row of that group into one task.  ``sequence_index`` gets the same
numbers with one range shuffle on (group, order, tie-breaker): a hot group, and a
value that most of its rows share, are spread over many sorted slices.  One sequential pass per slice (Arrow batches through
pandas) numbers the rows within each run of equal group keys and reports the
slice's first and last run.  Only a slice's first run can continue a group from
earlier slices, so a prefix sum over these summaries (at most two rows per
slice) yields one offset per slice, a table bounded by the number of slices
and therefore safe to broadcast.  The pass is written once (see
``checkpointed``) so the summaries and the rows come from the same run.
"""

from __future__ import annotations

import math
import uuid
from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaplate.session import ensure_checkpoint_dir


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the cluster's checkpoint folder and read it back.

    This cuts the lineage like ``DataFrame.checkpoint()`` but computes the input
    once (an RDD checkpoint recomputes it to write, unless cached), keeps the
    data columnar and compressed, and gives the planner real file sizes for its
    broadcast decisions.  The folder is the shared one named by
    ``spark.checkpoint.dir``, so the table survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    _WRITTEN.setdefault(id(spark), []).append(path)
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: dict[int, list[str]] = {}


def release_materialised(spark) -> int:
    """Delete the tables this session materialised with :func:`checkpointed`; returns how many.

    Call it once the results built on them have been written or collected.  Deletion goes
    through Hadoop's FileSystem, so it works for HDFS and object stores alike.
    """
    paths = _WRITTEN.pop(id(spark), [])
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        hp.getFileSystem(conf).delete(hp, True)
    return len(paths)


def _plain(v):
    """Hashable, null-safe form of one key value (NaN and None are the same missing value)."""
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, np.generic):
        return v.item()
    return v


def _run_numbering(groups: list[str], columns: list[str]):
    """Per-slice pass: position within runs of equal group keys, plus first/last run summaries."""

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prev_key = None        # group key of the previous row (tuple), None before the first row
        prev_pos = -1          # position of the previous row within its run
        runs_before = 0        # runs started in earlier batches of this slice
        first_key, first_len, first_open = None, 0, True
        last_key, last_len = None, 0
        slice_id = None
        for pdf in batches:
            n = len(pdf)
            if n == 0:
                continue
            if slice_id is None:
                slice_id = int(pdf["_slice"].iloc[0])
            new = np.zeros(n, dtype=bool)
            for g in groups:
                s = pdf[g]
                prev = s.shift(1)
                same = (s == prev).fillna(False).to_numpy(dtype=bool) | (s.isna() & prev.isna()).to_numpy(dtype=bool)
                new |= ~same
            row0 = tuple(_plain(pdf[g].iloc[0]) for g in groups)
            new[0] = prev_key is None or row0 != prev_key
            idx = np.arange(n)
            start = np.maximum.accumulate(np.where(new, idx, -1))
            local = np.where(start >= 0, idx - start, prev_pos + 1 + idx)
            run_no = runs_before + np.cumsum(new)  # 1 for the slice's first run
            out = pdf.assign(_local=local.astype("int64"), _first=(run_no == 1), _kind=0, _cnt=0)
            yield out
            firsts = run_no == 1
            if first_open:
                first_key = row0 if prev_key is None else first_key
                first_len += int(firsts.sum())
                first_open = bool(firsts[-1])
            last_key = tuple(_plain(pdf[g].iloc[-1]) for g in groups)
            last_len = int(local[-1]) + 1
            prev_key, prev_pos = last_key, int(local[-1])
            runs_before = int(run_no[-1])
        if slice_id is None:
            return
        summary = [(1, first_key, first_len)]
        if runs_before > 1:
            summary.append((2, last_key, last_len))
        rows = []
        for kind, key, cnt in summary:
            row = {c: None for c in columns}
            row.update(dict(zip(groups, key)))
            row.update({"_slice": slice_id, "_local": 0, "_first": kind == 1, "_kind": kind, "_cnt": cnt})
            rows.append(row)
        yield pd.DataFrame(rows, columns=columns + ["_local", "_first", "_kind", "_cnt"])

    return number


def window_index(df: DataFrame, order: Sequence[Column | str], groups: Sequence[str] = (), name: str = "_idx") -> DataFrame:
    """Add ``name``: 0-based position within its group, by a plain window inside the plan.

    For tables whose groups are bounded by a dimension (treatments, days): a
    group is sorted by one task and nothing is written.  Rows of any number go
    to :func:`sequence_index`.
    """
    w = Window.partitionBy(*groups).orderBy(*[F.col(o) if isinstance(o, str) else o for o in order])
    return df.withColumn(name, (F.row_number().over(w) - 1).cast("long"))


def sequence_index(
    df: DataFrame,
    order: Sequence[Column | str],
    groups: Sequence[str] = (),
    name: str = "_idx",
    slices: int | None = None,
) -> DataFrame:
    """Add ``name``: 0-based position of each row within its group, by ``order``.

    Equivalent to ``row_number() over (partition by groups order by order) - 1``
    (ties get distinct consecutive numbers), with no group ever processed by a
    single task: rows take one range shuffle on (group, order, row number of the
    materialised input), so that equal values are spread as well, and a pass
    over each slice numbers them.  Group keys are compared null-safely.

    The input is materialised first: its upstream runs once (range partitioning
    samples its input in a job of its own), and the row numbers that break ties
    are those of the written files.
    """
    groups = list(groups)
    df = checkpointed(df).withColumn("_tie", F.monotonically_increasing_id())
    keys = [F.col(g) for g in groups] + [F.col(o) if isinstance(o, str) else o for o in order] + [F.col("_tie")]
    # Without an explicit slice count AQE may merge adjacent small ranges; merged
    # slices stay in range order, which is all the numbering relies on.
    ranged = df.repartitionByRange(slices, *keys) if slices else df.repartitionByRange(*keys)
    sliced = ranged.sortWithinPartitions(*keys).drop("_tie").withColumn("_slice", F.spark_partition_id())
    columns = sliced.columns
    # Summary rows carry NULL outside the group keys, so every field is declared nullable.
    schema = T.StructType(
        [T.StructField(f.name, f.dataType, True) for f in sliced.schema.fields]
        + [T.StructField("_local", T.LongType()), T.StructField("_first", T.BooleanType()),
           T.StructField("_kind", T.IntegerType()), T.StructField("_cnt", T.LongType())]
    )
    numbered = checkpointed(sliced.mapInPandas(_run_numbering(groups, columns), schema))

    # Summaries: at most two rows per slice.  A slice's first run continues its
    # group from earlier slices; its offset is the group's count in those slices.
    summ = numbered.where(F.col("_kind") > 0).select("_slice", *groups, "_cnt", "_first")
    w = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        summ.withColumn("_off", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
        .where(F.col("_first"))
        .select(F.col("_slice").alias("_oslice"), "_off")
    )
    rows = numbered.where(F.col("_kind") == 0)
    # One row per slice: bounded by the slice count, so broadcasting it is safe.
    out = rows.join(F.broadcast(offsets), rows["_slice"] == offsets["_oslice"], "left")
    idx = F.col("_local") + F.when(F.col("_first"), F.coalesce(F.col("_off"), F.lit(0))).otherwise(0)
    return out.withColumn(name, idx.cast("long")).drop("_slice", "_local", "_first", "_kind", "_cnt", "_oslice", "_off")


def dense_codes(df: DataFrame, column: str, name: str, order: Column | None = None) -> DataFrame:
    """Add ``name``: 1-based code of ``column`` among its sorted distinct values (R factor codes).

    Missing values get no code (NULL), as a factor's NA has none.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    coded = sequence_index(values, [order if order is not None else F.col(column).asc()], name="_code")
    coded = coded.select(F.col(column).alias("_cv"), (F.col("_code") + 1).cast("int").alias(name))
    return df.join(coded, df[column] == coded["_cv"], "left").drop("_cv")


def domain_codes(df: DataFrame, column: str, name: str, domain: Sequence) -> DataFrame:
    """Add ``name``: 1-based code of ``column`` among the values of a fixed ``domain`` that occur.

    Same result as :func:`dense_codes` when every value lies in ``domain``, but
    the only data-dependent part is which domain values occur: one partial
    aggregate evaluated as a scalar subquery, with no distinct table and no join
    back.  Values outside the domain (and NULL) get no code.
    """
    domain = sorted(domain)
    col = F.col(column)
    present = df.select(
        F.struct(*[F.max(F.when(col == F.lit(v), 1).otherwise(0)).alias(f"p{i}") for i, v in enumerate(domain)])
    ).scalar()
    # The subquery is bound once as a column; the codes only read its fields.
    flags = df.withColumn("_present", present)
    code = None
    for i, v in enumerate(domain):
        rank = F.lit(1)
        for j in range(i):
            rank = rank + F.col("_present").getField(f"p{j}")
        code = (F.when(col == F.lit(v), rank) if code is None else code.when(col == F.lit(v), rank))
    return flags.withColumn(name, code.cast("int")).drop("_present")
