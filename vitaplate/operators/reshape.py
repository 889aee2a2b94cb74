"""Reshape operators (R1-R10): unpivot, pivot, Live/Dead columns, unify and restack."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaplate.functions.names import quoted
from vitaplate.functions.ranking import checkpointed

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def melt(
    df: DataFrame,
    ids: Sequence[str] | None = None,
    values: Sequence[str] | None = None,
    variable: str = "variable",
    value: str = "value",
    value_type: T.DataType = T.DoubleType(),
) -> DataFrame:
    """Wide to long, keeping rows whose value is missing.

    With ``ids`` given (R1) every other column is a value column.  With no ids
    (R2) text and boolean columns are ids and numeric columns are values.  All
    value columns are cast to ``value_type`` first (mixed types cannot share one
    value column).  ``DataFrame.unpivot`` compiles to a single ``Expand``, so
    filters on id columns still reach the scan.
    """
    if ids is None:
        ids = [f.name for f in df.schema.fields if not isinstance(f.dataType, NUMERIC_TYPES)]
    ids = list(ids)
    if values is None:
        values = [c for c in df.columns if c not in ids]
    typed = df.select(*map(quoted, ids), *[quoted(v).cast(value_type).alias(v) for v in values])
    return typed.unpivot([quoted(i) for i in ids], [quoted(v) for v in values], variable, value)


def spread(
    df: DataFrame,
    keys: Sequence[str],
    variable: str,
    value: str,
    levels: Sequence[str],
) -> DataFrame:
    """Long to wide with one column per level (levels given, so no extra distinct job)."""
    return df.groupBy(*keys).pivot(variable, list(levels)).agg(F.first(value))


def live_dead_columns(value: Column | None, ld: Column, missing_as_zero: bool) -> list[Column]:
    """R4 folded into the grouping aggregate: one Live and one Dead column per group.

    ``value`` None counts rows (A1); otherwise the mean of ``value`` over the
    rows with that call, missing skipped (A2).  With ``missing_as_zero`` a well
    without rows of a call gets 0 instead of NULL.
    """
    out = []
    for call in ("Live", "Dead"):
        if value is None:
            n = F.count(F.when(ld == call, F.lit(1)))
            v = n if missing_as_zero else F.when(n > 0, n)
        else:
            v = F.avg(F.when(ld == call, value))
            v = F.nanvl(v, F.lit(None).cast("double"))
            if missing_as_zero:
                v = F.coalesce(v, F.lit(0.0))
        out.append(v.alias(call.lower()))
    return out


def unify(left: DataFrame, right: DataFrame, key: str, l_suffix: str, r_suffix: str, collapse: Sequence[str] | None = None) -> DataFrame:
    """Left join on ``key``; each shared column collapses when all non-missing pairs agree.

    The output columns depend on the data: A13 evaluates ``bool_and(l = r)`` for
    every shared column (NULL pairs are skipped; a column with no complete pair
    collapses).  The tests are metrics observed while the join is written, once,
    to the shared folder, so the decision costs no second pass.  A caller that
    knows the outcome names the columns that ``collapse``, and nothing is written.  A
    collapsed column keeps the right side's value, as the reference does; a
    column that disagrees is kept twice, right then left.
    """
    shared = [c for c in left.columns if c in right.columns and c != key]
    l_only = [c for c in left.columns if c not in shared and c != key]
    r_only = [c for c in right.columns if c not in shared and c != key]
    lsel = left.select(quoted(key), *map(quoted, l_only), *[quoted(c).alias(c + l_suffix) for c in shared])
    rsel = right.select(quoted(key).alias("_rkey"), *map(quoted, r_only), *[quoted(c).alias(c + r_suffix) for c in shared])
    merged = lsel.join(rsel, lsel["`" + key.replace("`", "``") + "`"] == rsel["_rkey"], "left").drop("_rkey")
    if collapse is None and shared:
        same = Observation()
        tests = [F.bool_and(quoted(c + l_suffix) == quoted(c + r_suffix)).alias(f"s{i}") for i, c in enumerate(shared)]
        merged = checkpointed(merged.observe(same, *tests))
        collapse = [c for i, c in enumerate(shared) if same.get[f"s{i}"] is not False]
    out = [quoted(key), *map(quoted, l_only + r_only)]
    for c in shared:
        if c in collapse:
            out.append(quoted(c + r_suffix).alias(c))
        else:
            out += [quoted(c + r_suffix), quoted(c + l_suffix)]
    return merged.select(*out)


def restack(
    df: DataFrame,
    foi: str,
    l_suffix: str,
    r_suffix: str,
    compound: str = "compound",
    treatment: str = "treatment",
    assay: str = "assay",
) -> DataFrame:
    """The two suffixed copies of ``foi`` become rows; the suffix tags compound and assay.

    One scan: each input row yields its two halves via ``explode`` of a
    two-element array, instead of scanning the input twice for a union.
    ``treatment`` and ``assay`` columns that the input has are overwritten.
    """
    made = (foi + l_suffix, foi + r_suffix, foi, treatment, assay)
    others = [c for c in df.columns if c not in made]
    halves = F.array(
        F.struct(F.lit(l_suffix).alias("_sfx"), quoted(foi + l_suffix).alias("_v")),
        F.struct(F.lit(r_suffix).alias("_sfx"), quoted(foi + r_suffix).alias("_v")),
    )
    ex = df.select(*map(quoted, others), F.explode(halves).alias("_h"))
    comp_text = F.coalesce(quoted(compound).cast("string"), F.lit("NA"))
    tagged = F.concat(comp_text, F.col("_h._sfx"))
    cols = [tagged.alias(compound) if c == compound else quoted(c) for c in others]
    return ex.select(
        *cols,
        F.col("_h._v").alias(foi),
        tagged.alias(treatment),
        F.col("_h._sfx").alias(assay),
    )
