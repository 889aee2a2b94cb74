"""Cleaning, typing, recoding and small scalar operators."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaplate.functions.names import quoted
from vitaplate.functions.nulls import nan_to_null, num_label
from vitaplate.functions.ranking import checkpointed, dense_codes

# Compound spellings that all mean the untreated control.
CONTROL_SPELLINGS = ("control", "Control", "media")
CONTROL_NAME = "Media"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- P1-P4: canonicalisation -------------------------------------------------------------

def strip_text(col: Column | str, text: str = " CRC") -> Column:
    """Remove every occurrence of ``text`` (patient names carry a " CRC" suffix)."""
    return F.regexp_replace(_c(col), text, "")


def canonical_compound(col: Column | str) -> Column:
    """P2 + P3: missing compound and every control spelling become "Media"."""
    c = _c(col)
    return F.when(c.isNull() | c.isin(*CONTROL_SPELLINGS), F.lit(CONTROL_NAME)).otherwise(c)


def missing_text(col: Column) -> Column:
    """Trimmed text, with blank cells and "NA" as NULL."""
    text = F.trim(col)
    return F.when(~text.isin("", "NA"), text)


def to_number(col: Column | str) -> Column:
    """Text to double; blank, "NA" and unparseable text become NULL (never raises under ANSI)."""
    return nan_to_null(missing_text(_c(col).cast("string")).try_cast(T.DoubleType()))


def clean_input(
    df: DataFrame,
    compound: str = "compound",
    concentration: str = "concentration",
    patient: str = "patient",
    repair_embedded_dose: bool = False,
) -> DataFrame:
    """P1-P4 and P6 in one projection.

    ``repair_embedded_dose`` turns 'STA 5' into compound 'STA' at dose 5 where the
    dose is missing (the evident intent of a repair that never fires as written).
    """
    cols = {}
    if patient in df.columns:
        cols[patient] = strip_text(patient)
    comp = canonical_compound(compound)
    conc = to_number(concentration) if concentration in df.columns else None
    if repair_embedded_dose and conc is not None:
        embedded = (comp == "STA 5") & conc.isNull()
        conc = F.when(embedded, F.lit(5.0)).otherwise(conc)
        comp = F.when(embedded, F.lit("STA")).otherwise(comp)
    cols[compound] = comp
    if conc is not None:
        cols[concentration] = conc
    return df.withColumns(cols)


# --- P5: whole-table type inference -------------------------------------------------------

def infer_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """P5: retype each text column that parses as a number in every non-blank row.

    Blank cells and "NA" are missing.  One aggregate job counts, per column, the
    values there are and those that parse; the result plan is then a static projection.
    """
    text_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if columns is not None:
        text_cols = [c for c in text_cols if c in columns]
    if not text_cols:
        return df
    aggs = []
    for i, c in enumerate(text_cols):
        v = missing_text(quoted(c))
        aggs += [F.count(v).alias(f"n{i}"), F.count(v.try_cast(T.DoubleType())).alias(f"p{i}")]
    stats = df.agg(*aggs).first()
    numeric = {c for i, c in enumerate(text_cols) if stats[f"n{i}"] > 0 and stats[f"n{i}"] == stats[f"p{i}"]}
    return df.select(*[to_number(quoted(c)).alias(c) if c in numeric else quoted(c) for c in df.columns])


# The spellings that type conversion takes for truth values, and the forms of numbers and dates.
TRUE_TEXT, FALSE_TEXT = ("T", "TRUE", "true", "True"), ("F", "FALSE", "false", "False")
INTEGER_FORM = r"^[+-]?[0-9]{1,18}$"
NUMBER_FORM = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DATE_FORM = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def _type_forms(text: Column) -> dict[str, Column]:
    """The value of ``text`` as each type of the lattice below text, null where it has another form; narrower types first."""
    number = F.when(text.rlike(NUMBER_FORM), text.try_cast(T.DoubleType()))
    return {
        "logical": F.when(text.isin(*TRUE_TEXT), F.lit(True)).when(text.isin(*FALSE_TEXT), F.lit(False)),
        "integer": F.when(text.rlike(INTEGER_FORM), text.try_cast(T.LongType())),
        "double": number,
        "date": F.when(text.rlike(DATE_FORM), text.try_cast(T.DateType())),
    }


def column_types(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, str]:
    """P5: the type of each text column, the join of its values' types: logical, integer, double, date or text.

    Integers and doubles join to double; any other two types join to text.  Blank
    cells and "NA" are missing and fit every type, so a column of them is logical.
    One aggregate job counts, per column, the values and those of each form.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)]
    if not names:
        return {}
    aggs = []
    for i, c in enumerate(names):
        text = missing_text(quoted(c))
        aggs.append(F.count(text).alias(f"n{i}"))
        aggs += [F.count(form).alias(f"{kind}{i}") for kind, form in _type_forms(text).items()]
    seen = df.agg(*aggs).first()
    kinds = list(_type_forms(F.lit("")))
    return {c: next((k for k in kinds if seen[f"{k}{i}"] == seen[f"n{i}"]), "text") for i, c in enumerate(names)}


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """P5 over the whole lattice: every text column becomes boolean, long, double, date or stays text (see ``column_types``).

    Missing cells of text columns become NULL as well.
    """
    types = column_types(df, columns)

    def typed(c: str) -> Column:
        text = missing_text(quoted(c))
        return (_type_forms(text)[types[c]] if types[c] != "text" else F.when(text.isNotNull(), quoted(c))).alias(c)

    return df.select(*[typed(c) if c in types else quoted(c) for c in df.columns])


# --- P7, P8: factors and recodes ----------------------------------------------------------

def factor_codes(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """1-based integer code of each value among the sorted distinct values."""
    return dense_codes(df, column, name or f"{column}_code")


def recode(
    df: DataFrame,
    column: str,
    levels: Sequence,
    labels: Sequence[str] | None = None,
    name: str | None = None,
    rank_name: str | None = None,
) -> DataFrame:
    """Ordered factor with explicit levels and labels; unlisted values become NULL.

    The recode table has exactly ``len(levels)`` rows, so broadcasting it is safe.
    """
    labels = list(labels) if labels is not None else [str(v) for v in levels]
    if len(labels) != len(levels):
        raise ValueError("levels and labels differ in length")
    name = name or f"{column}_label"
    rank_name = rank_name or f"{column}_rank"
    spark = df.sparkSession
    dtype = df.schema[column].dataType
    table = spark.createDataFrame(
        [(lv, lb, i + 1) for i, (lv, lb) in enumerate(zip(levels, labels))],
        T.StructType([
            T.StructField("_lv", dtype), T.StructField(name, T.StringType()), T.StructField(rank_name, T.IntegerType())
        ]),
    )
    return df.join(F.broadcast(table), df[column] == table["_lv"], "left").drop("_lv")


def with_origin(col: Column | str, origins: Sequence[tuple[str, str]]) -> Column:
    """P23: "name (Origin)" for the listed names; others stay as they are."""
    c = _c(col)
    out = c
    for name, origin in origins:
        out = F.when(c == name, F.concat(c, F.lit(f" ({origin})"))).otherwise(out)
    return out


# --- P13, P14, P17-P19: labels and codes --------------------------------------------------

def treatment_label(compound: Column | str = "compound", concentration: Column | str = "concentration") -> Column:
    """Compound, plus "_<dose>" when the dose is known (dose printed as R prints it)."""
    comp, conc = _c(compound), _c(concentration)
    return F.concat(comp, F.when(conc.isNull(), F.lit("")).otherwise(F.concat(F.lit("_"), num_label(conc))))


def seconds_to_days(col: Column | str) -> Column:
    """Seconds to whole days, rounding half to even."""
    return F.bround(_c(col) / 86400.0).cast("long")


# The four concordance codes of an image call (ML) and a vital-dye call (VD).
STATUS_LL, STATUS_LD, STATUS_DL, STATUS_DD = "L-ML_L-VD", "L-ML_D-VD", "D-ML_L-VD", "D-ML_D-VD"


def concordance_status(ml_live: Column | str, vd_live: Column | str) -> Column:
    """Two 0/1 calls to one of four codes; anything else (incl. missing) is "0"."""
    m, v = _c(ml_live), _c(vd_live)
    return (
        F.when((m == 1) & (v == 1), STATUS_LL)
        .when((m == 1) & (v == 0), STATUS_LD)
        .when((m == 0) & (v == 1), STATUS_DL)
        .when((m == 0) & (v == 0), STATUS_DD)
        .otherwise("0")
    )


def split_pair(col: Column | str, sep: str = "_") -> tuple[Column, Column]:
    """P18: "media_VD" -> ("media", "VD")."""
    parts = F.split(_c(col), sep, 2)
    return parts.getItem(0), parts.getItem(1)


def link_group(source: Column | str) -> Column:
    """P19: "type_b" when the ML and VD letters of a state agree, else "type_a"."""
    s = _c(source)
    ml = F.regexp_extract(s, r"_(.)-ML_(.)", 1)
    vd = F.regexp_extract(s, r"_(.)-ML_(.)", 2)
    return F.when(ml == vd, "type_b").otherwise("type_a")


def is_control(col: Column | str) -> Column:
    """case-insensitive control match."""
    return F.lower(_c(col)).isin("media", "control")


# --- F9, A17: keep keys seen once -----------------------------------------------------------

def unique_by(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """F9 + A17: keep only rows whose ``key`` occurs exactly once; report what was removed.

    Keys are counted with map-side combining (a key repeated millions of times
    costs one partial row per task) and a left-semi join keeps the rows of keys
    seen once.  A missing key is a key like any other.
    Returns ``(kept, report)`` where report holds total, kept and removed counts.
    """
    counts = df.groupBy(quoted(key)).agg(F.count(F.lit(1)).alias("_n"))
    once = counts.where(F.col("_n") == 1).select(quoted(key).alias("_once"))
    kept = df.join(once, quoted(key).eqNullSafe(F.col("_once")), "left_semi")
    report = counts.agg(
        F.sum("_n").alias("total_rows"),
        F.count(F.when(F.col("_n") == 1, 1)).alias("kept_rows"),
    ).withColumn("removed_rows", F.col("total_rows") - F.col("kept_rows"))
    return kept, report


def unique_rows(df: DataFrame, key: str) -> tuple[DataFrame, dict[str, int]]:
    """F9 + A17 in one scan: the rows whose ``key`` occurs once, and the counts of rows in total, kept and removed.

    A key's rows are counted with one of them kept aside (partial aggregates, so
    a key repeated millions of times costs one row per task); where the count is
    1 that row is the only one.  The counts are metrics observed while the kept
    rows are written once, so the report reads nothing again.  A missing key is a
    key like any other.
    """
    counted = df.groupBy(quoted(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*map(quoted, df.columns))).alias("_row"))
    seen = Observation()
    metrics = (F.sum("_n").alias("total"), F.count_if(F.col("_n") == 1).alias("kept"))
    kept = checkpointed(counted.observe(seen, *metrics).where(F.col("_n") == 1).select("_row.*"))
    total, once = seen.get["total"] or 0, seen.get["kept"] or 0
    return kept, {"total_rows": total, "kept_rows": once, "removed_rows": total - once}
