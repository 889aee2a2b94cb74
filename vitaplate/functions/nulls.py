"""

These are the places where the reference's data-frame semantics differ from
Spark's defaults.  Everything here returns a ``Column``; nothing runs Python per
row.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    """A column by its plain name (dots, spaces and brackets are part of the name)."""
    return F.col("`" + x.replace("`", "``") + "`") if isinstance(x, str) else x


def nan_to_null(x: ColumnOrName) -> Column:
    """NaN is missing (§1.1-4): map NaN to NULL, keep everything else."""
    x = _c(x)
    return F.nanvl(x, F.lit(None).cast(T.DoubleType()))


def ieee_div(num: ColumnOrName, den: ColumnOrName) -> Column:
    """Division with the reference's IEEE results, minus NaN (§1.1-3).

    x/0 gives +Inf or -Inf by the sign of x, 0/0 and Inf/Inf give NULL (R's NaN,
    which is treated as missing everywhere downstream).  The inner ``nullif``
    keeps ANSI mode from raising whichever branch Spark evaluates first.
    """
    num, den = _c(num).cast(T.DoubleType()), _c(den).cast(T.DoubleType())
    quotient = nan_to_null(num / F.nullif(den, F.lit(0.0)))
    return (
        F.when(den != 0, quotient)
        .when((den == 0) & (num > 0), F.lit(float("inf")))
        .when((den == 0) & (num < 0), F.lit(float("-inf")))
    )


def mean_strict(x: ColumnOrName) -> Column:
    """Aggregate mean that is NULL when any input is NULL (R ``mean`` without ``na.rm``)."""
    x = _c(x)
    return F.when(F.count(x) == F.count(F.lit(1)), nan_to_null(F.avg(x)))


def finite(x: ColumnOrName) -> Column:
    """True for non-missing finite values (R ``abs(x) != Inf`` filter, which also drops NA)."""
    x = _c(x)
    return x.isNotNull() & (F.abs(x) != F.lit(float("inf")))


def not_in_keep_null(x: ColumnOrName, values: Iterable) -> Column:
    """``!x %in% set``: rows whose value is missing are kept (§1.1-5)."""
    return F.coalesce(~_c(x).isin(list(values)), F.lit(True))


def num_label(x: ColumnOrName) -> Column:
    """Shortest decimal text of a number, as R's ``paste`` prints it (§1.1-7).

    20 -> "20", 0.74 -> "0.74", 100000 -> "1e+05", 1e-07 -> "1e-07": the shortest
    digits that read back as the same number (so different numbers never share a
    label), in fixed notation unless scientific is shorter.  NULL stays NULL.
    """
    x = _c(x).cast("double")
    text = F.regexp_replace(F.abs(x).cast(T.StringType()), r"\.0(?=E|$)", "")
    label = _let(text, lambda t: F.when(~t.rlike("^[0-9]"), t).otherwise(_let(_digits_and_exponent(t), _shorter_notation)))
    return F.concat(F.when(x < 0, "-").otherwise(""), label)


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def _digits_and_exponent(t: Column) -> Column:
    """The significant digits of a number's text, and the exponent of the first of them."""
    power = F.coalesce(F.regexp_extract(t, r"E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    whole, part = F.regexp_extract(t, r"^([0-9]+)", 1), F.regexp_extract(t, r"\.([0-9]+)", 1)
    digits = F.regexp_replace(F.concat(whole, part), "^0+|0+$", "")
    first = F.when(whole == "0", -F.length(F.regexp_extract(part, "^(0*)", 1)) - 1).otherwise(F.length(whole) - 1)
    return F.struct(digits.alias("d"), F.length(digits).alias("n"), (power + first).alias("e"))


def _shorter_notation(s: Column) -> Column:
    d, n, e = s["d"], s["n"], s["e"]
    fixed = (
        F.when(e >= n - 1, F.concat(d, F.repeat(F.lit("0"), e - n + 1)))
        .when(e >= 0, F.concat(F.substring(d, F.lit(1), e + 1), F.lit("."), F.substring(d, e + 2, n)))
        .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d))
    )
    mantissa = F.concat(F.substring(d, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(d, F.lit(2), n))).otherwise(""))
    exponent = F.concat(F.when(e < 0, "e-").otherwise("e+"), F.when(F.abs(e) < 10, "0").otherwise(""), F.abs(e).cast("string"))
    both = F.struct(fixed.alias("fixed"), F.concat(mantissa, exponent).alias("science"))
    shorter = _let(both, lambda b: F.when(F.length(b["fixed"]) <= F.length(b["science"]), b["fixed"]).otherwise(b["science"]))
    return F.when(n == 0, "0").otherwise(shorter)


def text_or_na(x: ColumnOrName, dtype: T.DataType | None = None) -> Column:
    """Text of a key part, with missing printed as "NA" (R ``paste``/``unite``, §1.1-6)."""
    x = _c(x)
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        text = num_label(x)
    else:
        text = x.cast(T.StringType())
    return F.coalesce(text, F.lit("NA"))


def key_concat(sep: str, *parts: ColumnOrName, schema: T.StructType | None = None) -> Column:
    """Composite key text: every part printed, missing parts as "NA" (P12).

    When ``schema`` is given, double columns named in ``parts`` are printed with
    :func:`num_label` so 20.0 appears as "20".
    """
    cols = []
    for p in parts:
        dtype = schema[p].dataType if (schema is not None and isinstance(p, str) and p in schema.fieldNames()) else None
        cols.append(text_or_na(p, dtype))
    return F.concat_ws(sep, *cols)


def null_safe_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Join condition matching NULL to NULL on every key (dplyr join semantics, §1.1-2)."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` matching NULL to NULL; the key columns appear once, from the left."""
    keys = list(keys)
    r = right.select(*[_c(k).alias(f"_r_{i}") for i, k in enumerate(keys)],
                     *[_c(c) for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [left[f"`{k}`"].eqNullSafe(r[f"_r_{i}"]) for i, k in enumerate(keys)])
    return left.join(r, cond, how).drop(*[f"_r_{i}" for i in range(len(keys))])
