"""Objects to wells, wells to conditions: counts, means, viability, baselines, treatment order.

Operators A1-A3, A9, A12, P16, P24, R4, T4, T5, T11, W1, W7.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitaplate.functions.names import quoted
from vitaplate.functions.nulls import finite, ieee_div, key_concat, nan_to_null
from vitaplate.functions.ranking import checkpointed, window_index
from vitaplate.operators.clean import is_control, treatment_label
from vitaplate.operators.reshape import live_dead_columns

# Column roles used throughout (surrogate names; pass others where they differ).
WELL_KEYS = ("day", "compound", "concentration", "patient", "well_row", "well_col")
CONDITION_KEYS = ("patient", "compound", "concentration")


def with_well_key(df: DataFrame, row: str = "plate_row", col: str = "plate_col", exp: str = "exp_id") -> DataFrame:
    """Wells are unique only within an experiment, so the row label carries the experiment."""
    return df.withColumns({"well_row": key_concat("_", row, exp), "well_col": F.col(col)})


def well_measurements(
    df: DataFrame,
    feature: str | None = None,
    missing_as_zero: bool = True,
    keys: Sequence[str] = WELL_KEYS,
    ld: str = "ld",
) -> DataFrame:
    """A1/A2 + R4: per well, Live and Dead object counts (``feature`` None) or feature means.

    Counting per (well, call) and then pivoting the call is folded into one
    conditional aggregate: one shuffle, partial aggregation on the map side.
    """
    value = None if feature is None else quoted(feature)
    return df.groupBy(*keys).agg(*live_dead_columns(value, F.col(ld), missing_as_zero))


def replicate_summary(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """A3: wells with a value, mean and sample sd over replicate wells (missing skipped).

    +Inf counts as a value; a mean or sd that comes out NaN is missing.
    """
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.count(v).alias("n_wells"),
        nan_to_null(F.avg(v)).alias("live_mean"),
        nan_to_null(F.stddev_samp(v)).alias("live_sd"),
    )


def viability(live: Column | str = "live", dead: Column | str = "dead", metric: str = "proportion") -> Column:
    """Live/(Live+Dead) for "proportion", Live/Dead otherwise, with IEEE x/0."""
    lv = F.col(live) if isinstance(live, str) else live
    dd = F.col(dead) if isinstance(dead, str) else dead
    return ieee_div(lv, lv + dd) if metric == "proportion" else ieee_div(lv, dd)


def baseline_normalise(
    df: DataFrame, keys: Sequence[str] = CONDITION_KEYS, order: str = "day", value: str = "live_mean", sd: str = "live_sd"
) -> DataFrame:
    """Divide mean and sd by the mean at the earliest day present in each condition.

    The first row's mean is used even when it is missing (then the whole curve
    is missing), as ``first`` without skipping does.  Conditions are few, so the
    window runs on the small per-condition table.
    """
    w = (
        Window.partitionBy(*keys)
        .orderBy(F.col(order).asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    with_base = df.withColumn("_base", F.first(value, ignorenulls=False).over(w))
    return with_base.withColumns({
        "nlive": ieee_div(F.col(value), F.col("_base")), "nlive_sd": ieee_div(F.col(sd), F.col("_base")),
    }).drop("_base")


def normalise_viability(wells: DataFrame, metric: str = "proportion", keys: Sequence[str] = CONDITION_KEYS) -> DataFrame:
    """P16 -> A3 -> W1: per-condition, per-day viability relative to the earliest day."""
    per_well = wells.withColumn("plive", viability(metric=metric))
    stats = replicate_summary(per_well, "plive", [*keys, "day"])
    return baseline_normalise(stats, keys)


def dose_response(objects: DataFrame, metric: str = "proportion", feature: str | None = None) -> DataFrame:
    """T4: objects -> wells (zero-filled) -> viability -> replicate stats -> baseline ratio."""
    wells = well_measurements(with_well_key(objects), feature=feature, missing_as_zero=True)
    return normalise_viability(wells, metric)


def growth_curve(objects: DataFrame, feature: str, control: str = "Media") -> DataFrame:
    """T5: mean feature of Live objects per well (no zero fill), summarised per patient and day."""
    wells = well_measurements(with_well_key(objects).where(F.col("compound") == control), feature=feature,
                              missing_as_zero=False)
    return replicate_summary(wells, "live", [*CONDITION_KEYS, "day"])


def _ranked_treatments(df: DataFrame, compound: str, concentration: str) -> DataFrame:
    """``df`` with ``treatment``, ``treatment_rank``, ``compound_rank``, ``n_doses``, ``n_compounds`` and ``n_controls``.

    Windows over ``df``'s own rows: for distinct treatments.
    """
    comp, conc = F.col(compound), F.col(concentration)
    per = Window.partitionBy(compound)
    everything = Window.partitionBy()
    t = df.withColumn("_doses", F.size(F.collect_set(F.struct(conc)).over(per)))
    single = F.col("_doses") == 1
    controls = F.size(F.collect_set(F.when(single & is_control(compound), comp)).over(everything))
    t = t.withColumns({"_single_controls": controls, "n_compounds": F.size(F.collect_set(F.struct(comp)).over(everything)).cast("int"),
                       "n_controls": F.size(F.collect_set(F.when(is_control(compound), comp)).over(everything)).cast("int")})
    pinned = single & is_control(compound) & (F.col("_single_controls") == 1)
    first = [F.when(single, 0).otherwise(1), F.when(F.coalesce(pinned, F.lit(False)), 0).otherwise(1), comp.asc_nulls_last()]
    order = Window.orderBy(*first, conc.asc_nulls_last())
    return t.withColumns({
        "treatment": treatment_label(compound, concentration),
        "treatment_rank": F.dense_rank().over(order).cast("int"),
        "compound_rank": F.dense_rank().over(Window.orderBy(*first)).cast("int"),
        "n_doses": F.col("_doses").cast("int"),
    }).drop("_doses", "_single_controls")


def treatment_order(df: DataFrame, compound: str = "compound", concentration: str = "concentration") -> DataFrame:
    """W7 + P7 + P13 + A9: the ordered treatment table of ``df``.

    Compounds with a single treatment row come first, alphabetically; the control
    moves to the very front when it is the only control row.  Compounds with
    several doses follow, by compound then ascending dose (missing dose last); a
    missing compound is one like any other, and last of its kind.
    Returns one row per distinct (compound, concentration) with ``treatment``,
    ``treatment_rank`` and ``compound_rank`` (1-based), ``n_doses`` of the compound,
    and the table's ``n_compounds`` and ``n_controls``.  The windows see the
    distinct treatments only.
    """
    ranked = _ranked_treatments(df.select(compound, concentration).distinct(), compound, concentration)
    return ranked.select(compound, concentration, "treatment", "treatment_rank", "compound_rank", "n_doses", "n_compounds", "n_controls")


def with_treatments(df: DataFrame, compound: str = "compound", concentration: str = "concentration") -> DataFrame:
    """Attach ``treatment`` and ``treatment_rank`` to every row of ``df``, however many rows a treatment has.

    ``df`` is written once, since its distinct treatments are ranked apart
    (``treatment_order``, whose windows see no other rows) and joined back by
    null-safe keys.
    """
    rows = checkpointed(df)
    order = treatment_order(rows, compound, concentration)
    order = order.select(F.col(compound).alias("_compound"), F.col(concentration).alias("_dose"), "treatment", "treatment_rank")
    same = rows[compound].eqNullSafe(order["_compound"]) & rows[concentration].eqNullSafe(order["_dose"])
    return rows.join(order, same, "left").drop("_compound", "_dose")


def curve_table(norm: DataFrame, normalized: bool = True) -> DataFrame:
    """T11 data: ordered treatments, the chosen value and error bar, finite values only.

    ``norm`` has one row per condition and day.
    """
    val, dev = ("nlive", "nlive_sd") if normalized else ("live_mean", "live_sd")
    t = with_treatments(norm).withColumns({"val": F.col(val), "dev": F.col(dev)})
    t = t.where(finite("val"))
    return t.withColumns({"lower": F.col("val") - F.col("dev"), "upper": F.col("val") + F.col("dev")})


def curve_extents(curves: DataFrame, by: Sequence[str] = ("patient",), error_bars: bool = True, clamp: bool = True) -> DataFrame:
    """Fixed-scale y-axis limits of a curve plot, and the number of distinct days.

    ``clamp`` keeps the lower limit at 0 (the viability curves); without it the
    limit is the floor of the lowest value, negatives kept (the other plots).
    """
    hi = F.max("upper") if error_bars else F.max("val")
    lo = F.min("lower") if error_bars else F.min("val")
    g = curves.groupBy(*by).agg(hi.alias("_hi"), lo.alias("_lo"), F.countDistinct("day").alias("n_days"))
    miny = F.floor(F.when(F.col("_lo") > 0, F.lit(0.0)).otherwise(F.col("_lo"))).cast("double")
    if clamp:
        miny = F.coalesce(F.greatest(miny, F.lit(0.0)), F.lit(0.0))
    maxy = F.when(F.col("_hi") < 2, F.bround(F.col("_hi"), 1)).otherwise(F.ceil(F.col("_hi")).cast("double"))
    return g.select(*by, miny.alias("y_min"), maxy.alias("y_max"), F.col("n_days").cast("int").alias("n_days"))


def curve_days(curves: DataFrame, by: Sequence[str] = ("patient",), day: str = "day") -> DataFrame:
    """O3: the sorted distinct days of each curve plot (its x-axis breaks), with a 1-based rank."""
    days = curves.select(*by, day).distinct()
    ranked = window_index(days, [F.col(day).asc()], groups=list(by), name="_r")  # days of a plot: few
    return ranked.select(*by, day, (F.col("_r") + 1).cast("int").alias("day_rank"))
