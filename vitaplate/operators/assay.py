"""Luminescence plates: background subtraction (J5, P15, F6), normalisation to control (T7: A5, A6, J6),
and comparison with image-based viability (T9: J4, W2, F5, A11, A14, A15, F10)."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitaplate.functions.nulls import ieee_div, mean_strict, nan_to_null, not_in_keep_null
from vitaplate.operators.clean import canonical_compound
from vitaplate.operators.wells import with_treatments


def subtract_background(
    plates: DataFrame,
    plate: str = "plate",
    background: str = "ATP",
    background_dose: float = 0.0,
    exclude_doses: Mapping[str, Sequence[float]] | None = None,
) -> DataFrame:
    """J5 + P15 + F6: per plate, subtract the mean signal of the background wells.

    The per-plate background is a grouped aggregate joined back (one row per
    plate), never a window over a whole plate.  ``exclude_doses`` drops listed
    doses on listed plates, keeping wells whose dose is missing.
    """
    bg = plates.groupBy(plate).agg(
        nan_to_null(F.avg(F.when((F.col("compound") == background) & (F.col("concentration") == background_dose),
                                 F.col("signal")))).alias("_bg")
    ).withColumnRenamed(plate, "_bp")
    out = plates.join(bg, plates[plate].eqNullSafe(bg["_bp"]), "left").drop("_bp")
    out = out.withColumns({"signal": F.col("signal") - F.col("_bg"), "compound": canonical_compound("compound")}).drop("_bg")
    for p, doses in (exclude_doses or {}).items():
        keep = (F.col(plate) != p) | F.col("concentration").isNull() | ~F.col("concentration").isin(list(doses))
        out = out.where(F.coalesce(keep, F.lit(True)))
    return out


def plate_normalised(bg: DataFrame, control: str = "Media", background: str = "ATP") -> DataFrame:
    """Mean and sd per treatment and day (A5), control mean per day (A6), ratio to it.

    Means are NA-propagating; the control's per-day value is the mean of its
    per-dose means.  Then the treatment order is attached (W7).
    """
    sig = F.col("signal")
    per = bg.where(F.col("compound") != background).groupBy("compound", "concentration", "day").agg(
        mean_strict(sig).alias("mean"),
        F.when(F.count(sig) == F.count(F.lit(1)), nan_to_null(F.stddev_samp(sig))).alias("sd"),
    )
    # One row per treatment and day: the control's value is a window over those few rows.
    is_ctrl = F.col("compound") == control
    day = Window.partitionBy("day")
    known = F.count(F.when(is_ctrl & F.col("mean").isNotNull(), 1)).over(day) == F.count(F.when(is_ctrl, 1)).over(day)
    out = per.withColumn("_ctrl", F.when(known, F.avg(F.when(is_ctrl, F.col("mean"))).over(day)))
    out = out.withColumns({"norm_mean": ieee_div("mean", "_ctrl"), "norm_sd": ieee_div("sd", "_ctrl")}).drop("_ctrl")
    return with_treatments(out)


def assay_concordance(
    imaging: DataFrame,
    plates_bg: DataFrame,
    patients: Sequence[str],
    excluded: Sequence[str],
    days: Sequence[int],
) -> DataFrame:
    """Join plate signal to image-based viability of the same treatment, patient and day.

    ``imaging`` is a normalised curve table (T4 output); ``plates_bg`` the
    background-subtracted wells, which stand for each of ``patients``.  Wells are first reduced to one
    row per (day, compound, dose) holding sums and counts, so the join and the
    treatment ordering work on that small table instead of on every well; means
    over the joined wells are rebuilt from the sums (NA-propagating, A11).  Keys
    match null-safely (a missing dose equals a missing dose, §1.1-2).  The
    signal is divided by the control's value of the same day (W2); listed
    treatments are dropped, missing ones kept (F5); only listed days remain.
    """
    img = with_treatments(imaging).withColumn(
        "treatment", F.when(F.col("treatment") == "STA", "STA_5").otherwise(F.col("treatment"))
    )
    wells = plates_bg.groupBy("day", "compound", "concentration").agg(
        F.sum("signal").alias("_sum"), F.count("signal").alias("_nsig"), F.count(F.lit(1)).alias("_n"))
    wells = wells.withColumn("patient", F.explode(F.array(*[F.lit(p) for p in patients])))
    plates = with_treatments(wells).withColumn(
        "treatment",
        F.when(F.col("treatment") == "media", "Media").when(F.col("treatment") == "STA", "STA_5").otherwise(F.col("treatment")),
    )
    keys = ["day", "treatment", "patient", "concentration"]
    p = plates.select(*keys, "_sum", "_nsig", "_n")
    i = img.select(*[F.col(k).alias(f"_i_{k}") for k in keys], "live_mean")
    cond = (
        p["day"].eqNullSafe(i["_i_day"]) & p["treatment"].eqNullSafe(i["_i_treatment"])
        & p["patient"].eqNullSafe(i["_i_patient"]) & p["concentration"].eqNullSafe(i["_i_concentration"])
    )
    j = p.join(i, cond, "inner")
    summ = j.groupBy("day", "treatment", "patient").agg(
        F.when(F.sum("_nsig") == F.sum("_n"), F.sum("_sum") / F.sum("_n")).alias("mean_sig"),
        F.when(F.count("live_mean") == F.count(F.lit(1)),
               F.sum(F.col("live_mean") * F.col("_n")) / F.sum("_n")).alias("mean_pa"),
    )
    # Per-day table is tiny (treatments x patients); the window is bounded by it.
    w = Window.partitionBy("day")
    ctrl = F.max(F.when(F.col("treatment") == "Media", F.col("mean_sig"))).over(w)
    out = summ.withColumn("norm_media", ieee_div(F.col("mean_sig"), ctrl))
    return out.where(not_in_keep_null("treatment", excluded)).where(F.col("day").isin(list(days)))


def assay_fit(conc: DataFrame, x: str = "norm_media", y: str = "mean_pa", by: str = "treatment") -> DataFrame:
    """F10 + A14: points outside the [0, 1] axes are dropped, then a least-squares line per treatment."""
    pts = conc.where(F.col(x).between(0, 1) & F.col(y).between(0, 1))
    return pts.groupBy(by).agg(
        F.regr_count(F.col(y), F.col(x)).cast("long").alias("n_points"),
        F.regr_slope(F.col(y), F.col(x)).alias("slope"),
        F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
        F.regr_r2(F.col(y), F.col(x)).alias("r2"),
    )


def assay_points(conc: DataFrame, x: str = "norm_media", y: str = "mean_pa", by: str = "treatment") -> DataFrame:
    """F10 + A15: mean y at each x per treatment (the plotted point summary)."""
    pts = conc.where(F.col(x).between(0, 1) & F.col(y).between(0, 1))
    return pts.groupBy(by, x).agg(F.avg(y).alias("mean_y"), F.count(F.lit(1)).alias("n"))
