"""Method comparison on the same objects (T8) and consensus voting."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaplate.operators.clean import recode, split_pair, unique_by
from vitaplate.operators.reshape import melt, restack, unify
from vitaplate.operators.wells import normalise_viability, well_measurements

# The label of the appended majority respondent and its group.
MAJORITY = "Majority"


def paired_calls(
    vd: DataFrame, ml: DataFrame, key: str = "uid", l_suffix: str = "_VD", r_suffix: str = "_Imaging",
    collapse: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """F9 + R8: the vital-dye objects with a unique key, with the imaging rows of the same key.

    F9 is applied to the vital-dye side alone; an object with several imaging
    rows comes once for each.  ``collapse``: see ``unify``.  Returns (unified,
    report); ``report`` counts the removed duplicate rows (A17).
    """
    vd_u, report = unique_by(vd, key)
    return unify(vd_u, ml, key, l_suffix, r_suffix, collapse), report


def method_compare_same(
    unified: DataFrame,
    l_suffix: str = "_VD",
    r_suffix: str = "_Imaging",
    keys: Sequence[str] = ("day", "compound", "concentration", "patient", "plate_row", "plate_col"),
) -> DataFrame:
    """R9 restack -> A1/R4 counts per well -> proportion curves -> split assay from compound.

    Assay names are tidied as the figure does: "media" -> "Media", "Imaging" -> "ML".
    """
    stacked = restack(unified, "ld", l_suffix, r_suffix)
    wells = well_measurements(stacked, feature=None, missing_as_zero=True, keys=keys)
    curves = normalise_viability(wells, "proportion")
    comp, assay = split_pair(F.col("compound"), "_")
    return curves.withColumns({
        "compound": F.when(comp == "media", "Media").otherwise(comp),
        "assay": F.when(assay == "Imaging", "ML").otherwise(assay),
    })


def majority_long(long: DataFrame, variable: str = "variable", value: str = "value") -> DataFrame:
    """A7 in long form: the most frequent value of each variable, ties to the smallest value.

    Missing answers are not candidates.  Counts per (variable, value) are a partial aggregate; the winner per variable
    is ``min_by`` over (-count, value), also partial.  No group's values are ever
    gathered in one place.
    """
    counts = long.where(F.col(value).isNotNull()).groupBy(variable, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(variable).agg(
        F.min_by(F.col(value), F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias(value)
    )


def consensus_votes(
    survey: DataFrame, ids: Sequence[str] = ("respondent", "grp"), respondent: str = "respondent", grp: str = "grp",
    voter_filter=None, groups: Sequence[tuple[str, str]] | None = None, items: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """Append the majority respondent, unpivot the votes, count answers per group (A10).

    ``groups`` and ``items`` recode group and item names (P8): ordered (name,
    label) pairs; the labels replace the names, names not listed become NULL,
    and ``grp_rank`` and ``item_rank`` hold the order.

    The majority row is built from ``voter_filter`` rows (default: everyone, as
    observed).  In long form appending it is a union: its respondent label is
    new, so the natural full join of the reference adds exactly these rows.
    """
    # Answers are compared as text, whatever type each vote column was read with.
    long = melt(survey, ids=list(ids), value_type=T.StringType())
    voters = long if voter_filter is None else long.where(voter_filter)
    major = majority_long(voters).select(
        F.lit(MAJORITY).alias(respondent), F.lit(MAJORITY).alias(grp), "variable", "value"
    )
    allrows = long.unionByName(major)
    counts = allrows.groupBy("variable", "value", grp).agg(F.count(F.lit(1)).alias("n"))
    for column, pairs, rank in ((grp, groups, "grp_rank"), ("variable", items, "item_rank")):
        if pairs is not None:
            names, labels = zip(*pairs)
            counts = recode(counts, column, names, labels, name="_label", rank_name=rank)
            counts = counts.withColumn(column, F.col("_label")).drop("_label")
    return counts
