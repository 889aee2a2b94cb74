"""

Every query reads whole driver tables through the surrogate views and chains
library operators; output doubles are rounded to six decimals (see output.py).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaplate.functions.ranking import checkpointed
from vitaplate.operators import assay as A
from vitaplate.operators import clean as C
from vitaplate.operators import compare as M
from vitaplate.operators import features as FT
from vitaplate.operators import samples as SM
from vitaplate.operators import transitions as TR
from vitaplate.operators import wells as W
from vitaplate.operators.reshape import restack, spread
from vitaplate.plans import surrogates as S
from vitaplate.plans import file_queries
from vitaplate.plans.output import rounded
from vitaplate.sources.files import plate_wells
from vitaplate.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]

# The id columns of the object table (the reference melts with these ids).
OBJECT_IDS = ("exp_id", "patient", "compound", "concentration", "day", "ld", "plate_row", "plate_col")


# --- wells and curves ----------------------------------------------------------------------

def well_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 + R4 + P12: Live and Dead objects per well, missing calls as 0."""
    return W.well_measurements(W.with_well_key(S.objects(spark, sf_dir)), feature=None, missing_as_zero=True)


def well_feature_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 + P25 + R4: mean object area of Live and Dead objects per well, no zero fill."""
    wide = W.with_well_key(S.objects_wide(spark, sf_dir))
    return rounded(W.well_measurements(wide, feature="Region Area [µm²]", missing_as_zero=False))


def growth_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: area of live untreated objects per patient and day (replicate mean and sd)."""
    return rounded(W.growth_curve(S.objects_wide(spark, sf_dir), feature="Region Area [µm²]"))


def dose_response_proportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 + W1: proportion of live objects per condition and day, relative to the earliest day."""
    return rounded(W.dose_response(S.objects(spark, sf_dir), metric="proportion"))


def dose_response_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 with the Live/Dead ratio: x/0 is +Inf and counts as a well; NaN is missing."""
    return rounded(W.dose_response(S.objects(spark, sf_dir), metric="ratio"))


def treatment_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7 + P13 + A9: ordered treatment table of the object data."""
    return W.treatment_order(S.objects(spark, sf_dir))


def curve_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T11 + F7 + P24: plotted values of the normalised proportion curves, with error bars."""
    norm = W.dose_response(S.objects(spark, sf_dir), metric="proportion")
    t = W.curve_table(norm, normalized=True)
    return rounded(t.select("patient", "compound", "concentration", "day", "treatment", "treatment_rank",
                            "val", "dev", "lower", "upper"))


def curve_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-scale y-axis limits of each patient's curve plot."""
    norm = W.dose_response(S.objects(spark, sf_dir), metric="proportion")
    return rounded(W.curve_extents(W.curve_table(norm, normalized=True), by=("patient",)))


def curve_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3 (A8 + O1): sorted distinct days of each patient's curve plot, ranked."""
    norm = W.dose_response(S.objects(spark, sf_dir), metric="proportion")
    return W.curve_days(W.curve_table(norm, normalized=True), by=("patient",))


def plate_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12, second rule: y-axis limits of the plate curves, negative values kept."""
    norm = plate_normalised_table(spark, sf_dir)
    curves = norm.withColumns({"val": F.col("norm_mean"), "lower": F.col("norm_mean") - F.col("norm_sd"),
                               "upper": F.col("norm_mean") + F.col("norm_sd")})
    return rounded(W.curve_extents(curves, by=("compound",), clamp=False))


def change_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12, both rules on values that fall below 0: limits of the plate curves as change against the control."""
    change = F.col("norm_mean") - 1
    curves = plate_normalised_table(spark, sf_dir).withColumns({
        "val": change, "lower": change - F.col("norm_sd"), "upper": change + F.col("norm_sd")})
    rules = [W.curve_extents(curves, by=("compound",), clamp=c).withColumn("clamp", F.lit(c)) for c in (True, False)]
    return rounded(rules[0].union(rules[1]))


# Surrogate origins of two patients, appended to their names as one figure does.
ORIGINS = (("BUILDING", "Primary"), ("MACHINERY", "Metastasis"))


def patient_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patient names with their origin appended, of the normalised curves."""
    norm = W.dose_response(S.objects(spark, sf_dir), metric="proportion")
    return rounded(norm.withColumn("patient", C.with_origin("patient", ORIGINS)).select(
        "patient", "compound", "concentration", "day", "nlive"))


def dose_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 + F2 + F4: named compound/dose conditions (OR of ANDs), day 0 excluded."""
    o = S.objects(spark, sf_dir)
    comp, conc = F.col("compound"), F.col("concentration")
    cond = (
        ((comp == "IRI") & (conc == 20)) | ((comp == "IRI") & (conc == 40)) | ((comp == "OXA") & (conc == 20))
        | comp.isin("STA", "Media")
    )
    return rounded(o.where(cond & (F.col("day") != 0)).select(
        "exp_id", "patient", "compound", "concentration", "day", "ld", "region_area"))


# --- features ------------------------------------------------------------------------------

def feature_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 + F3 + F5 + P20: long feature table of untreated objects, NA values kept."""
    wide = S.objects_wide(spark, sf_dir).where(F.col("compound") == "Media")
    return rounded(FT.feature_long(wide, ids=list(OBJECT_IDS)))


def feature_heatmap_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6 (R5 + W5): untreated objects, mean per experiment/patient/day, z-scored per feature."""
    wide = S.objects_wide(spark, sf_dir).where(F.col("compound") == "Media")
    hm = FT.heatmap(wide, keys=("exp_id", "compound", "patient", "day"), sample_keys=("patient", "day", "exp_id"))
    return rounded(hm.select("sample", "patient", "day", "exp_id", "variable", "mean_val", "scaled"))


def feature_heatmap_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6 (R7 + A4 + W5): Live and Dead objects, untreated and STA, z-scored per feature."""
    wide = S.objects_wide(spark, sf_dir).where(F.col("compound").isin("Media", "STA"))
    keys = ("exp_id", "ld", "compound", "patient", "day")
    hm = FT.heatmap(wide, keys=keys, sample_keys=("patient", "day", "exp_id", "compound", "ld"))
    return rounded(hm.select("sample", *keys, "variable", "mean_val", "scaled"))


def _rms_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = S.objects_wide(spark, sf_dir)
    comp, conc = F.col("compound"), F.col("concentration")
    cond = ((comp == "OXA") & (conc == 20)) | ((comp == "IRI") & conc.isin(20)) | comp.isin("Media", "STA", "STA 5")
    return wide.where(cond & (F.col("day") != 0)).where(F.col("ld") == "Dead")


def feature_heatmap_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6 (R6 + W6): Dead objects of selected treatments, RMS-scaled per feature."""
    keys = ("compound", "concentration", "patient", "day", "ld")
    hm = FT.heatmap(_rms_input(spark, sf_dir), keys=keys, sample_keys=("patient", "day", "compound", "concentration"),
                    scale="rms")
    return rounded(hm.select("sample", *keys, "variable", "mean_val", "scaled"))


def feature_heatmap_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R6 + A4: all objects, mean per condition and call, neither filtered nor scaled."""
    keys = ("compound", "concentration", "patient", "day", "ld")
    hm = FT.heatmap(S.objects_wide(spark, sf_dir), keys=keys,
                    sample_keys=("patient", "day", "compound", "concentration", "ld"), scale=None)
    return rounded(hm.select("sample", *keys, "variable", "mean_val"))


def feature_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Euclidean distances between z-scored feature rows of the live/dead heatmap."""
    wide = S.objects_wide(spark, sf_dir).where(F.col("compound").isin("Media", "STA"))
    keys = ("exp_id", "ld", "compound", "patient", "day")
    feats = FT.select_features(wide, keys)
    hm = FT.heatmap(wide, keys=keys, sample_keys=("patient", "day", "exp_id", "compound", "ld"), features=feats)
    return rounded(FT.feature_distance(hm, list(FT.label_map(feats).values())))


def embedding_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T12 on the embeddings: distances between the 64 vector positions over all vectors."""
    emb = read_table(spark, sf_dir, "embeddings")
    wide = emb.select(*S.positions(emb, lambda i: f"d{i:02d}"))
    return rounded(FT.column_distance(wide, wide.columns))


def embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T12 between samples: the five nearest vectors of each vector."""
    return rounded(SM.sample_neighbours(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", k=5))


def feature_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violin densities of day-3 features per compound and patient (R2 melt with inferred ids)."""
    wide = W.with_well_key(S.objects_wide(spark, sf_dir)).where(F.col("day") == 3)
    wide = wide.where(F.col("compound").isin("Media", "Control", "STA"))
    long = FT.feature_long(wide, ids=None)
    return rounded(FT.feature_density(long, ["variable", "compound", "patient"]))


# --- tracked objects ----------------------------------------------------------------------------

def tracked_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 + F8 + P17: objects seen at >= 5 visits, their state per day, day 2 dropped."""
    return rounded(TR.tracked_cohort(S.visits(spark, sf_dir)))


def transition_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 + P19: state-transition counts per compound and stage."""
    return TR.transition_links(TR.tracked_cohort(S.visits(spark, sf_dir)))


def transition_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 + W8 + J8: node table of the transition graph per compound."""
    nodes, _ = TR.transition_nodes(TR.transition_links(TR.tracked_cohort(S.visits(spark, sf_dir))))
    return nodes


def transition_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 + T2: links with the 0-based ids of their source and target nodes."""
    _, links = TR.transition_nodes(TR.transition_links(TR.tracked_cohort(S.visits(spark, sf_dir))))
    return links


def event_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 on another alphabet: counts of consecutive kinds of event, missing ones included, per compound and stage."""
    return TR.link_table(S.event_visits(spark, sf_dir), tiebreak=("state", "intensity"), state="state", states=None)


# --- labels, votes, codes ----------------------------------------------------------------------------

def concordance_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P17 + P7: two 0/1 calls per document to a concordance state and its factor code."""
    lab = read_table(spark, sf_dir, "labels")
    st = lab.withColumn("status", C.concordance_status("quality", "toxic"))
    return C.factor_codes(st, "status", "status_code").select("doc_id", "quality", "toxic", "status", "status_code")


def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T10 (A7 + J3 + R1 + A10): answers per vote column and group, with the majority respondent added."""
    return M.consensus_votes(S.survey(spark, sf_dir))


# Surrogate orders and labels of the groups and items of the vote plot.
VOTE_GROUPS = (("src0", "Experts"), ("Majority", "Majority"), ("src1", "ML"), ("src2", "Dye"))
VOTE_ITEMS = (("quality", "1"), ("toxic", "2"), ("lang", "3"))


def consensus_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T10 with its ordered recodes (P8): votes by labelled group and item."""
    return M.consensus_votes(S.survey(spark, sf_dir), groups=VOTE_GROUPS, items=VOTE_ITEMS).groupBy(
        "variable", "item_rank", "value", "grp", "grp_rank").agg(F.sum("n").alias("n"))


def vote_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of each answer, one column per item."""
    counts = M.consensus_votes(S.survey(spark, sf_dir))
    return spread(counts.where(F.col("value").isin("0", "1")), ["value", "grp"], "variable", "n", ["quality", "toxic"])


# Surrogate recode of document languages (levels in display order, and labels).
LANG_LEVELS = ("en", "de", "fr", "es")
LANG_LABELS = ("English", "German", "French", "Spanish")


def recode_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered recode with explicit levels and labels; unlisted values get no label."""
    doc = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    return C.recode(doc, "lang", LANG_LEVELS, LANG_LABELS, name="lang_label", rank_name="lang_rank")


def factor_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer codes of event types among their sorted distinct values."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "event_type")
    return C.factor_codes(ev, "event_type", "event_type_code")


# --- same-object method comparison --------------------------------------------------------------

def unique_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9 + A17: objects whose key repeats are removed entirely; counts of rows kept and removed."""
    _, report = C.unique_by(S.vd_side(spark, sf_dir), "uid")
    return report


def unique_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9 + A17 in one scan: objects alone in their order, per patient and day, with the counts of all rows and of those removed."""
    orders = S.vd_side(spark, sf_dir).withColumn("order", F.substring_index("uid", ".", 1))
    kept, report = C.unique_rows(orders, "order")
    return kept.groupBy("patient", "day").agg(F.count(F.lit(1)).alias("n")).withColumns({k: F.lit(v).cast("long") for k, v in report.items()})


# What both methods record alike of an object (only the call differs).
SAME = ("quantity", "compound", "concentration", "day", "patient", "plate_row", "plate_col")


def unify_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R8 + J1: vital-dye and imaging calls of the same objects in one table."""
    unified, _ = M.paired_calls(S.vd_side(spark, sf_dir), S.ml_side(spark, sf_dir), collapse=SAME)
    return rounded(unified)


def unify_decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R8 + A13: the same table, its columns decided from the data: the calls differ, all else agrees."""
    unified, _ = M.paired_calls(S.vd_side(spark, sf_dir), S.ml_side(spark, sf_dir))
    return rounded(unified)


def restack_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R9 + U1: the two calls of each object as two rows tagged by assay."""
    unified, _ = M.paired_calls(S.vd_side(spark, sf_dir), S.ml_side(spark, sf_dir), collapse=SAME)
    return rounded(restack(unified, "ld", "_VD", "_Imaging"))


def method_compare_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T8 + P18: proportion-live curves of the same objects by each method."""
    unified, _ = M.paired_calls(S.vd_side(spark, sf_dir), S.ml_side(spark, sf_dir), collapse=SAME)
    return rounded(M.method_compare_same(unified))


# --- assay plates --------------------------------------------------------------------------------

def plate_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5 + P15 + F6: per-plate background subtraction; dose 0.25 dropped on plate F3, missing kept."""
    bg = A.subtract_background(S.plates(spark, sf_dir), exclude_doses={"F3": [0.25]})
    return rounded(bg)


def plate_normalised_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unrounded table of ``plate_normalised``."""
    return A.plate_normalised(A.subtract_background(S.plates(spark, sf_dir), exclude_doses={"F3": [0.25]}))


def plate_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T7 (A5 + A6 + J6 + U2 + W7): treatment means relative to the control of the same day."""
    return rounded(plate_normalised_table(spark, sf_dir))


# Treatments left out of the concordance plot, and the days kept.
CONCORDANCE_EXCLUDED = ("IRI_40", "OXA_20", "OXA_40", "Media", "IRI_0.74", "IRI_2.22", "IRI_6.66", "IRI_0.082", "IRI_0.25")
CONCORDANCE_DAYS = (1, 3, 7)
CONCORDANCE_PATIENTS = ("BUILDING", "MACHINERY")


def _assay_concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    imaging = W.dose_response(S.objects(spark, sf_dir), metric="proportion")
    bg = A.subtract_background(S.plates(spark, sf_dir), exclude_doses={"F3": [0.25]}).drop("patient")
    return A.assay_concordance(imaging, bg, CONCORDANCE_PATIENTS, CONCORDANCE_EXCLUDED, CONCORDANCE_DAYS)


# Display labels of the treatments in the concordance plot.
CONCORDANCE_LEVELS = ("IRI_20", "IRI_60", "STA_5")
CONCORDANCE_LABELS = ("IRI 20µM", "IRI 60µM", "STA 5µM")


def assay_concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T9 (J4 + A11 + W2 + F5 + P8): plate signal vs image-based viability, relative to control."""
    conc = _assay_concordance(spark, sf_dir)
    conc = C.recode(conc, "treatment", CONCORDANCE_LEVELS, CONCORDANCE_LABELS, name="label", rank_name="label_rank")
    return rounded(conc)


def assay_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14 + F10: least-squares line of live fraction on relative signal per treatment."""
    return rounded(A.assay_fit(_assay_concordance(spark, sf_dir)))


def assay_fit_censored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10 + A14 where points lie outside the axes: the signal relative to half the control, beside the number of all points."""
    scaled = checkpointed(_assay_concordance(spark, sf_dir).withColumn("norm_media", F.col("norm_media") * 2))
    every = scaled.groupBy("treatment").agg(F.count(F.lit(1)).alias("all_points"))
    return rounded(every.join(A.assay_fit(scaled), "treatment", "left"))


def assay_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15 + F10: mean live fraction at each relative signal per treatment."""
    return rounded(A.assay_points(_assay_concordance(spark, sf_dir)))


def plate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide plate grid to one row per well with its well id."""
    return rounded(plate_wells(S.grid(spark, sf_dir), row="vec_id", value="signal"))


def queries() -> dict[str, Query]:
    return {
        "well_counts": well_counts,
        "well_feature_mean": well_feature_mean,
        "growth_curve": growth_curve,
        "dose_response_proportion": dose_response_proportion,
        "dose_response_ratio": dose_response_ratio,
        "treatment_order": treatment_order,
        "curve_table": curve_table,
        "curve_extents": curve_extents,
        "curve_days": curve_days,
        "plate_extents": plate_extents,
        "patient_origins": patient_origins,
        "dose_filter": dose_filter,
        "feature_long": feature_long,
        "feature_heatmap_media": feature_heatmap_media,
        "feature_heatmap_z": feature_heatmap_z,
        "feature_heatmap_rms": feature_heatmap_rms,
        "feature_heatmap_plain": feature_heatmap_plain,
        "feature_distance": feature_distance,
        "embedding_distance": embedding_distance,
        "feature_density": feature_density,
        "tracked_cohort": tracked_cohort,
        "transition_links": transition_links,
        "transition_nodes": transition_nodes,
        "transition_graph": transition_graph,
        "concordance_status": concordance_status,
        "majority_vote": majority_vote,
        "consensus_votes": consensus_votes,
        "vote_table": vote_table,
        "recode_labels": recode_labels,
        "factor_codes": factor_codes,
        "unique_uid": unique_uid,
        "unify_sources": unify_sources,
        "restack_sources": restack_sources,
        "method_compare_same": method_compare_same,
        "plate_background": plate_background,
        "plate_normalised": plate_normalised,
        "assay_concordance": assay_concordance,
        "assay_fit": assay_fit,
        "assay_points": assay_points,
        "plate_grid": plate_grid,
        "embedding_neighbours": embedding_neighbours,
        "change_extents": change_extents,
        "assay_fit_censored": assay_fit_censored,
        "event_links": event_links,
        "unique_report": unique_report,
        "unify_decided": unify_decided,
        **file_queries.QUERIES,
    }
