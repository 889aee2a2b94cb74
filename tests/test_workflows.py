"""Exported files to curves, and results that do not depend on row order or partitioning."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from vitaplate.operators import compare as M
from vitaplate.operators import transitions as TR
from vitaplate.operators import wells as W
from vitaplate.plans import surrogates as S
from vitaplate.plans.workflows import objects_from_exports


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)


def test_exports_to_dose_response(spark, tmp_path):
    root = str(tmp_path / "raw")
    head = "Display,Row,Column,Compound,Concentration,Cell Type,{call} Region Area [µm²]\n"
    # Experiment 1, patient 12737: Media well A1 and IRI 20 well A2, days 0 and 3.
    _write(f"{root}/E1/D0_Live.csv", head.format(call="Live") + "1,A,1,media,,12737 CRC,10\n2,A,1,media,,12737 CRC,12\n"
           "3,A,2,IRI,20,12737 CRC,11\n")
    _write(f"{root}/E1/D0_Dead.csv", head.format(call="Dead") + "4,A,2,IRI,20,12737 CRC,9\n")
    _write(f"{root}/E1/D3_Live.csv", head.format(call="Live") + "5,A,1,Media,,12737 CRC,20\n")
    _write(f"{root}/E1/D3_Dead.csv", head.format(call="Dead") + "6,A,1,Media,,12737 CRC,5\n7,A,2,IRI,20,12737 CRC,4\n"
           "8,A,2,IRI,20,12737 CRC,4\n")
    objects = objects_from_exports(spark, root)
    assert {"exp_id", "patient", "compound", "concentration", "day", "ld", "plate_row", "plate_col",
            "Region Area [µm²]"} <= set(objects.columns)
    curves = {(r.compound, r.day): (r.live_mean, r.nlive) for r in W.dose_response(objects).collect()}
    assert curves[("Media", 0)] == (1.0, 1.0)
    assert curves[("Media", 3)] == (0.5, 0.5)
    assert curves[("IRI", 0)] == (0.5, 1.0)
    assert curves[("IRI", 3)] == (0.0, 0.0)
    growth = {r.day: r.live_mean for r in W.growth_curve(objects, "Region Area [µm²]").collect()}
    assert growth == {0: 11.0, 3: 20.0}


def _sorted_rows(df):
    """Rows as sorted tuples; doubles to 9 decimals (sums in another order differ in the last bits)."""
    cols = sorted(df.columns)

    def v(x):
        return round(x, 9) if isinstance(x, float) else x

    return sorted((tuple(v(r[c]) for c in cols) for r in df.collect()), key=repr)


def test_results_do_not_depend_on_row_order(spark):
    objects = S.objects(spark, SF_SMALL)
    shuffled = objects.repartition(13).orderBy(F.rand(7))
    assert _sorted_rows(W.dose_response(objects)) == _sorted_rows(W.dose_response(shuffled))
    assert _sorted_rows(W.treatment_order(objects)) == _sorted_rows(W.treatment_order(shuffled))
    visits = S.visits(spark, SF_SMALL)
    v2 = visits.repartition(5).orderBy(F.rand(3))
    assert _sorted_rows(TR.transition_links(TR.tracked_cohort(visits))) == _sorted_rows(
        TR.transition_links(TR.tracked_cohort(v2)))
    survey = S.survey(spark, SF_SMALL)
    assert _sorted_rows(M.consensus_votes(survey)) == _sorted_rows(M.consensus_votes(survey.repartition(3)))


def test_baseline_day_is_exactly_one(spark):
    curves = W.dose_response(S.objects(spark, SF_SMALL))
    w = curves.groupBy("patient", "compound", "concentration").agg(F.min("day").alias("d0"))
    first = curves.join(w, ["patient", "compound", "concentration"]).where(F.col("day") == F.col("d0"))
    vals = [r.nlive for r in first.collect() if r.live_mean not in (None, 0.0)]
    assert vals and all(abs(v - 1.0) < 1e-12 for v in vals)
