from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from tests.conftest import SF_SMALL
from vitaplate.llm import decontaminate, jaccard, mixing, quality, queries

ROWS = duckdb.sql(f"select doc_id, text from '{SF_SMALL}/documents.parquet'").fetchall()


def test_all_operators_and_the_pipeline():
    names = list(queries.queries())
    assert sorted(n.split("_")[0] for n in names) == sorted(["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "op11", "op12", "op13", "pipeline"])


def test_op2_against_brute_force(spark):
    items = duckdb.sql(f"select item_id, text from '{SF_SMALL}/benchmark.parquet'").fetchall()
    got = queries.op2_suffix_decontamination(spark, SF_SMALL).collect()
    assert sorted(tuple(r)[:6] for r in got) == sorted(decontaminate.brute_force(ROWS, items))


def test_op7_against_brute_force(spark):
    got = queries.op7_token_group_join(spark, SF_SMALL).collect()
    assert sorted(map(tuple, got)) == sorted(jaccard.brute_force(ROWS))


def test_op9_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF_SMALL}/documents.parquet'")
    want = con.execute(mixing.ORACLE).df().sort_values("doc_id").reset_index(drop=True)
    got = queries.op9_curriculum_mix(spark, SF_SMALL).toPandas().sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


@pytest.mark.parametrize("name", ["op1_quartile_digest", "op4_counterfactual_toxicity", "op8_weak_supervision_pii", "op10_additive_quality", "op6_orc_tokens"])
def test_a_row_for_every_document(spark, name):
    assert sorted(r.doc_id for r in queries.queries()[name](spark, SF_SMALL).select("doc_id").collect()) == sorted(i for i, _ in ROWS)


def test_pipeline_matches_its_stages_by_hand(spark):
    """The filtering stages one by one in plain Python, the last two by their operators."""
    import corpus_pipeline

    docs = queries.table(spark, SF_SMALL, "documents")
    model = quality.fit_quality(docs, queries.table(spark, SF_SMALL, "labels"))
    good = [(r.doc_id, r.text) for r in quality.score_quality(docs, model).where("predicted = 1").collect()]
    one = {r[0] for r in jaccard.brute_force(good, 5, 80) if r[0] == r[2]}
    items = duckdb.sql(f"select item_id, text from '{SF_SMALL}/benchmark.parquet'").fetchall()
    clean = {r[0] for r in decontaminate.brute_force([g for g in good if g[0] in one], items) if not r[5]}
    kept = docs.where(docs.doc_id.isin(list(clean)))
    often = {r.doc_id: -(-r.taken // r.size) for r in mixing.curriculum(kept, sort=False).where("taken > 0").collect()}
    got = corpus_pipeline.run(spark, SF_SMALL).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == often
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
