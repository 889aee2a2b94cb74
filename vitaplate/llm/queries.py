"""The registered queries of the training-data operators: each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitaplate.llm import decontaminate, fingerprint, hamming_join, html_text, jaccard, lexical, licenses, mixing, pii, quality, resample, token_files, toxicity
from vitaplate.llm.common import table


def op1_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, their edited texts and their likeness."""
    return fingerprint.edited_neighbours(table(spark, sf_dir, "documents"))


def op2_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbatim matches of all benchmark windows in all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


def op3_patience_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All licenses of all documents."""
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.digest(toxicity.score_toxicity(docs, model))


def op5_line_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.digest(html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")))


def op6_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as ORC files and read back."""
    return token_files.encode_to_files(table(spark, sf_dir, "documents"))


def op7_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under the shingle Jaccard join."""
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"))


def op8_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in all documents."""
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op9_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of all documents."""
    return mixing.digest(mixing.curriculum(table(spark, sf_dir, "documents")))


def op10_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.digest(quality.score_quality(docs, model))


def op11_quickselect_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights and scores of all documents towards the benchmark, and the ranks of those drawn."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_aho_corasick_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hamming_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates of all documents."""
    return hamming_join.near_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query for each operator, and the pipeline."""
    return {
        "op1_quartile_digest": op1_quartile_digest,
        "op2_suffix_decontamination": op2_suffix_decontamination,
        "op3_patience_licenses": op3_patience_licenses,
        "op4_counterfactual_toxicity": op4_counterfactual_toxicity,
        "op5_line_block_text": op5_line_block_text,
        "op6_orc_tokens": op6_orc_tokens,
        "op7_token_group_join": op7_token_group_join,
        "op8_weak_supervision_pii": op8_weak_supervision_pii,
        "op9_curriculum_mix": op9_curriculum_mix,
        "op10_additive_quality": op10_additive_quality,
        "op11_quickselect_resampling": op11_quickselect_resampling,
        "op12_aho_corasick_search": op12_aho_corasick_search,
        "op13_hamming_near_duplicates": op13_hamming_near_duplicates,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {
        "op9_curriculum_mix": mixing.ORACLE,
        "op11_quickselect_resampling": resample.ORACLE,
        "op12_aho_corasick_search": lexical.ORACLE,
        "op13_hamming_near_duplicates": hamming_join.ORACLE,
    }
