"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprint, html_templates, imi, jaccard, mixing, packing, pii, quality, toxicity
from .common import table


def op1_information_theoretic_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op2_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.linked_turns(table(spark, sf_dir, "conversations"))


def op3_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imi.search(table(spark, sf_dir, "embeddings"))


def op4_related_document_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_min_cost_flow_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, F.array("source")).select("doc_id", "size", "source_size", "target", "taken")


def op6_pattern_grammar_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_template_deduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_templates.main_texts(table(spark, sf_dir, "pages"))


def op8_neighbour_vote_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_homomorphic_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op10_adaptive_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_information_theoretic_pii,
        op2_tool_call_linking,
        op3_inverted_multi_index,
        op4_related_document_packing,
        op5_min_cost_flow_mixing,
        op6_pattern_grammar_toxicity,
        op7_template_deduction,
        op8_neighbour_vote_quality,
        op9_homomorphic_fingerprints,
        op10_adaptive_prefix_join,
    )
}
ORACLE = {"op2_tool_call_linking": chat.SQL, "op5_min_cost_flow_mixing": mixing.SQL}
