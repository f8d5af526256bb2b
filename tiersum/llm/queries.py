"""Registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tiersum.llm import binary_output, bpe, embedding_dedup, filter_audit, hmm, language, media, packing, periodic_runs, quality, secret_scan, toxicity
from tiersum.llm.common import materialize, table
from tiersum.llm.simhash import near_duplicates


def op1_quality_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.grade_documents(docs, quality.fit(docs, quality.usability(table(spark, sf_dir, "labels"))))


def op2_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"))


def op4_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media column is written as a table and read back from there; the tensors are columns of the result."""
    return media.read_media(materialize(media.store_texts(table(spark, sf_dir, "documents")), "media", "zstd"))


def op5_toxicity_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(table(spark, sf_dir, "documents"))


def op7_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_output.digest_rows(binary_output.write_ids(table(spark, sf_dir, "documents")))


def op8_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.learn(docs))


def op9_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_packing_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_secret_guess_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest_spans(secret_scan.scan_documents(table(spark, sf_dir, "documents")))


def op12_partition_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the texts, of which one in ten ends in a periodic tail."""
    return periodic_runs.digest_runs(periodic_runs.collapse_runs(periodic_runs.with_tails(table(spark, sf_dir, "documents"))))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_quality_ordinal, op2_pivot_permutation, op3_bpe_automaton, op4_progressive_jpeg, op5_toxicity_noisy_or, op6_hidden_markov, op7_token_id_output, op8_language_filters, op9_simhash_golay, op10_packing_bin_slack, op11_secret_guess_cost, op12_partition_refinement, op13_filter_audit)}
ORACLE_SQL: dict[str, str] = {"op13_filter_audit": filter_audit.SQL}
