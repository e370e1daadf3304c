"""Queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lettermill.llm.canonical import canonical_hosts
from lettermill.llm.encoding import garbled_records
from lettermill.llm.leakage import leaked_items
from lettermill.llm.new_text import new_text, old_lines
from lettermill.llm.personal import find_personal, mask_personal, one_body
from lettermill.llm.reading import reading_levels
from lettermill.llm.tokenizer import encode_corpus
from lettermill.session import spread, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each mail that its sender did not newly write."""
    return old_lines(table(spark, sf_dir, "messages"))


def p2_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sender's new text of each mail."""
    return new_text(table(spark, sf_dir, "messages"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in each mail."""
    return find_personal(spread(table(spark, sf_dir, "messages").select("msg_id", "body")), table(spark, sf_dir, "accounts"), table(spark, sf_dir, "addresses"))


def p3_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mail with its personal data replaced by placeholders."""
    messages = one_body(table(spark, sf_dir, "messages").select("msg_id", "body"))
    return mask_personal(messages, find_personal(messages, table(spark, sf_dir, "accounts"), table(spark, sf_dir, "addresses")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical host of each freely typed one."""
    return canonical_hosts(table(spark, sf_dir, "addresses"), table(spark, sf_dir, "common_hosts"))


def p6_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled records with their text as far as it could be had back."""
    return garbled_records(table(spark, sf_dir, "message_headers"), table(spark, sf_dir, "messages"), table(spark, sf_dir, "addresses"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled records."""
    return p6_restored(spark, sf_dir).select("field_name", "rec_id").dropDuplicates()


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k, without special tokens."""
    return encode_corpus(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that give away items of the benchmark."""
    return leaked_items(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading band of each English document."""
    return reading_levels(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "reading_labels"))


QUERIES = {"p2_found": p2_found, "p2_text": p2_text, "p3_found": p3_found, "p3_masked": p3_masked, "p5_found": p5_found, "p6_found": p6_found, "p6_restored": p6_restored, "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found}
SQL: dict[str, str] = {}
