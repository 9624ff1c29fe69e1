"""Queries of the text operators over the test tables, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.leakage import find_leaks
from tidemark.llm.subjects import find_subjects
from tidemark.llm.tokens import decode_corpus, encode_corpus
from tidemark.plans.tables import table


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again: what comes out must be what went in."""
    return decode_corpus(p6_ids(spark, sf_dir), "doc_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_subjects(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subjects"))


QUERIES = {"p6_ids": p6_ids, "p6_decoded": p6_decoded, "p7_found": p7_found, "p8_found": p8_found}

SQL = {"p6_decoded": "select doc_id, coalesce(text, '') as text from documents"}
