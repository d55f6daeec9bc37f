"""Queries of the text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlattice.llm.canonical import collapse
from barlattice.llm.packing import fill_report, pack
from barlattice.llm.sentences import sentence_units
from barlattice.llm.tokens import decode_documents, encode_documents, token_counts
from barlattice.sources.tables import table


def _proposals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return collapse(table(spark, d, "proposals", "proposal_id", "code_str", "variant_name"), "proposal_id", "code_str", "variant_name")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    members = _proposals(spark, d)[1]
    return members.select(F.col("representative").alias("proposal_id_a"), F.col("id").alias("proposal_id_b"))


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    groups = _proposals(spark, d)[0]
    return groups.select(F.col("representative").alias("proposal_id"), "copies")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_documents(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    return decode_documents(p8_ids(spark, d), "doc_id")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = token_counts(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")
    return pack(sizes, table(spark, d, "packs", "pack_id", "capacity"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(p9_containers(spark, d), table(spark, d, "packs", "pack_id", "capacity"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentence_units(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


QUERIES = {
    "p10_found": p10_found,
    "p6_found": p6_found,
    "p6_records": p6_records,
    "p8_ids": p8_ids,
    "p8_decoded": p8_decoded,
    "p9_containers": p9_containers,
    "p9_fill": p9_fill,
}
ORACLE = {"p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
