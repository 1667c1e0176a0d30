"""Registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.llm import conversations, encoding, leakage, name_variants, personal, residue, scan_noise, similar_vectors
from tarnlight.llm.rows import each_once
from tarnlight.session import read, union_all


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return scan_noise.scan_noise(read(spark, folder, "chunks"), read(spark, folder, "sources"))["found"]


def p1_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return scan_noise.repair_pages(read(spark, folder, "chunks"), read(spark, folder, "sources"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    tables = ("atomic_memories", "hypotheses")
    return union_all([similar_vectors.similar_pairs(read(spark, folder, t)).select(F.lit(t).alias("collection"), "id_a", "id_b") for t in tables])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.rebuild_conversations(read(spark, folder, "memory_recall")).select("session_id", "turn", "message_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    authors = read(spark, folder, "sources").select(F.col("author").alias("name"))
    entities = read(spark, folder, "memory_entities").select(F.col("entity").alias("name"))
    return name_variants.variant_pairs(authors.union(entities))


#: The tables with personal data, and the column of each that holds the text.
PERSONAL = (("memory_recall", "content"), ("atomic_memories", "fact"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    tagger = personal.train()
    found = [
        personal.find_personal_data(read(spark, folder, table), "id", column, tagger).select(F.lit(table).alias("table_name"), F.col("id").alias("row_id"), F.explode("kinds").alias("kind"))
        for table, column in PERSONAL
    ]
    return union_all(found).distinct()


def p5_masked(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of both tables with its text masked; a row written twice comes out once."""
    tagger = personal.train()
    found = [
        each_once(read(spark, folder, table).select("id", column), "id", lambda rows, column=column: personal.find_personal_data(rows, "id", column, tagger)).select(F.lit(table).alias("table_name"), F.col("id").alias("row_id"), "masked")
        for table, column in PERSONAL
    ]
    return union_all(found)


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.encode_corpus(read(spark, folder, "documents"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_items(read(spark, folder, "documents"), read(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.find_residue(read(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_paragraphs": p1_paragraphs,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_masked": p5_masked,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p8_found": p8_found,
}
SQL: dict[str, str] = {}
