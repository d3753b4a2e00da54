"""Queries of the text and code problems, and their SQL where SQL can say it."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import docpairs, leakage, neighbours, packing, personal, provenance, splitting, syntax


_RUN_KEY = secrets.token_bytes(32)


def pseudonym_key(spark: SparkSession) -> bytes:
    """The key in spark.lodegraph.pseudonymKey (hexadecimal); else one drawn for this run, so pseudonyms link within the run only."""
    named = spark.conf.get("spark.lodegraph.pseudonymKey", None)
    return bytes.fromhex(named) if named else _RUN_KEY


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_nodes(_table(spark, d, "repo_nodes"), once=False)
    return pieces.where("n_pieces > 1 and piece_no = 0").select("node_id").distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_nodes(_table(spark, d, "repo_nodes"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_files(_table(spark, d, "repo_nodes")).select("wiki_id", "rel_path")


def p3_files(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_files(_table(spark, d, "repo_nodes"))


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_rates(_table(spark, d, "repo_nodes"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance.not_handwritten(_table(spark, d, "repo_nodes")).select("wiki_id", "rel_path")


def p4_reasons(spark: SparkSession, d: str) -> DataFrame:
    return provenance.not_handwritten(_table(spark, d, "repo_nodes")).groupBy("wiki_id", "reason", "told_by").agg(F.count(F.lit(1)).alias("n_files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.close_pairs(_table(spark, d, "repo_vec"))


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbours(_table(spark, d, "repo_vec"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.documented_ids(_table(spark, d, "repo_nodes"))


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.documented_pairs(_table(spark, d, "repo_nodes"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_table(spark, d, "documents"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, d))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(_table(spark, d, "documents"), _table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max(F.col("matched_words") / F.col("item_words")).alias("max_share"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.find_mentions(_table(spark, d, "documents"), pseudonym_key(spark)).where("kind <> 'date'").select("doc_id", "kind", "start_at")


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redact_documents(_table(spark, d, "documents"), pseudonym_key(spark))


def p10_linked(spark: SparkSession, d: str) -> DataFrame:
    """Values that several documents mention, by their pseudonyms."""
    found = personal.find_mentions(_table(spark, d, "documents"), pseudonym_key(spark))
    digits = F.when(F.col("kind") == "phone", F.right(F.regexp_replace("pseudonym", r"\D", ""), F.lit(9))).otherwise(F.col("pseudonym"))
    return found.groupBy("kind", digits.alias("value")).agg(F.count_distinct("doc_id").alias("n_docs")).where("n_docs > 1").groupBy("kind").agg(F.count(F.lit(1)).alias("n_values"), F.sum("n_docs").alias("n_docs"))


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p3_found": p3_found, "p3_files": p3_files, "p3_rates": p3_rates, "p4_found": p4_found, "p4_reasons": p4_reasons, "p5_found": p5_found, "p5_neighbours": p5_neighbours, "p6_found": p6_found, "p6_pairs": p6_pairs, "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_found": p9_found, "p9_items": p9_items, "p10_found": p10_found, "p10_redacted": p10_redacted, "p10_linked": p10_linked}

SQL = {"p1_found": "select distinct node_id from repo_nodes where length(source_text) > 4000"}
