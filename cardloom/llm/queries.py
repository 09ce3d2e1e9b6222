"""Queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm import boilerplate, contamination, contributor_cap, mixing, residue, survivors, toxicity, truncation
from cardloom.sources.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = contributor_cap.card_records(table(spark, sf_dir, "evidence_cards"), table(spark, sf_dir, "source_profiles"))
    return contributor_cap.over_cap(records)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_values(table(spark, sf_dir, "evidence_cards"))


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_rates(table(spark, sf_dir, "evidence_cards"), table(spark, sf_dir, "source_profiles"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_values(table(spark, sf_dir, "evidence_cards")).select("ingest_idx", "field")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.card_furniture(table(spark, sf_dir, "evidence_cards"))


def p5_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main body of each card's texts."""
    return boilerplate.main_bodies(table(spark, sf_dir, "evidence_cards", "ingest_idx", "title", "url", "supporting_text", "snippet")).drop("url")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.card_survivors(table(spark, sf_dir, "evidence_cards"), table(spark, sf_dir, "source_profiles"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = contamination.leaked_items(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))
    return leaks.select("item_id", "doc_id")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which test items leaked, and into how many documents."""
    leaks = contamination.leaked_items(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))
    return leaks.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("containment").alias("most"))


def p8_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of documents in the mix, with the output shard and position of each."""
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share per source."""
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_by_source(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found, "p3_found": p3_found, "p3_rates": p3_rates, "p4_found": p4_found, "p5_found": p5_found, "p5_bodies": p5_bodies, "p6_found": p6_found, "p7_found": p7_found, "p7_items": p7_items, "p8_copies": p8_copies, "p8_shares": p8_shares, "p9_found": p9_found, "p9_rates": p9_rates}


def oracle_sql() -> dict[str, str]:
    from cardloom.llm.sql import SQL

    return SQL
